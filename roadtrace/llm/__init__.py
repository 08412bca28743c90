"""Training-data operators: thirteen corpus operators, their queries and the SQL that checks them."""
