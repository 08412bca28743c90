"""Trajectory and event-rule analytics over Spark DataFrames."""
