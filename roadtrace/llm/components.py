"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round is one aggregation and one join per star. A hub's neighbours are pre-aggregated
before the shuffle, and the smallest ones are written out before they are joined back, so
that the join has shuffles of its own and AQE can split a hub's rows over tasks. The same
aggregation tells whether any node still has two smaller neighbours, or smaller and larger
ones; where none has, every edge leads to a root. Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.session import discard, materialise


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (a long, b long), any direction, loops and repeats allowed.

    Returns (node, root) for every node of an edge between different nodes, where root is
    the smallest node it can reach; roots are returned too.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = materialise(e, "cc")
    for _ in range(rounds):
        was = e
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lower, upper = F.count_if(F.col("b") < F.col("a")), F.count_if(F.col("b") > F.col("a"))
        first = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), ((lower > 1) | ((lower > 0) & (upper > 0))).alias("loose")), "cc-low")
        if first.filter("loose").isEmpty():
            discard(first)
            break
        large = both.join(first, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = materialise(large, "cc-large")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        e = materialise(small, "cc")
        discard(was, first, large, low)
    else:
        raise RuntimeError("components did not settle; raise rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
