"""Votes over plate readings, and probes of large catalogues."""

from decimal import Decimal
from itertools import permutations

from pyspark.sql import functions as F

from roadtrace.operators import plates as P
from roadtrace.plans import registry


def test_equal_means_are_equal_in_any_order_of_rows(spark):
    # as doubles, 0.3 + 0.4 + 0.5 and 0.5 + 0.4 + 0.3 differ; so would the winner
    rows = [(k, text, c) for k, (a, b) in enumerate(permutations(list(permutations((0.3, 0.4, 0.5))), 2)) for text, cs in (("AB 1", a), ("CD 2", b)) for c in cs]
    votes = P.plate_vote(spark.createDataFrame(rows, "k int, raw_text string, confidence double").coalesce(1), ["k"]).collect()
    assert len(votes) == 30 and {(r.text, r.reads) for r in votes} == {("AB 1", 3)}
    assert {r.confidence for r in votes} == {float(Decimal("1.2")) / 3}


def test_a_higher_mean_wins_and_odd_confidences_do_not_fail(spark):
    rows = [(1, "CD 2", 0.30000000000000004), (1, "AB 1", 0.3), (2, "CD 2", 0.9), (2, "AB 1", float("nan")), (3, "AB 1", 0.29), (3, "AB 1", None)]
    got = {r.k: r.text for r in P.plate_vote(spark.createDataFrame(rows, "k int, raw_text string, confidence double"), ["k"]).collect()}
    assert got == {1: "CD 2", 2: "CD 2"}


def test_probes_of_large_ids(spark, tmp_path):
    spark.range(2140, 6001, 1930).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = registry.queries()["probe_to_metadata"](spark, str(tmp_path)).collect()
    assert {r.path: r.file_size_mb for r in rows} == {f"/media/clip_{s}.mp4": round((s + 1) * 1000003 / 1048576, 2) for s in (2140, 4070, 6000)}
