"""Greedy groups of near pairs against a plain pass, at every size of the tasks."""

import random

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import duplicates as U


def plain(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    taken = {}
    for a in sorted(near):
        if a not in taken:
            for b in near[a]:
                taken.setdefault(b, a)
    return taken


def plain_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graphs():
    rng = random.Random(12)
    chain = list(range(1, 91))
    shuffled = chain[:]
    rng.shuffle(shuffled)
    star = [(1, k) for k in range(2, 90)]
    dense = [(a, b) for a in range(200, 212) for b in range(a + 1, 212)]
    loose = {tuple(sorted(rng.sample(range(300, 420), 2))) for _ in range(150)}
    links = [tuple(sorted(x)) for x in zip(shuffled, shuffled[1:])]
    return {"chain": list(zip(chain, chain[1:])), "shuffled": links, "star": star, "mixed": sorted({*star, *dense, *loose, *((a + 500, b + 500) for a, b in links)})}


@pytest.mark.parametrize("name", ["chain", "shuffled", "star", "mixed"])
@pytest.mark.parametrize("most", [10**6, 60])
def test_greedy_groups_against_a_plain_pass(spark, monkeypatch, name, most):
    pairs = graphs()[name]
    monkeypatch.setattr(U, "TASK_PAIRS", most)
    df = spark.createDataFrame(pairs, "a int, b int").repartition(3)
    assert {r.id: r.rep for r in U.greedy_groups(df).collect()} == plain(pairs)
    if most == 60:
        got = [tuple(r) for r in U.components(df).collect()]
        assert len(got) == len(set(got)) and dict(got) == plain_components(pairs)


def test_a_long_chain_takes_few_jobs(spark):
    """10,000 hashes, each six bits from the one before and twelve or more from all others."""
    hashes, x = [], 0
    rng = random.Random(13)
    order = list(range(256))
    for k in range(10_000):
        if k % 40 == 0:
            rng.shuffle(order)
        for i in range(6):
            x ^= 1 << order[(6 * (k % 40) + i) % 256]
        hashes.append(x)
    df = spark.createDataFrame([(k, f"f{k}", f"{h:064x}") for k, h in enumerate(hashes)], "id int, file_hash string, phash string").repartition(4)
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = U.near_duplicates(df).collect()
    jobs = len(status.getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    near = {k: [m for m in range(k + 1, min(k + 3, 10_000)) if (hashes[k] ^ hashes[m]).bit_count() <= 10] for k in range(10_000)}
    assert {(r.representative, r.duplicate) for r in got} == {(a, b) for b, a in plain([(a, b) for a in near for b in near[a]]).items()}
    assert len(got) > 3000 and jobs < 20, jobs


def test_no_pairs(spark):
    assert U.greedy_groups(spark.createDataFrame([], "a int, b int")).collect() == []


def test_exploded_keys_are_not_broadcast(spark):
    # hashes derived from one narrow column: the planner takes all that follows for small
    rows = spark.range(0, 3000, 1, 4).select(F.col("id").cast("int").alias("id"), F.sha2((F.col("id") - F.col("id") % 2).cast("string"), 256).alias("phash"))
    pairs = U.near_pairs(rows)
    assert sorted(map(tuple, pairs.collect())) == [(i, i + 1) for i in range(0, 3000, 2)]
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
