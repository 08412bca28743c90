import random
import re

import numpy as np
import pytest

from roadtrace.llm import neardup
from roadtrace.llm.neardup import keep_one_of_each, link, near_duplicates

DOCS = "doc_id long, text string, n_shingles string"


def sets_of(rows, n):
    out = {}
    for doc_id, text in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def brute(rows, n, percent):
    sets = sets_of(rows, n)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def corpus(seed, groups=12, size=6):
    rng = random.Random(seed)
    rows, doc = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.randrange(1, size)):
            rows.append((doc, " ".join(edited(rng, base, rng.randrange(0, 4)))))
            doc += 1
    rows += [(doc, None), (doc + 1, ""), (doc + 2, " \n\t "), (doc + 3, "one"), (doc + 4, "ONE"), (doc + 5, "one two"), (doc + 6, "a b c " * 3000)]
    return rows


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, n, percent):
    rows = corpus(n)
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_large_nodes_and_cut_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 4)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 900)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 5)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 3, 85).collect()}
    assert got == brute(rows, 3, 85)


@pytest.mark.parametrize("edits", [2, 30])
def test_groups_of_many_blocks(spark, monkeypatch, edits):
    """A tight group, and a loose one of a common template in which most members link with few others."""
    for name, value in (("LEAF", 4), ("BLOCK_SHINGLES", 700), ("BLOCK_MEMBERS", 3), ("BLOCK_SKETCHES", 32)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(edits)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(45):
        own = edited(rng, base, rng.randrange(edits + 1))
        rows += [(3 * i + k, " ".join(edited(rng, own, k))) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_one_id_with_several_texts(spark):
    rng = random.Random(4)
    a, b = ([f"{c}{rng.randrange(10**6)}" for _ in range(80)] for c in "ab")
    rows = [(3, a), (5, [*a, "z"]), (5, b), (9, [*b, "q"])]
    df = spark.createDataFrame([(d, " ".join(t), k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, tid int")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, 3, 85).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False)]
    assert sorted(r.tid for r in keep_one_of_each(df, 3, 85).collect()) == [0, 2]
    more = df.unionByName(df).unionByName(spark.createDataFrame([(None, " ".join(a), 7), (5, None, 8), (5, "", 9)], df.schema))
    assert sorted(r.tid for r in keep_one_of_each(more, 3, 85).collect()) == [0, 2, 7, 8, 9]
    assert keep_one_of_each(df.limit(0), 3, 85).collect() == []


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (7, "A b C d")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(df, 3, 85).collect())
    assert got == [("4", "4", True), ("4", "4", True), ("7", "4", False), ("None", "None", True)]
    assert near_duplicates(df.limit(0), 3, 85).collect() == []


def test_link_is_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**60, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) < 0.95], rng.integers(0, 2**60, 3, dtype=np.uint64)])) for _ in range(40)]
    root = link(sets, 85)
    want = list(range(40))
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    assert [root[i] == root[j] for i in range(40) for j in range(40)] == [want[i] == want[j] for i in range(40) for j in range(40)]


def test_members_branch_once(spark, monkeypatch):
    """No table of nodes or pivots branches its members again: what was exploded is written and read."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(d, " ".join(edited(rng, base, 6)), None) for d in range(400)]
    plans = {}

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode"))
        return neardup_write(df, name)

    from roadtrace import session

    neardup_write = session.materialise
    monkeypatch.setattr(session, "materialise", seen)
    near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).count()
    assert len(plans["nodes"]) > 1 and set(plans["nodes"]) == {0}
    assert set(plans["held"]) == {0}


def test_stars_settle_in_one_look(spark, monkeypatch):
    from roadtrace.llm import components

    written = []
    write = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(name) or write(df, name))
    stars = [(a, a % 3) for a in range(3, 60)]
    got = components.connected_components(spark.createDataFrame(stars, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(a, a % 3) for a in range(60)} and len(written) == 2
    chain = [(a, a + 1) for a in range(90)] + [(7, 7), (50, 49), (200, 199), (300, 500), (400, 500)]
    got = {tuple(r) for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(a, 0) for a in range(91)} | {(199, 199), (200, 199), (300, 300), (400, 300), (500, 300)}
