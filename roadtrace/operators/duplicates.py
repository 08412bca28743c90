"""Duplicates: equal files, and near-equal perceptual hashes in greedy groups.

Groups are rows (representative, duplicate): a file that millions of rows repeat is so many
rows, never one array.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.session import discard, materialise

BITS, NEAR = 256, 10
#: Bits of a band, and what an XOR of equal bands leaves.
BAND = 16


def exact_duplicates(videos: DataFrame) -> DataFrame:
    """Equal file hashes: the smallest id represents each of the others."""
    named = videos.filter("file_hash is not null").select("id", "file_hash")
    first = named.groupBy("file_hash").agg(F.min("id").alias("representative"))
    rows = named.join(first, "file_hash").filter("id <> representative")
    return rows.select("representative", F.col("id").alias("duplicate"), F.lit("exact").alias("match_type"))


def as_groups(rows: DataFrame) -> DataFrame:
    """One row a representative with its duplicates as an array, for listings of small groups."""
    return rows.groupBy("representative", "match_type").agg(F.array_sort(F.collect_list("duplicate")).alias("duplicates")).select("representative", "duplicates", "match_type")


def hash_words(phash: Column) -> Column:
    """The four longs of a hash of 64 hexadecimal digits; null where it is malformed."""
    low = F.lower(phash)
    part = lambda at: F.conv(F.substring(low, at, 8), 16, 10).cast("long")
    words = F.array(*(F.shiftleft(part(16 * i + 1), 32).bitwiseOR(part(16 * i + 9)) for i in range(BITS // 64)))
    return F.when(low.rlike(f"^[0-9a-f]{{{BITS // 4}}}$"), words)


def _band_pairs(near: int) -> list[tuple[int, int]]:
    """Pairs of bands of which one at least is equal in any two hashes within `near` bits.

    At least bands - near bands are equal. Dealt into one group fewer than that, two of them
    fall into one group. Neighbouring bands stand in different groups, so that a constant
    head or tail fills no key.
    """
    bands = BITS // BAND
    groups = bands - near - 1
    if groups < 1:
        raise ValueError(f"near must be below {bands - 1} bits")
    return [(a, b) for g in range(groups) for a in range(g, bands, groups) for b in range(a + groups, bands, groups)]


def _node_pairs(nodes: DataFrame, near: int) -> DataFrame:
    """na < nb of nodes (node, w) whose distinct hashes lie within `near` bits.

    Nodes meet where two bands of 16 bits are both equal, and a pair leaves the join under
    the first of its common keys only, so nothing is made distinct afterwards. The planner takes
    exploded keys for as small as their nodes, and would broadcast them: they are merged.
    """
    pairs = _band_pairs(near)
    band = lambda w, i: F.shiftrightunsigned(w[i * BAND // 64], 64 - BAND - i * BAND % 64).bitwiseAND(F.lit((1 << BAND) - 1).cast("long"))
    w = F.col("w")
    keys = F.array(*(F.shiftleft(band(w, a), BAND).bitwiseOR(band(w, b)).bitwiseOR(F.lit(k << (2 * BAND)).cast("long")) for k, (a, b) in enumerate(pairs)))
    rows = nodes.select("node", "w", F.explode(keys).alias("key"))
    left = rows.select(F.col("node").alias("na"), F.col("w").alias("wa"), "key")
    right = rows.select(F.col("node").alias("nb"), F.col("w").alias("wb"), "key")
    apart = [F.col("wa")[i].bitwiseXOR(F.col("wb")[i]) for i in range(BITS // 64)]
    distance = reduce(lambda x, y: x + y, (F.bit_count(x) for x in apart))
    first = F.coalesce(*(F.when(band(apart, a).bitwiseOR(band(apart, b)) == 0, F.lit(k)) for k, (a, b) in enumerate(pairs)))
    met = left.join(right.hint("merge"), "key").filter("na < nb").filter(distance <= near)
    return met.filter(first == F.shiftright("key", 2 * BAND)).select("na", "nb")


def near_pairs(hashes: DataFrame, near: int = NEAR) -> DataFrame:
    """Pairs a < b of ids within `near` bits; malformed hashes are skipped.

    Equal hashes are one node while nodes are joined, and expand into their ids at the end.
    Hashes and nodes are written, and all joins merge: none is broadcast by a size that was
    guessed from the columns it is derived from.
    """
    named = materialise(hashes.select("id", hash_words(F.col("phash")).alias("w")).filter("w is not null"), "hashes")
    nodes = materialise(named.groupBy("w").agg(F.min("id").alias("node")), "nodes")
    met = _node_pairs(nodes, near)
    met = met.unionByName(nodes.select(F.col("node").alias("na"), F.col("node").alias("nb")))
    ids = materialise(named.join(nodes.hint("merge"), "w").select("node", "id"), "ids")
    side = lambda node, x: ids.select(F.col("node").alias(node), F.col("id").alias(x)).hint("merge")
    both = met.join(side("na", "x"), "na").join(side("nb", "y"), "nb")
    return both.filter((F.col("na") != F.col("nb")) | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


#: Pairs that one task takes at most, in memory of some hundred bytes each.
TASK_PAIRS = 2_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs as a forest: each id of a task's pairs with the smallest id it reaches through them."""
    root: dict = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    schema = None
    for batch in batches:
        schema = batch.schema
        for x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b"))):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    if schema is not None:
        rows = [(top, x) for x in root if (top := find(x)) != x]
        for at in range(0, len(rows), 100_000):
            cols = list(zip(*rows[at : at + 100_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(cols, "ab")], names=["a", "b"])


def components(pairs: DataFrame) -> DataFrame:
    """id, component: the smallest id that each id of the pairs (a < b) reaches.

    Pairs become forests task by task. What is left is joined in one task while it is counted
    to be small; beyond, every id hangs its larger neighbours on its smallest one, then itself
    and its smaller ones on the smallest, turn by turn, until nothing changes: some rounds
    more than the logarithm of the longest path.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    form = f"a {kind}, b {kind}"
    left = materialise(pairs.select("a", "b").mapInArrow(_joined, form), "forest")
    mark = None
    while True:
        now = left.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now.n <= TASK_PAIRS:
            left = left.repartition(1).mapInArrow(_joined, form)
            break
        if now == mark:
            break
        mark = now
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("v")).filter("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        was, left = left, materialise(small, "forest")
        discard(was)
    ids = left.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return ids.unionByName(left.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs by component, a, b -> each id that a representative takes: one pass, an id's smaller neighbours before its own."""
    component, taken = None, set()
    for batch in batches:
        ids, reps = [], []
        for c, x, y in zip(*(batch.column(n).to_pylist() for n in ("component", "a", "b"))):
            if c != component:
                component, taken = c, set()
            if x not in taken and y not in taken:
                taken.add(y)
                ids.append(y)
                reps.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("b").type), pa.array(reps, batch.column("a").type)], names=["id", "rep"])


def _by_ranges(pairs: DataFrame, total: int, form: str) -> DataFrame:
    """id, rep of the taken ids of components of any size: the ids in ranges, one after the other.

    Ranges are cut so that about TASK_PAIRS pairs end in each; a range's own pairs go through
    one ordered pass in one task, the pairs of its representatives with later ids are taken
    by a shuffle. So there are as many rounds as total / TASK_PAIRS, however long a chain is.
    """
    ranges = -(-total // TASK_PAIRS)
    cuts = pairs.agg(F.percentile_approx("b", F.array(*(F.lit(k / ranges) for k in range(1, ranges))), F.lit(100_000))).first()[0] if ranges > 1 else []
    bounds = [None, *sorted(set(cuts)), None]
    taken: list[DataFrame] = []
    for low, high in zip(bounds, bounds[1:]):
        inside = lambda c: (F.col(c) > low if low is not None else F.lit(True)) & (F.col(c) <= high if high is not None else F.lit(True))  # noqa: E731, B023
        gone = reduce(DataFrame.unionByName, taken).select("id") if taken else None
        live = pairs.filter(inside("a"))
        if gone is not None:
            live = live.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        live = materialise(live.select("component", "a", "b"), "live")
        one = live.filter(inside("b")).repartition(1).sortWithinPartitions("component", "a", "b")
        inner = materialise(one.mapInArrow(_ordered, form), "taken")
        free = live.filter(~inside("b")).join(inner.select(F.col("id").alias("a")), "a", "left_anti")
        outer = materialise(free.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("rep")), "taken")
        taken += [inner, outer]
        discard(live)
    return reduce(DataFrame.unionByName, taken)


def greedy_groups(pairs: DataFrame) -> DataFrame:
    """id, rep of all ids that a smaller one takes, in id order: an id that none took takes all free later ones near it.

    pairs: a < b, distinct, read several times, so best written. Components do not touch each
    other. Those of up to TASK_PAIRS pairs go through an ordered pass, many in a task; larger
    ones range by range. Neither needs a round for each link of a chain.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    form = f"id {kind}, rep {kind}"
    total = pairs.count()
    if total <= TASK_PAIRS:
        return pairs.withColumn("component", F.lit(0)).repartition(1).sortWithinPartitions("a", "b").mapInArrow(_ordered, form)
    named = components(pairs).select(F.col("id").alias("a"), "component")
    rows = materialise(pairs.join(named, "a"), "components")
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"))
    large = materialise(sizes.filter(F.col("n") > TASK_PAIRS), "large")
    small = rows.join(large, "component", "left_anti").repartition("component").sortWithinPartitions("component", "a", "b").mapInArrow(_ordered, form)
    beyond = large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not beyond:
        return small
    return small.unionByName(_by_ranges(materialise(rows.join(large.select("component"), "component", "left_semi"), "large-pairs"), beyond, form))


def near_duplicates(videos: DataFrame, near: int = NEAR) -> DataFrame:
    """Greedy groups in id order: an id that no earlier representative took represents all later free ids near it.

    Members of exact groups take no part, nor do malformed hashes. Equal hashes are one node,
    whose smallest id stands for all.
    """
    # an id whose file hash no other id has is a row of its group alone
    alone = videos.filter("file_hash is not null").groupBy("file_hash").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min_by("phash", "id").alias("phash"))
    rest = alone.filter("id = last").select("id", "phash").unionByName(videos.filter("file_hash is null").select("id", "phash"))
    rest = materialise(rest.select("id", hash_words(F.col("phash")).alias("w")).filter("w is not null"), "hashes")
    nodes = materialise(rest.groupBy("w").agg(F.min("id").alias("node")), "nodes")
    pairs = materialise(_node_pairs(nodes, near).select(F.col("na").alias("a"), F.col("nb").alias("b")), "pairs")
    taken = greedy_groups(pairs).select(F.col("id").alias("node"), "rep")
    rows = rest.join(nodes, "w").join(taken, "node", "left").select("id", F.coalesce("rep", "node").alias("representative"))
    return rows.filter("id <> representative").select("representative", F.col("id").alias("duplicate"), F.lit("perceptual").alias("match_type"))


def duplicate_groups(videos: DataFrame) -> DataFrame:
    return exact_duplicates(videos).unionByName(near_duplicates(videos))
