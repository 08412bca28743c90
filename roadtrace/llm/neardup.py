"""Near-duplicate documents by a Chosen-Path set similarity join on word shingles.

A document's set holds its distinct n-word shingles. Equal sets form a class, and only
one sketch per class goes on. The sketch is a fixed number of minwise tokens. Each of
several independent trees starts with all classes in its root; a node chooses one or two
sketch coordinates (1 / threshold on average) by a hash of its path, and its members
branch by the minwise token they have there. Nodes that are small enough stop: their
members are compared exhaustively on sketches. In a larger node all members are held
against one of them, the pivot: those far more alike than chance are proposed with it, and
those about as near as the threshold leave the node, for by the triangle inequality of
Jaccard distances whatever they link with was proposed with the pivot too. Nodes still
large at the last depth share so many tokens that they count as one candidate group unseen.

Sketch comparisons only propose groups, several standard deviations below the threshold.
The proposals' components are then examined on full sets, in blocks of bounded size: a
block's exact components leave their smallest members, which meet in blocks again until few
are left. What lies outside a group's largest component then is held against all blocks,
first by sketches, and by full sets where sketches look alike. Hence no task holds a group,
no pair is emitted within a group of copies, and only links between different sets whose
sketches lie several deviations apart are lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.components import connected_components
from roadtrace.session import Scratch, materialise
from roadtrace.llm.textblocks import Block, blocks, mix, span_hashes, window_hashes, words

COORDINATES = 128
_rng = np.random.Generator(np.random.PCG64(77))
_MUL = (_rng.integers(1, 2**32, COORDINATES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint64).astype(np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Classes in a node that are compared exhaustively.
LEAF = 128
#: Levels below the root; a node that is still large there shares this many minwise tokens and one more.
DEPTH = 3
#: Shingles of the sets in one block of exact comparison on average, and the members below which a group is not cut.
BLOCK_SHINGLES, BLOCK_MEMBERS = 32_000, 16
#: Sketches on either side of one comparison between blocks.
BLOCK_SKETCHES = 16_384
#: Proposed documents whose ids are broadcast at most; beyond, the join shuffles.
BROADCAST_IDS = 200_000


def shingle_sets(b: Block, n: int) -> Iterator[np.ndarray]:
    """For each text of a block, the sorted distinct hashes of its n-word shingles."""
    data = _LOWER[b.data]
    w = words(b)
    hashes = span_hashes(data, w.start, w.end)
    shingles = window_hashes(hashes, n)
    for i in range(b.n):
        lo, hi = w.first[i], w.first[i + 1]
        if hi - lo >= n:
            yield np.unique(shingles[lo : hi - n + 1])
        elif hi > lo:
            yield mix(window_hashes(hashes[lo:hi], hi - lo) + np.uint64(hi - lo))
        else:
            yield hashes[:0]


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The sketch: for each coordinate the least of the shingles' values under its own hash."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        out = np.minimum(out, ((x[None, at : at + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    return out


def _sketches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column("text")):
            count, sid, sketch, marks = [], [], [], []
            raw = b.data.tobytes()
            tid = [hashlib.md5(raw[i:j]).digest() for i, j in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist())]
            for s in shingle_sets(b, n):
                count.append(len(s))
                sid.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = minwise(s)
                sketch.append(m)
                marks.append(m.astype(np.uint8).tobytes())
            flat = np.concatenate(sketch).view(np.int32)
            offsets = np.arange(0, len(flat) + 1, COORDINATES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(b.first, b.n), pa.array(tid, pa.binary()), pa.array(count, pa.int64()), pa.array(sid, pa.binary()), pa.ListArray.from_arrays(offsets, flat), pa.array(marks, pa.binary())],
                names=["doc_id", "tid", "n_shingles", "sid", "sketch", "marks"],
            )
    pa.default_memory_pool().release_unused()


def _children(path: Column, sketch: Column, threshold: float) -> Column:
    """The child nodes of a member: one or two chosen coordinates, 1 / threshold on average."""
    second = F.pmod(F.xxhash64(path, F.lit(2)), F.lit(1_000_000)) < F.lit(int((1 / threshold - 1) * 1_000_000))

    def child(k: int) -> Column:
        at = F.pmod(F.xxhash64(path, F.lit(10 + k)), F.lit(COORDINATES)).cast("int")
        return F.xxhash64(path, at, F.get(sketch, at))

    return F.when(second, F.array(child(0), child(1))).otherwise(F.array(child(0)))


def tree_count(threshold: float, recall: float) -> int:
    """Independent trees for the recall of pairs at the threshold that part in three levels."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**3)))


def _joined(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that each of m members reaches over the pairs (a, b)."""
    root = np.arange(m)
    while len(a):
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == was).all():
            break
    return root


def _compare_leaves(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (path, nid, marks) sorted by path: stars over the members whose sketches look alike."""

    def stars(nid: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alike = (marks[:, None, :] == marks[None, :, :]).sum(axis=2, dtype=np.int32) >= least
        a, b = np.nonzero(np.triu(alike, 1))
        root = _joined(len(nid), a, b)
        other = np.flatnonzero(root != np.arange(len(nid)))
        return nid[other], nid[root[other]]

    def out(found: list) -> pa.RecordBatch:
        a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held: tuple | None = None
    for batch in batches:
        path = batch.column("path").to_numpy(zero_copy_only=False)
        nid = batch.column("nid").to_numpy(zero_copy_only=False)
        marks = np.frombuffer(b"".join(batch.column("marks").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        if held is not None:
            path, nid, marks = (np.concatenate([x, y]) for x, y in zip(held, (path, nid, marks)))
        if not len(path):
            continue
        edge = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
        held = (path[edge[-2] :], nid[edge[-2] :], marks[edge[-2] :])
        edge = edge[:-1]
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        same = (marks[two] == marks[two + 1]).sum(axis=1) >= least
        found = [(nid[two + 1][same], nid[two][same])]
        found += [stars(nid[i : i + k], marks[i : i + k]) for i, k in zip(edge[:-1][size > 2], size[size > 2])]
        yield out(found)
    if held is not None and len(held[1]) > 1:
        yield out([stars(held[1], held[2])])


def link(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Exact components of sets: the index of the first member of each one's component.

    Two sets link where 100 * intersection >= percent * union. Each set in turn is held
    against the sets that nothing has reached yet, so a group of copies costs one pass and
    then a small number for each.
    """
    sizes, rows, near = _overlaps(sets, percent)
    root = np.arange(len(sets))
    rest = np.flatnonzero(sizes > 0)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = near(x, rest)
            root[rest[hit]] = root[x]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return root


def _overlaps(sets: list[np.ndarray], percent: int):
    """Sizes of the sets, their token numbers, and near(x, rest): which sets of rest link with set x."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.zeros(0), np.zeros(0, np.int64))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    rows = [ids[starts[i] : starts[i + 1]] for i in range(len(sets))]
    has = np.zeros(len(tokens), bool)
    kept: dict[str, np.ndarray] = {"rest": np.zeros(0, np.int64)}

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        if not np.array_equal(kept["rest"], rest):
            kept.update(rest=rest, flat=np.concatenate([rows[i] for i in rest]), at=np.concatenate([[0], np.cumsum(sizes[rest])])[:-1])
        has[rows[x]] = True
        both = np.add.reduceat(has[kept["flat"]], kept["at"], dtype=np.int64)
        has[rows[x]] = False
        return 100 * both >= percent * (sizes[x] + sizes[rest] - both)

    return sizes, rows, near


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], n: int = 0) -> Iterator[tuple[dict, list[np.ndarray]]]:
    """Whole groups of rows sorted by the keys: their columns (but the text) and, of texts, their n-word shingle sets."""
    held: dict[str, list] = {}
    sets: list[np.ndarray] = []
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "text"}
        own = [s for b in blocks(batch.column("text")) for s in shingle_sets(b, n)] if n else [None] * batch.num_rows
        for i, s in enumerate(own):
            if held and any(held[k][0] != cols[k][i] for k in keys):
                yield held, sets
                held, sets = {}, []
            for c, v in cols.items():
                held.setdefault(c, []).append(v[i])
            sets.append(s)
    if held:
        yield held, sets


def _emit(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def _inside(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Exact components within each (g, block): each member's smallest fellow."""
    for rows, sets in _grouped(batches, ["g", "block"], n):
        nid = np.array(rows["nid"], np.int64)
        order = np.argsort(nid, kind="stable")
        root = link([sets[i] for i in order], percent)
        nid = nid[order]
        yield _emit({"nid": nid, "local": nid[root], "g": rows["g"]})


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Which strays and members of a (g, cell, part) look alike by their marks: each with the block of the other."""
    for rows, _ in _grouped(batches, ["g", "cell", "part"]):
        stray = np.array(rows["stray"], np.int64) == 1
        nid, root, block = (np.array(rows[c], np.int64) for c in ("nid", "root", "block"))
        marks = np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(-1, COORDINATES)
        there, theirs = np.flatnonzero(~stray), marks[~stray]
        found = []
        for x in np.flatnonzero(stray).tolist():
            hit = there[((theirs == marks[x]).sum(axis=1) >= least) & (root[there] != root[x])]
            # (nid, stray, the member's block, the stray's block)
            found.append(np.stack([np.full(len(hit), nid[x]), np.ones(len(hit), np.int64), block[hit], np.full(len(hit), block[x])], 1))
            found.append(np.stack([nid[hit], np.zeros(len(hit), np.int64), block[hit], np.full(len(hit), block[x])], 1))
            if len(found) >= 512:
                found = [np.unique(np.concatenate(found), axis=0)]
        if found:
            out = np.unique(np.concatenate(found), axis=0)
            yield _emit({"nid": out[:, 0], "stray": out[:, 1], "g": np.full(len(out), rows["g"][0]), "block": out[:, 2], "part": out[:, 3]})


def _across(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the strays and the members of a (g, block, part), one for each stray and component."""
    for rows, sets in _grouped(batches, ["g", "block", "part"], n):
        stray = np.array(rows["stray"], np.int64) == 1
        nid, root = np.array(rows["nid"], np.int64), np.array(rows["root"], np.int64)
        there = np.flatnonzero(~stray)
        if not len(there) or stray.sum() == 0:
            continue
        _, _, near = _overlaps(sets, percent)
        a, b = [], []
        for x in np.flatnonzero(stray).tolist():
            hit = there[near(x, there)]
            hit = hit[np.unique(root[hit], return_index=True)[1]]
            a += [int(nid[x])] * len(hit)
            b += nid[hit].tolist()
        yield _emit({"a": a, "b": b})


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("tid"), text.alias("text"))


class _Sets:
    """Texts of classes by their number, for exact comparison."""

    def __init__(self, docs: DataFrame, classes: DataFrame, sk: DataFrame, n: int, scratch: Scratch):
        self.texts, self.n, self.scratch = _texts(docs), n, scratch
        self.names = classes.select("nid", "doc_id", "tid")
        self.repeated = scratch.write(sk.filter("doc_id is not null").groupBy("doc_id", "tid").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id", "tid"), "repeated")
        self.any_repeated = not self.repeated.isEmpty()

    def of(self, rows: DataFrame) -> DataFrame:
        """rows (nid and others, materialised) with the class's text, once each."""
        few = rows.count() <= BROADCAST_IDS
        named = rows.join(self.names, "nid")

        def joined(named: DataFrame) -> DataFrame:
            return self.texts.join(F.broadcast(named) if few else named, ["doc_id", "tid"]).drop("doc_id", "tid")

        if not self.any_repeated:
            return joined(named)
        key = [c for c in rows.columns]
        once = joined(named.join(self.repeated, ["doc_id", "tid"], "left_anti"))
        many = joined(named.join(self.repeated, ["doc_id", "tid"], "left_semi")).groupBy(*key).agg(F.first("text").alias("text"))
        return once.unionByName(many)


def _cut(rows: DataFrame, salt: int) -> DataFrame:
    """rows (nid, g, n_shingles) with the number of blocks of their group, and their block."""
    weight = rows.groupBy("g").agg(F.greatest(F.lit(1), F.least(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.floor(F.count("*") / BLOCK_MEMBERS))).alias("blocks"))
    return rows.join(weight, "g").withColumn("block", F.pmod(F.xxhash64("nid", F.lit(salt)), F.col("blocks")))


def _local(sets: _Sets, cut: DataFrame, percent: int) -> DataFrame:
    """(nid, local, g): exact components inside the blocks."""
    key = ["g", "block"]
    rows = sets.of(cut.select("nid", *key)).repartition(*key).sortWithinPartitions(*key).select("nid", *key, "text")
    return sets.scratch.write(rows.mapInArrow(partial(_inside, n=sets.n, percent=percent), "nid long, local long, g long"), "local")


def _exact_links(sets: _Sets, member: DataFrame, classes: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) that join the exact components of the members (nid, g, n_shingles) of candidate groups."""
    whole = sets.scratch.write(_cut(member, 0), "members")
    local = _local(sets, whole, percent)
    edge = lambda rows: rows.filter("nid <> local").select(F.col("nid").alias("a"), F.col("local").alias("b"))
    links = edge(local)
    large = whole.filter("blocks > 1")
    if large.isEmpty():
        return links
    groups = large.select("g").distinct()
    heads = local.filter("nid = local").join(groups, "g", "left_semi").select("nid", "g").join(member.select("nid", "n_shingles"), "nid")
    heads = sets.scratch.write(_cut(heads, 1), "heads")
    count, salt = heads.count(), 1
    while True:
        met = _local(sets, heads, percent)
        links = links.unionByName(edge(met))
        salt += 1
        left = met.filter("nid = local").select("nid").join(heads.filter("blocks > 1").select("nid", "g", "n_shingles"), "nid")
        left = sets.scratch.write(_cut(left, salt), "heads")
        was, count = count, left.count()
        heads = left
        if not count or count > 0.8 * was:
            break
    roots = connected_components(links)
    mine = large.select("nid", "g", "block").join(roots, F.col("nid") == F.col("node"), "left").select("nid", "g", "block", F.coalesce("root", "nid").alias("root"))
    mine = sets.scratch.write(mine.join(classes.select("nid", "marks"), "nid"), "cut")
    size = mine.groupBy("g", "root").agg(F.count("*").alias("size"))
    main = size.groupBy("g").agg(F.max(F.struct("size", "root")).alias("m"), F.sum("size").alias("all")).select("g", F.col("m.root").alias("main"), F.ceil(F.col("all") / BLOCK_SKETCHES).alias("cells"), F.ceil((F.col("all") - F.col("m.size")) / BLOCK_SKETCHES).alias("parts"))
    mine = mine.join(main, "g").filter("parts > 0")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("nid", F.lit(-1)), F.col(n))
    cols = ["nid", "g", "block", "root", "marks"]
    strays = mine.filter("root <> main").select(*cols, F.lit(1).alias("stray"), spread("cells").alias("cell"), own("parts").alias("part"))
    living = mine.select(*cols, F.lit(0).alias("stray"), own("cells").alias("cell"), spread("parts").alias("part"))
    key = ["g", "cell", "part"]
    alike = strays.unionByName(living).repartition(*key).sortWithinPartitions(*key).mapInArrow(partial(_alike, least=least), "nid long, stray long, g long, block long, part long")
    alike = sets.scratch.write(alike.distinct(), "alike")
    if alike.isEmpty():
        return links
    key = ["g", "block", "part"]
    both = sets.of(sets.scratch.write(alike.join(mine.select("nid", "root"), "nid"), "across")).repartition(*key).sortWithinPartitions(*key)
    return links.unionByName(both.select("nid", "root", "stray", *key, "text").mapInArrow(partial(_across, n=sets.n, percent=percent), "a long, b long"))


def _proposals(classes: DataFrame, threshold: float, least: float, recall: float, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between classes that the trees propose."""
    trees = tree_count(threshold, recall)
    rows = classes.select("nid", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "sketch")
    rows = rows.select("nid", F.explode(_children(F.xxhash64(F.lit("root"), "tree"), F.col("sketch"), threshold)).alias("path"))
    # Sketches err by 0.04 or so; three times that is allowed for a member's distance and for its partners'.
    leave, with_pivot = threshold - 0.02, 2 * threshold - 1 - 0.27
    leaves, stars = [], []
    for depth in range(DEPTH + 1):
        rows = scratch.write(rows, "branches")
        sized = rows.join(rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"), "path")
        sized = scratch.write(sized, "nodes")
        leaves.append(sized.filter(F.col("size") <= LEAF).select("path", "nid"))
        large = sized.filter(F.col("size") > LEAF).select("path", "nid")
        if large.isEmpty():
            break
        if depth == DEPTH:
            stars.append(large.join(large.groupBy("path").agg(F.min("nid").alias("b")), "path").select(F.col("nid").alias("a"), "b"))
            break
        pivot = large.groupBy("path").agg(F.min("nid").alias("pivot")).join(classes.select(F.col("nid").alias("pivot"), F.col("sketch").alias("other")), "pivot")
        equal = F.aggregate(F.zip_with("sketch", "other", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        held = large.join(classes.select("nid", "sketch"), "nid").join(pivot, "path").select("path", "nid", "pivot", (equal / COORDINATES).alias("alike"), "sketch")
        staying = F.when(F.col("alike") < leave, _children(F.col("path"), F.col("sketch"), threshold))
        held = scratch.write(held.select("path", "nid", "pivot", "alike", staying.alias("children")), "held")
        stars.append(held.filter(F.col("alike") >= with_pivot).select(F.col("nid").alias("a"), F.col("pivot").alias("b")))
        rows = held.select("nid", F.explode("children").alias("path")).distinct()
    at_leaves = leaves[0]
    for more in leaves[1:]:
        at_leaves = at_leaves.unionByName(more)
    at_leaves = at_leaves.join(classes.select("nid", "marks"), "nid").select("path", "nid", "marks")
    edges = at_leaves.repartition("path").sortWithinPartitions("path").mapInArrow(partial(_compare_leaves, least=least), "a long, b long")
    for more in stars:
        edges = edges.unionByName(more)
    return edges


def judged_rows(docs: DataFrame, shingle_words: int = 5, percent: int = 80, recall: float = 0.9995) -> DataFrame:
    """A row for every row of docs: doc_id, tid (digest of the text), n_shingles, component_id and best_tid.

    component_id is the smallest doc_id of the row's component, and best_tid the smallest
    digest among the rows of that doc_id there; both are null for rows without doc_id, and
    the row's own for empty sets.
    """
    threshold = percent / 100
    sk = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_sketches, n=shingle_words), "doc_id long, tid binary, n_shingles long, sid binary, sketch array<int>, marks binary")
    sk = materialise(sk, "sketches")
    real = sk.filter("n_shingles > 0 and doc_id is not null")
    # Classes have numbers of their own: a doc_id that stands with several texts is several classes.
    classes = real.groupBy("sid").agg(F.min(F.struct("doc_id", "tid")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("marks").alias("marks"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("nid"), "sid", "first.*", "n_shingles", "sketch", "marks"), "classes")
    margin = 4.5 * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    least = COORDINATES * (threshold - margin)
    scratch = Scratch()
    proposed = connected_components(_proposals(classes, threshold, least, recall, scratch))
    scratch.clear()

    # Full sets of the proposed documents only.
    member = proposed.join(classes.select("nid", "n_shingles"), F.col("node") == F.col("nid")).select("nid", F.col("root").alias("g"), "n_shingles")
    member = scratch.write(member, "proposed")
    roots = connected_components(_exact_links(_Sets(docs, classes, sk, shingle_words, scratch), member, classes, least, percent))
    scratch.clear()
    found = roots.filter("node <> root")

    named = classes.join(found, classes.nid == found.node, "left").select("sid", F.coalesce("root", "nid").alias("root"), F.struct("doc_id", "tid").alias("first"))
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    rep = named.join(best, "root").select("sid", F.col("best.doc_id").alias("best_id"), F.col("best.tid").alias("best_tid"))
    known = F.col("doc_id").isNotNull()
    return sk.select("doc_id", "tid", "n_shingles", F.when(known & (F.col("n_shingles") > 0), F.col("sid")).alias("sid")).join(rep, "sid", "left").select(
        "doc_id", "tid", "n_shingles", F.when(known, F.coalesce("best_id", "doc_id")).alias("component_id"), F.when(known, F.coalesce("best_tid", "tid")).alias("best_tid")
    )


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, recall: float = 0.9995) -> DataFrame:
    """Every document with its near-duplicate component.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id, n_shingles,
    component_id (the smallest doc_id reachable over links, itself included) and kept
    (doc_id = component_id). Two documents link where 100 * intersection size >= percent *
    union size of their sets of shingle_words-word shingles, A-Z lower-cased; at the
    threshold itself they link. A text of fewer words is one shingle. Null or wordless texts
    have an empty set and link with nothing. Texts of any length are taken whole. A repeated
    row is a copy; a doc_id that stands with several texts is several documents, each with
    the component of its text. A null doc_id takes no part: component_id null, kept true. An
    empty table gives an empty result.
    """
    rows = judged_rows(docs, shingle_words, percent, recall)
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("component_id") == F.col("doc_id"))).alias("kept"))


def keep_one_of_each(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row of each component of near_duplicates: its smallest doc_id's, of several texts the one of the smallest digest.

    Only rows that have words and a doc_id can go. Rows equal in doc_id and text are one
    document; the one with the smallest hash over its columns stays.
    """
    rows = judged_rows(docs, shingle_words, percent).filter("doc_id is not null and n_shingles > 0")
    rows = rows.groupBy("doc_id", "tid").agg(F.count("*").alias("copies"), F.bool_or((F.col("doc_id") == F.col("component_id")) & (F.col("tid") == F.col("best_tid"))).alias("stays"))
    decided = materialise(rows.filter("not stays or copies > 1").select(F.col("doc_id").alias("of_doc"), F.col("tid").alias("of_text"), "stays"), "decided")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("of_doc"), F.unhex(F.md5(F.col("text").cast("string"))).alias("of_text"))
    key = ["of_doc", "of_text"]
    small = decided.count() <= BROADCAST_IDS
    alone = keyed.join(F.broadcast(decided) if small else decided, key, "left_anti").select("row.*")
    several = decided.filter("stays")
    if several.isEmpty():
        return alone
    plain = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant", "void")) and "map<" not in kind]
    met = keyed.join(F.broadcast(several) if small else several, key, "left_semi")
    first = met.groupBy(*key).agg(F.min_by("row", F.xxhash64(*(F.col(f"row.{c}") for c in plain))).alias("row"))
    return alone.unionByName(first.select("row.*"))
