"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

The index is a table. A task turns some megabytes of documents into a shard: for every term
its documents and counts, in blocks of 128 whose gaps and counts take one, two or four bytes
each, with the extreme (count, size) pairs of every block. These do not depend on the corpus,
so shards can be added at any time; weights and bounds are worked out when it is searched.

A search reads the lists of its queries' terms only, gathers them by groups of shards, and
ranks each group's documents for each query. The lists with the smallest bounds that together
cannot reach the tenth best score are non-essential; documents of the other, essential, lists
are candidates. A candidate that stays below the tenth best score with the block's bound of a
non-essential list leaves before the block is unpacked. The groups' best ten are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadtrace.llm.textblocks import Block, blocks, span_hashes, words
from roadtrace.session import Scratch

#: Bytes of texts in a block of work, in a shard, and terms in a group of shards that one search call ranks.
PART, SHARD_BYTES, GROUP_TERMS = 1 << 20, 1 << 24, 4_000_000
#: Postings of a block.
BLOCK = 128
#: Queries that are searched together, and rows of their terms up to which they are broadcast.
QUERIES, BROADCAST_ROWS = 1000, 200_000
#: Documents whose full scores set the first threshold of a query.
PROBES = 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOWERED = np.full(256, 32, np.uint8)
for _a, _z, _by in ((0x30, 0x3A, 0), (0x41, 0x5B, 32), (0x61, 0x7B, 0), (0x80, 0x100, 0)):
    _LOWERED[_a:_z] = np.arange(_a, _z) + _by
HEAD = np.dtype([("first", "<i4"), ("last", "<i4"), ("n", "<u1"), ("gap_bytes", "<u1"), ("tf_bytes", "<u1"), ("points", "<u1")])
POINT = np.dtype([("tf", "<u4"), ("size", "<u4")])
INDEX = "shard long, term string, df long, heads binary, points binary, body binary, ids array<long>, sizes array<long>"
_SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("heads", pa.binary()), ("points", pa.binary()), ("body", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


# -- building ------------------------------------------------------------------------------------


class Shard:
    """Documents that are gathered until they are written as one shard."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.term, self.doc, self.tf, self.sizes, self.ids = [], [], [], [], []
        self.bytes = self.docs = 0

    def add(self, b: Block, ids: pa.Array) -> None:
        low = Block(b.first, _LOWERED[b.data], b.offsets)
        w = words(low)
        count = np.diff(w.first)
        self.bytes += len(b.data)
        if not len(w.start):
            return
        _, one, term = np.unique(span_hashes(low.data, w.start, w.end), return_index=True, return_inverse=True)
        size, raw = w.end - w.start, low.data.tobytes()
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        alike = np.array_equal(size[one][term], size) and np.array_equal(low.data[np.repeat(w.start, size) + inner], low.data[np.repeat(w.start[one][term], size) + inner])
        if not alike:  # two terms with one hash
            one, term = np.arange(len(w.start)), np.arange(len(w.start))
        known = self.number
        own = np.fromiter((known.setdefault(raw[s:e], len(known)) for s, e in zip(w.start[one].tolist(), w.end[one].tolist())), np.int64, len(one))
        # Only documents with terms are numbered.
        place = self.docs + np.cumsum(count > 0) - 1
        pairs, tf = np.unique(own[term] << 32 | place[w.doc], return_counts=True)
        self.term.append(pairs >> 32)
        self.doc.append(pairs & 0xFFFFFFFF)
        self.tf.append(tf)
        self.sizes.append(count[count > 0])
        self.ids.append(ids.filter(pa.array(count > 0)))
        self.docs += int((count > 0).sum())

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """A row for each term, by term, behind one without a term that has the documents' ids and sizes."""
        if not self.docs:
            return
        sizes = np.concatenate(self.sizes)
        ids = pa.chunked_array(self.ids).combine_chunks()
        docs = [pa.array([x], t) for x, t in zip([shard, "", self.docs, None, None, None], _SCHEMA.types)]
        ends = pa.array([0, self.docs], pa.int32())
        yield pa.RecordBatch.from_arrays([*docs, pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, pa.array(sizes))], schema=_SCHEMA)
        names = sorted(self.number)
        rank = np.empty(len(names), np.int64)
        rank[[self.number[n] for n in names]] = np.arange(len(names))
        term, doc, tf = rank[np.concatenate(self.term)], np.concatenate(self.doc), np.concatenate(self.tf)
        order = np.lexsort((doc, term))
        heads, points, body, first, list_bytes, list_points = packed(term[order], doc[order], tf[order], sizes)
        lists = len(names)

        def binary(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), lists, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw.tobytes())])

        none = pa.nulls(lists, pa.list_(pa.int64()))
        cols = [np.full(lists, shard), names, np.bincount(term, minlength=lists)]
        arrays = [pa.array(cols[0]), pa.array(cols[1], pa.binary()).cast(pa.string()), pa.array(cols[2]), binary(heads, first * HEAD.itemsize), binary(points, list_points * POINT.itemsize), binary(body, list_bytes), none, none]
        whole = pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)
        for at in range(0, lists, 20_000):
            yield whole.slice(at, 20_000)


def packed(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings by term and document as blocks: heads, extreme points and bytes, and where each term's begin in the three."""
    n = len(term)
    new = np.append(True, term[1:] != term[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    begin = np.flatnonzero((np.arange(n) - head) % BLOCK == 0)
    length = np.diff(np.append(begin, n))
    block = np.repeat(np.arange(len(begin)), length)
    inside = np.arange(n) - begin[block]
    gap = np.diff(doc, prepend=0)
    gap[begin] = 0
    out = np.zeros(len(begin), HEAD)
    out["first"], out["last"], out["n"] = doc[begin], doc[begin + length - 1], length
    wide = lambda x: np.where(x < 1 << 8, 1, np.where(x < 1 << 16, 2, 4))
    gaps, tfs = wide(np.maximum.reduceat(gap, begin)), wide(np.maximum.reduceat(tf, begin))
    out["gap_bytes"], out["tf_bytes"] = gaps, tfs
    offset = np.concatenate([[0], np.cumsum(length * (gaps + tfs))])
    body = np.zeros(offset[-1], np.uint8)
    for values, width, base in ((gap, gaps[block], offset[block] + inside * gaps[block]), (tf, tfs[block], offset[block] + length[block] * gaps[block] + inside * tfs[block])):
        for k in range(4):
            has = width > k
            body[base[has] + k] = values[has] >> (8 * k) & 255
    # Of the counts in each power of two the largest, with the smallest size of a document.
    level = np.frexp(tf)[1]
    by = np.lexsort((level, block))
    key = block[by] * 64 + level[by]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    points = np.zeros(len(at), POINT)
    points["tf"], points["size"] = np.maximum.reduceat(tf[by], at), np.minimum.reduceat(sizes[doc][by], at)
    out["points"] = np.bincount(key[at] // 64, minlength=len(begin))
    first = np.searchsorted(term[begin], np.arange(term[-1] + 2))
    point_ends = np.concatenate([[0], np.cumsum(out["points"])])
    return out, points, body, first, offset[first], point_ends[first]


def _built(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    shard, number = Shard(), TaskContext.get().partitionId() << 32
    for batch in batches:
        for b in blocks(batch.column("text"), PART):
            shard.add(b, batch.column("doc_id").slice(b.first, b.n))
            if shard.bytes >= shard_bytes:
                yield from shard.rows(number)
                shard, number = Shard(), number + 1
    yield from shard.rows(number)


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of an index of docs, to be written as a table: INDEX.

    docs: doc_id long, text string; other columns are ignored. Terms are the maximal matches of
    TERM in whole texts, A-Z lower-cased. A document without terms, with a null text too, is not
    in the index; repeated rows and ids are documents of their own, a null doc_id stays null, and
    no rows give none. Each task writes shards of its own documents, about shard_bytes of text
    each; nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_built, shard_bytes=shard_bytes), INDEX)


# -- searching -----------------------------------------------------------------------------------


class Group:
    """The lists of some terms over some shards, and their documents.

    unpacked counts the blocks that were unpacked.
    """

    def __init__(self, rows: pa.Table, n_docs: int, n_terms: int):
        rows = rows.sort_by([("term", "ascending"), ("shard", "ascending")])
        term, shard = rows.column("term").to_pylist(), rows.column("shard").to_pylist()
        docs = [k for k, t in enumerate(term) if not t]
        sizes = [rows.column("sizes")[k].values.to_numpy(zero_copy_only=False) for k in docs]
        self.ids = pa.chunked_array([rows.column("ids")[k].values for k in docs], pa.int64()).combine_chunks()
        size = np.concatenate([np.zeros(0, np.int64), *sizes])
        base = dict(zip((shard[k] for k in docs), np.concatenate([[0], np.cumsum([len(x) for x in sizes])]).tolist()))
        self.n = len(size)
        self.pace = lambda s: 8 * (10 + 90 * s * n_docs // n_terms)
        self.slow = self.pace(size)
        lists = rows.slice(len(docs))
        heads = [x.as_buffer() for x in lists.column("heads")]
        count = np.array([len(h) // HEAD.itemsize for h in heads], np.int64)
        head = np.frombuffer(b"".join(heads), HEAD)
        move = np.repeat(np.array([base[s] for s in shard[len(docs) :]], np.int64), count)
        self.first, self.last, self.length = head["first"] + move, head["last"] + move, head["n"].astype(np.int64)
        self.gap, self.tf = head["gap_bytes"].astype(np.int64), head["tf_bytes"].astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length * (self.gap + self.tf))])
        self.body = np.frombuffer(b"".join(x.as_buffer() for x in lists.column("body")), np.uint8)
        point = np.frombuffer(b"".join(x.as_buffer() for x in lists.column("points")), POINT)
        weight = np.array(lists.column("weight").to_pylist(), np.int64)
        self.weight = np.repeat(weight, count)
        best = self.impact(point["tf"].astype(np.int64), self.pace(point["size"].astype(np.int64)))
        starts = np.concatenate([[0], np.cumsum(head["points"], dtype=np.int64)])[:-1]
        self.most = self.weight * np.maximum.reduceat(best, starts) if len(best) else best
        names = term[len(docs) :]
        ends = np.cumsum(count)
        new = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
        self.lists = {}
        self.items: dict = {}
        for k, stop in zip(new, [*new[1:], len(names)]):
            lo, hi = int(ends[k] - count[k]), int(ends[stop - 1])
            self.lists[names[k]] = (lo, hi, int(self.most[lo:hi].max()))
            for item in lists.column("items")[k].as_py():
                self.items.setdefault(item["item_id"], []).append(names[k])
        self.whole: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.unpacked = 0

    @staticmethod
    def impact(tf: np.ndarray, slow: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + slow)

    def unpack(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and weighted impacts of blocks."""
        self.unpacked += len(which)
        length = self.length[which]
        ends = np.cumsum(length)
        begin = ends - length
        inside = np.arange(ends[-1]) - np.repeat(begin, length)
        gap, tf, offset = self.gap[which], self.tf[which], self.offset[which]
        each = [np.repeat(x, length) for x in (gap, tf, offset, offset + length * gap)]
        values = []
        for width, at in ((each[0], each[2] + inside * each[0]), (each[1], each[3] + inside * each[1])):
            v = self.body[at].astype(np.int64)
            for k in (1, 2, 3):
                has = width > k
                v[has] |= self.body[at[has] + k].astype(np.int64) << (8 * k)
            values.append(v)
        run = np.cumsum(values[0])
        doc = np.repeat(self.first[which] - run[begin], length) + run
        return doc, np.repeat(self.weight[which], length) * self.impact(values[1], self.slow[doc])

    def all_of(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.whole:
            lo, hi, _ = self.lists[term]
            self.whole[term] = self.unpack(np.arange(lo, hi))
        return self.whole[term]

    def add(self, term: str, docs: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        """Add a list's impacts to the scores of documents (in order), which stand in the blocks at."""
        found, more = self.unpack(np.unique(at)) if term not in self.whole else self.whole[term]
        k = np.minimum(np.searchsorted(found, docs), len(found) - 1)
        hit = found[k] == docs
        score[docs[hit]] += more[k[hit]]

    def block_of(self, term: str, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block in which each document would stand, and whether there is one."""
        lo, hi, _ = self.lists[term]
        at = lo + np.searchsorted(self.last[lo:hi], docs)
        there = at < hi
        at = np.minimum(at, hi - 1)
        return at, there & (self.first[at] <= docs)

    def best(self, terms: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents (numbers in the group) with a score above 0, by score, then id; and their scores."""
        terms = sorted(terms, key=lambda t: self.lists[t][2])
        bound = np.concatenate([[0], np.cumsum([self.lists[t][2] for t in terms])])
        least = self._first_threshold(terms, k)
        essential = int(np.searchsorted(bound[1:], least))  # lists before have bounds that sum to less
        score = np.zeros(self.n, np.int64)
        for t in terms[essential:]:
            docs, more = self.all_of(t)
            score[docs] += more
        docs = np.flatnonzero(score)
        for j in range(essential - 1, -1, -1):
            if len(docs) > k:
                least = max(least, int(np.partition(score[docs], len(docs) - k)[len(docs) - k]))
            docs = docs[score[docs] + bound[j + 1] >= least]
            at, there = self.block_of(terms[j], docs)
            stay = score[docs] + np.where(there, self.most[at], 0) + bound[j] >= least
            docs, at, there = docs[stay], at[stay], there[stay]
            if there.any():
                self.add(terms[j], docs[there], at[there], score)
        return self._ranked(docs, score[docs], k)

    def _first_threshold(self, terms: list[str], k: int) -> int:
        """A score that k documents reach: those that the lists with the largest bounds suggest."""
        score, docs = np.zeros(self.n, np.int64), np.zeros(0, np.int64)
        left = list(terms)
        while left and len(docs) < k:
            more = self.all_of(left.pop())
            score[more[0]] += more[1]
            docs = np.flatnonzero(score)
        if len(docs) < k:
            return 1
        docs = np.sort(docs[np.argsort(-score[docs], kind="stable")[:PROBES]])
        for t in left:
            at, there = self.block_of(t, docs)
            if there.any():
                self.add(t, docs[there], at[there], score)
        return max(1, int(np.sort(score[docs])[-k]))

    def _ranked(self, docs: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids = self.ids.take(pa.array(docs))
        order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), -score))[:k]
        return docs[order], score[order]


def _search(rows: pa.Table, n_docs: int, n_terms: int, k: int, item_type: pa.DataType) -> pa.Table:
    group = rows.column("part")[0].as_py()
    g = Group(rows.combine_chunks(), n_docs, n_terms)
    items, docs, scores = [], [], []
    for item, terms in g.items.items():
        d, s = g.best(terms, k)
        items += [item] * len(d)
        docs.append(d)
        scores.append(s)
    found = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    score = np.concatenate(scores) if scores else found
    return pa.table({"part": pa.array([group] * len(items), pa.int64()), "item_id": pa.array(items, item_type), "doc_id": g.ids.take(pa.array(found)), "score": pa.array(score)})


def query_terms(items: DataFrame) -> DataFrame:
    """item_id and each term of its texts once."""
    found = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(TERM), 0)
    return items.select("item_id", F.explode(F.array_distinct(found)).alias("term")).distinct()


def term_weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * df + 1).cast("double"))).cast("long")


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of an index, with a score above 0, for each item.

    index: the rows of build_index, best written as a table. items: item_id, text. Over the
    index N documents have L terms; a document of n terms has m = 10 + 90 n N div L. The score is
    the sum, over an item's terms, each once, of floor(1000 ln((2 N + 2) / (2 df + 1))) times (10**9
    tf) div (1000 tf + 8 m). Equal scores stand by ascending doc_id, null last; a document with
    the same score and id as another is still one of its own. Rows of one item_id are one item,
    a null item_id too; an item without terms, or whose terms are in no document, has no rows; an
    empty index gives none. Texts of any length count whole. Temporary tables go when the
    application ends.

    Lists of other terms are not read. Terms of items are broadcast where they are counted to be
    few; a group of shards and a block of items meet in one task, and each yields k rows an item.
    """
    scratch = Scratch()
    total = index.filter("term = ''").agg(F.sum("df").alias("docs"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms")).first()
    n_docs, n_terms = total.docs or 0, total.terms or 0
    asked = scratch.write(query_terms(items), "query-terms")
    size = asked.agg(F.count("*").alias("rows"), F.count_distinct("item_id").alias("items")).first()
    few = F.broadcast if size.rows <= BROADCAST_ROWS else (lambda df: df)
    parts = max(1, -(-size["items"] // QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int"))
    held = index.select("term", "df").join(few(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weights = held.select("term", term_weight(F.col("df"), n_docs).alias("weight")).filter("weight > 0")
    lists = asked.join(weights, "term").groupBy("block", "term", "weight").agg(F.collect_list(F.struct("item_id")).alias("items"))
    own = asked.select("block").distinct().select("block", F.lit("").alias("term"), F.lit(0).cast("long").alias("weight"), F.array().cast(lists.schema["items"].dataType).alias("items"))
    wanted = scratch.write(lists.unionByName(own), "query-lists")
    groups = max(1, -(-n_terms // GROUP_TERMS))
    rows = index.drop("df").join(few(wanted), "term").withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("long"))
    item_type = items.schema["item_id"].dataType.simpleString()
    arrow_type = pa.schema([("x", pa.int64() if item_type == "bigint" else pa.int32() if item_type == "int" else pa.string())]).types[0]

    def ranked_group(rows: pa.Table) -> pa.Table:
        return _search(rows, n_docs, max(1, n_terms), k, arrow_type)

    found = rows.groupBy("part", "block").applyInArrow(ranked_group, f"part long, item_id {item_type}, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    spread = max(1, round(groups**0.5))
    some = Window.partitionBy("item_id", F.col("part") % spread).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(len(terms)), 0) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) AS x GROUP BY r, term),
asked AS MATERIALIZED (SELECT p.* FROM p JOIN (SELECT DISTINCT term FROM q) AS t USING (term)),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM asked, s GROUP BY term, s.n),
scored AS (SELECT q.item_id, d.r, any_value(d.doc_id) AS doc_id, CAST(sum(w.w * ((1000000000 * a.tf) // (1000 * a.tf + 8 * (100 - 90 + ((90 * len(d.terms) * s.n) // s.l))))) AS BIGINT) AS score
  FROM q JOIN asked AS a USING (term) JOIN w USING (term) JOIN d ON d.r = a.r, s GROUP BY q.item_id, d.r),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
