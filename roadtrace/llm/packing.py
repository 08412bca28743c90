"""Lexical retrieval packing: windows of tokens filled with lexically near documents.

Documents become token ids once. They are dealt into shards of a few million tokens by a
lexical key: the two nearest centroids of their weighted terms along the main axes of a
sample's terms, then a minwise term under weights of the whole corpus. Centroids are numbered
along a chain of nearest ones, so that a shard's are near each other, and a key's documents
are cut into as many shards as they fill. Each shard has one BM25 index over its token ids.
A seed document is laid into the open window; the index returns its nearest unused
neighbours, which fill what is left: the best one that fits whole, else the best one, whose
rest opens the next window as the new seed. Once all returned ones are used, the index is
asked again. Where an order is given, shards are stretches of that order instead. Only the
last window of a task is left short.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.llm.textblocks import blocks, mix
from roadtrace.llm.tokens import Encoder, largest_id
from roadtrace.session import materialise

END = 0
K1, B = 1.2, 0.75
#: Tokens of a shard: what one index covers. A task takes this many shards on average, more where there would be over TASKS tasks.
SHARD_TOKENS, TASK_SHARDS, TASKS = 2_000_000, 1, 32_768
#: Axes of the vectors that centroids are taken of, centroids, and what both are fitted on: so many documents at most (the first by a hash of doc_id), of so many bytes of terms.
DIMENSIONS, CENTROIDS, FIT, FIT_BYTES = 64, 1024, 8192, 64 << 20
#: A query walks the postings of all its terms, up to this many times the shard's documents; beyond, a term of more than one in COMMON documents is a row of all of them instead. Both find the same.
QUERY_POSTINGS, COMMON = 8, 8
#: Neighbours that one query returns.
NEIGHBOURS = 12

KEYS = ["centroid", "second", "term"]
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, Encoder] = {}


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some spans one after the other, and the span of each."""
    size = hi - lo
    own = np.repeat(np.arange(len(size)), size)
    return np.arange(len(own)) + (lo - np.cumsum(size) + size)[own], own


class Bm25:
    """An inverted index over a shard: postings sorted by term, weighted once."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        n = len(first) - 1
        lengths = np.diff(first)
        small = int(ids.max(initial=0)) < 65536
        order = np.argsort(ids.astype(np.uint16) if small else ids, kind="stable")
        term = ids[order]
        doc = np.repeat(np.arange(n, dtype=np.int32), lengths)[order]
        run = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else np.zeros(0, np.int64)
        tf = np.diff(np.append(run, len(term))).astype(np.float32)
        self.doc, term = doc[run], term[run]
        edge = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        df = np.diff(np.append(edge, len(term)))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
        long = (K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))).astype(np.float32)
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + long[self.doc])
        self.lo = edge
        self.hi = edge + df
        own = np.repeat(np.arange(len(edge), dtype=np.int32), df)
        alone = np.repeat(df == 1, df)  # a term of one document finds no other
        by_doc = np.argsort(self.doc[~alone].astype(np.uint16) if n < 65536 else self.doc[~alone], kind="stable")
        self.term_of = own[~alone][by_doc]
        self.weight_of = self.weight[~alone][by_doc]
        self.terms_at = np.searchsorted(self.doc[~alone][by_doc], np.arange(n + 1))
        self.n = n

    @cached_property
    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of each common term in all documents, and each term's row there, or -1."""
        some = np.flatnonzero((self.hi - self.lo) * COMMON > self.n)
        row = np.full(len(self.lo), -1)
        row[some] = np.arange(len(some))
        weights = np.zeros((len(some), self.n), np.float32)
        for i, t in enumerate(some):
            weights[i, self.doc[self.lo[t] : self.hi[t]]] = self.weight[self.lo[t] : self.hi[t]]
        return weights, row

    def _walked(self, term: np.ndarray) -> np.ndarray:
        """Each document's score for some terms, by their postings."""
        at, _ = _spans(self.lo[term], self.hi[term])
        return np.bincount(self.doc[at], self.weight[at], self.n)

    def _again(self, docs: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The same for some documents only, by their own terms: added up in the same order, so equal to the last bit."""
        at, own = _spans(self.terms_at[docs], self.terms_at[docs + 1])
        asked = np.zeros(len(self.lo), bool)
        asked[term] = True
        return np.bincount(own, self.weight_of[at] * asked[self.term_of[at]], len(docs))

    def near(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The best unused documents for all terms of a seed, best first; ties go to the earlier one."""
        term = self.term_of[self.terms_at[seed] : self.terms_at[seed + 1]]
        rounded = (self.hi[term] - self.lo[term]).sum() > QUERY_POSTINGS * self.n
        if rounded:
            weights, row = self.common
            held = np.zeros(len(weights), np.float32)
            held[row[term][row[term] >= 0]] = 1
            score = (self._walked(term[row[term] < 0]) + held @ weights) * unused
            # no sum of as many positive floats is off by more
            off = float(score.max()) * len(weights) * 2.0**-22
        else:
            score, off = self._walked(term) * unused, 0.0
        last = np.partition(score, -NEIGHBOURS)[-NEIGHBOURS] - off if self.n > NEIGHBOURS else 0.0
        best = np.flatnonzero((score >= last) & (score > 0))
        exact = self._again(best, term) if rounded else score[best]
        return best[np.lexsort((best, -exact))][:NEIGHBOURS]


class _Window:
    """The open window of a task, and the pieces laid so far."""

    def __init__(self, size: int, sequence: int):
        self.size, self.room, self.sequence = size, size, sequence
        self.pieces: list[tuple[int, int, int, int, int]] = []

    def lay(self, doc: int, tokens: int) -> None:
        at = 0
        while at < tokens:
            take = min(self.room, tokens - at)
            self.pieces.append((doc, at, take, self.sequence, self.size - self.room))
            at += take
            self.room -= take
            if not self.room:
                self.room, self.sequence = self.size, self.sequence + 1


def _fill(window: _Window, ids: np.ndarray, first: np.ndarray) -> None:
    """Lay all documents of a shard."""
    index, lengths = Bm25(ids, first), np.diff(first)
    unused = np.ones(index.n, bool)
    sizes = lengths.tolist()
    ahead = 0
    while True:
        while ahead < index.n and not unused[ahead]:
            ahead += 1
        if ahead == index.n:
            return
        seed = ahead
        unused[seed] = False
        window.lay(seed, sizes[seed])
        while window.room < window.size:
            found = index.near(seed, unused)
            if not len(found):
                break
            cut = False
            for doc in found.tolist():
                if sizes[doc] <= window.room:
                    unused[doc] = False
                    window.lay(doc, sizes[doc])
                    if window.room == window.size:
                        break
            else:
                left = found[unused[found]]
                if len(left):
                    seed, cut = int(left[0]), True
                    unused[seed] = False
                    window.lay(seed, sizes[seed])
            if not cut and window.room == window.size:
                break


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, order: list[str], width: str) -> Iterator[pa.RecordBatch]:
    """doc_id, ids with the closing 0, their number, the distinct terms, and the columns of the order."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    encoder = _encoders[tokenizer]

    def binary(flat: np.ndarray, at: np.ndarray) -> pa.Array:
        numbers = np.ascontiguousarray(flat, width)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * numbers.itemsize), pa.py_buffer(numbers)]).cast(pa.binary())

    for batch in batches:
        for b in blocks(batch.column("text")):
            ids, at = encoder.ids(b)
            whole = np.insert(ids, at[1:], END)
            at = at + np.arange(len(at))
            doc = np.repeat(np.arange(b.n, dtype=np.uint64), np.diff(at))
            pair = np.unique(doc << np.uint64(32) | whole)
            terms_at = np.searchsorted(pair, np.arange(b.n + 1, dtype=np.uint64) << np.uint64(32))
            cols = [batch.column("doc_id").slice(b.first, b.n), binary(whole, at), pa.array(np.diff(at)), binary(pair & np.uint64(0xFFFFFFFF), terms_at)]
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(c).slice(b.first, b.n) for c in order)], names=["doc_id", "ids", "n", "terms", *order])
    encoder.forget()  # an idle worker should not hold a table of pieces
    pa.default_memory_pool().release_unused()


def _numbers(column: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column in one array, and where each row's begin."""
    column = column.cast(pa.large_binary())
    _, offset_buf, data_buf = column.buffers()
    at = np.frombuffer(offset_buf, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data_buf, np.uint8)[at[0] : at[-1]].view(width) if data_buf is not None else np.zeros(0, width)
    return flat, (at - at[0]) // flat.itemsize


def _frequencies(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    counts, docs, tokens = np.zeros(0, np.int64), 0, 0
    for batch in batches:
        got = np.bincount(_numbers(batch.column("terms"), width)[0])
        if len(got) > len(counts):
            counts = np.concatenate([counts, np.zeros(len(got) - len(counts), np.int64)])
        counts[: len(got)] += got
        docs += batch.num_rows
        tokens += int(batch.column("n").to_numpy(zero_copy_only=False).sum())
    own = np.flatnonzero(counts)
    # two rows for the totals
    yield pa.RecordBatch.from_arrays([pa.array(np.append(own, [-1, -2])), pa.array(np.append(counts[own], [docs, tokens]))], names=["term", "df"])


class LexicalKeys:
    """Axes, centroids and minwise terms under the weights of a corpus: arrays of the vocabulary's size."""

    def __init__(self, df: np.ndarray, docs: int):
        term = np.arange(len(df), dtype=np.uint64)
        # A term of one document finds no other.
        self.idf = np.where(df > 1, np.log(1 + (docs - df + 0.5) / (df + 0.5)), 0).astype(np.float32)
        u = (mix(term + np.uint64(1 << 40)) >> np.uint64(11)).astype(np.float64) / 2**53
        self.draw = (-np.log(np.maximum(u, 1e-300)) / np.maximum(self.idf, 1e-9)).astype(np.float32)
        self.axes = np.zeros((len(df), 1), np.float32)
        self.centroids = np.zeros((1, 1), np.float32)

    def _summed(self, terms: np.ndarray, at: np.ndarray, axes: np.ndarray) -> np.ndarray:
        """The sum of the axes' rows over each document's terms; a document always has the closing term."""
        out = np.zeros((len(at) - 1, axes.shape[1]), np.float32)
        for i in range(0, len(out), 64):
            lo, hi = at[i], at[min(i + 64, len(out))]
            out[i : i + 64] = np.add.reduceat(axes[terms[lo:hi]], at[i : min(i + 64, len(out))] - lo)
        return out

    def vectors(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each document's weighted terms along the axes, of length 1."""
        out = self._summed(terms, at, self.axes)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def fit(self, terms: np.ndarray, at: np.ndarray) -> None:
        """Axes and centroids of a sample, whose documents come in the order of a hash.

        The axes are the main right singular vectors of its documents' weighted terms, by two
        rounds of subspace iteration. The first one is what all documents share, and left out.
        """
        n = len(at) - 1
        rank = min(DIMENSIONS + 1, n)
        if rank < 2:
            return
        norm = np.sqrt(np.add.reduceat(self.idf[terms].astype(np.float64) ** 2, at[:-1]))
        scale = (1 / np.maximum(norm, 1e-9)).astype(np.float32)[:, None]
        by_term = np.argsort(terms, kind="stable")
        doc = np.repeat(np.arange(n), np.diff(at))[by_term]
        held, first = np.unique(terms[by_term], return_index=True)
        edge = np.append(first, len(terms))
        axes = np.random.default_rng(0).standard_normal((len(self.idf), rank)).astype(np.float32)
        for _ in range(2):
            along = np.linalg.qr(self._summed(terms, at, axes * self.idf[:, None]) * scale)[0] * scale
            gram = np.zeros((len(self.idf), rank), np.float32)
            for i in range(0, len(held), 256):
                lo, hi = edge[i], edge[min(i + 256, len(held))]
                gram[held[i : i + 256]] = np.add.reduceat(along[doc[lo:hi]], edge[i : min(i + 256, len(held))] - lo)
            gram *= self.idf[:, None]
            axes = np.linalg.qr(gram)[0]
        value, turn = np.linalg.eigh(gram.T @ gram)
        value, turn = value[::-1], turn[:, ::-1]
        strong = np.flatnonzero(value[1:] > 1e-6 * value[0]) + 1
        if len(strong):
            self.axes = (gram @ turn[:, strong] / np.sqrt(value[strong]) * self.idf[:, None]).astype(np.float32)
            self._cluster(self.vectors(terms, at))

    def _cluster(self, vectors: np.ndarray) -> None:
        """Spherical k-means from the first vectors, and the centroids along a chain: always the nearest one that is left."""
        c = vectors[: max(1, min(CENTROIDS, len(vectors) // 4))].copy()
        for _ in range(8):
            own = np.argmax(vectors @ c.T, axis=1)
            order = np.argsort(own, kind="stable")
            had, first = np.unique(own[order], return_index=True)
            sums = np.add.reduceat(vectors[order], first)
            c[had] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        chain, left = [0], np.arange(len(c)) > 0
        while left.any():
            chain.append(int(np.argmax(np.where(left, c @ c[chain[-1]], -2))))
            left[chain[-1]] = False
        self.centroids = c[chain]

    def keys(self, terms: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest centroid, second nearest, minwise term) of each document."""
        vectors = self.vectors(terms, at)
        centroid, second = np.zeros((2, len(vectors)), np.int64)
        for i in range(0, len(vectors), 4096):
            near = vectors[i : i + 4096] @ self.centroids.T
            centroid[i : i + 4096] = np.argmax(near, axis=1)
            near[np.arange(len(near)), centroid[i : i + 4096]] = -2
            second[i : i + 4096] = np.argmax(near, axis=1)
        draw = self.draw[terms]
        least = np.minimum.reduceat(draw, at[:-1])
        hit = np.flatnonzero(draw == np.repeat(least, np.diff(at)))
        doc = np.searchsorted(at, hit, "right") - 1
        first = np.unique(doc, return_index=True)[1]
        return centroid, second, terms[hit[first]].astype(np.int64)


def _key(batches: Iterator[pa.RecordBatch], keys: LexicalKeys, width: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = keys.keys(*_numbers(batch.column("terms"), width))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "ids")), *map(pa.array, found)], names=["doc_id", "ids", *KEYS])


def _pack(batches: Iterator[pa.RecordBatch], size: int, width: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    window = _Window(size, TaskContext.get().partitionId() << 40)

    def shard(doc_ids: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
        first = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        ids = np.concatenate(tokens)
        window.pieces = []
        _fill(window, ids, first)
        doc, start, length, sequence, offset = np.array(window.pieces, np.int64).reshape(-1, 5).T
        at = np.concatenate([[0], np.cumsum(length)])
        flat = ids[np.repeat(first[doc] + start - at[:-1], length) + np.arange(at[-1])].astype("<u4")
        owner = pa.array(doc_ids, pa.int64())
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at * 4), pa.py_buffer(flat)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([owner.take(pa.array(doc)), pa.array(start), pa.array(length), values, pa.array(np.diff(first)[doc]), pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    doc_ids, tokens, held = [], [], 0
    for batch in batches:
        flat, at = _numbers(batch.column("ids"), width)
        names = batch.column("doc_id").to_pylist()
        for i, name in enumerate(names):
            doc_ids.append(name)
            tokens.append(flat[at[i] : at[i + 1]].astype(np.uint32))
            held += len(tokens[-1])
            if held >= SHARD_TOKENS:
                yield shard(doc_ids, tokens)
                doc_ids, tokens, held = [], [], 0
    if tokens:
        yield shard(doc_ids, tokens)
    pa.default_memory_pool().release_unused()


def corpus_keys(encoded: DataFrame, width: str) -> tuple[LexicalKeys, int]:
    """The lexical keys of an encoded corpus, and its number of tokens. A row a term of the vocabulary reaches the driver, and the terms of the sample."""
    counts = encoded.select("terms", "n").mapInArrow(partial(_frequencies, width=width), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(max((r.term for r in counts), default=0) + 1, np.int64)
    total = {r.term: r.df for r in counts if r.term < 0}
    for r in counts:
        if r.term >= 0:
            df[r.term] = r.df
    keys = LexicalKeys(df, total.get(-1, 0))
    sample = encoded.select(F.xxhash64("doc_id").alias("place"), "doc_id", "n", "terms").orderBy("place", "doc_id", "n", "terms").limit(FIT)
    before = Window.orderBy("place", "doc_id", "n", "terms").rowsBetween(Window.unboundedPreceding, 0)
    sample = sample.withColumn("bytes", F.sum(F.length("terms")).over(before)).filter(F.col("bytes") <= FIT_BYTES).select("terms").collect()
    if sample:
        keys.fit(*_numbers(pa.array([r.terms for r in sample], pa.binary()), width))
    return keys, total.get(-2, 0)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, order: list[str] | None = None) -> DataFrame:
    """Pieces of all documents, laid gaplessly into windows of at most `window` tokens.

    docs: doc_id long, text string; other columns are ignored but those of order: with it,
    sequence numbers follow the shards and those the order, ties as they come. Every text's
    ids and one id 0 behind them lie in exactly one piece each. Returns doc_id, start (ids of
    the document before the piece), length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset (in the sequence). A null or empty text is its id 0 alone; a text
    longer than a window fills several; one longer than a shard is a shard. Of equally near
    neighbours the earlier one is taken. A repeated row is packed as often as it stands
    there; a null doc_id stays null. No rows give no pieces.
    """
    order = order or []
    width = "<u2" if largest_id(tokenizer) < 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *order)
    kinds = "".join(f", `{c}` {kind}" for c, kind in rows.dtypes[2:])
    encoded = materialise(rows.mapInArrow(partial(_encode, tokenizer=tokenizer, order=order, width=width), f"doc_id long, ids binary, n long, terms binary{kinds}"), "tokens")
    if order:
        total = encoded.agg(F.sum("n")).first()[0] or 0
        laid, by = encoded, [F.col(c) for c in order]
    else:
        keys, total = corpus_keys(encoded, width)
        laid = encoded.select("doc_id", "ids", "terms").mapInArrow(partial(_key, keys=keys, width=width), "doc_id long, ids binary, centroid long, second long, term long")
        # The hash cuts a hot key into shards. Rows that have it in common, too, are equal; their number cuts them.
        laid = laid.withColumn("row", F.monotonically_increasing_id())
        by = [*map(F.col, KEYS), F.xxhash64("doc_id", "ids"), F.col("row")]
    tasks = min(TASKS, -(-total // (TASK_SHARDS * SHARD_TOKENS)))
    laid = laid.repartitionByRange(max(1, tasks), *by).sortWithinPartitions(*by)
    return laid.select("doc_id", "ids").mapInArrow(partial(_pack, size=window, width=width), SCHEMA)
