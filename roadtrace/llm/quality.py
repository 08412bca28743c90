"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into a fixed number of buckets. One pass counts the
buckets over all documents (the raw corpus) and over the trusted target documents; the
ratio of the two smoothed multinomials is a table of fixed size. A second pass averages
the ratio's logarithm over each document's n-grams and holds it against one threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.textblocks import Block, Words, blocks, mix, per_doc, span_hashes, window_hashes, words

BUCKETS = 1 << 16
#: Labelled documents of good quality that the target is fitted on, at most (the first by a hash of doc_id).
TRUSTED = 20_000
#: Pseudo-counts per bucket on average: the target's shape is drawn to the raw corpus where it says little.
PRIOR = 8.0
#: Documents below this mean log ratio per n-gram are rejected.
THRESHOLD = -0.125

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each item, whether its text holds an equal one before it (1) or after it only (2); 0 if it is single."""
    key = mix(hashes + mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.zeros(len(s), np.int8)
    out[order] = np.where(same[:-1], 1, np.where(same[1:], 2, 0))
    return out


def _dup_lines(b: Block, w: Words) -> np.ndarray:
    breaks = np.flatnonzero(b.data == 10)
    start = np.concatenate([b.offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, b.offsets[1:]])
    # Both in order of position; a line break that ends a text leaves an empty last line.
    start, end = np.sort(start, kind="stable"), np.sort(end, kind="stable")
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[has_word], end[has_word]
    doc = np.searchsorted(b.offsets, start, "right") - 1
    again = _repeated(span_hashes(b.data, start, end), doc) == 1
    return np.bincount(doc[again], minlength=b.n).astype(np.int64)


def _repeat_words(b: Block, w: Words, hashes: np.ndarray, size: int = 8) -> np.ndarray:
    if len(hashes) < size:
        return np.zeros(b.n, np.int64)
    whole = np.flatnonzero(w.doc[: len(hashes) - size + 1] == w.doc[size - 1 :])
    again = whole[_repeated(window_hashes(hashes, size)[whole], w.doc[whole]) > 0]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + size, -1)
    return per_doc(np.cumsum(change[:-1]) > 0, w.first)


def ngram_buckets(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the text of each."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = w.doc[1:] == w.doc[:-1]
    two = window_hashes(hashes, 2)[pairs]
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([hashes & mask, two & mask]).astype(np.int64), np.concatenate([w.doc, w.doc[1:][pairs]])


def _count(batches: Iterator[pa.RecordBatch], trusted: np.ndarray) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        ids = batch.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        good = np.isin(ids, trusted)
        for b in blocks(batch.column("text")):
            w = words(b)
            bucket, doc = ngram_buckets(w, span_hashes(b.data, w.start, w.end))
            raw += np.bincount(bucket, minlength=BUCKETS)
            mine = good[b.first : b.first + b.n]
            if mine.any():
                target += np.bincount(bucket[mine[doc]], minlength=BUCKETS)
    own = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(raw[own]), pa.array(target[own])], names=["bucket", "n_raw", "n_target"])


def ratio_table(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED, prior: float = PRIOR) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw) for every bucket: BUCKETS floats, whatever the input's size."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    rows = good.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted).collect()
    ids = np.sort(np.array([r.doc_id for r in rows], np.int64))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    counts = _plain(docs).mapInArrow(partial(_count, trusted=ids), "bucket int, n_raw long, n_target long")
    for r in counts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target")).collect():
        raw[r.bucket], target[r.bucket] = r.n_raw, r.n_target
    if not target.sum():
        return np.zeros(BUCKETS)
    p_raw = (raw + 1) / (raw + 1).sum()
    p_target = (target + prior * BUCKETS * p_raw) / (target.sum() + prior * BUCKETS)
    return np.log(p_target) - np.log(p_raw)


def _judge(batches: Iterator[pa.RecordBatch], table: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column("text")):
            w = words(b)
            hashes = span_hashes(b.data, w.start, w.end)
            bucket, doc = ngram_buckets(w, hashes)
            total = np.bincount(doc, table[bucket], b.n)
            n = np.bincount(doc, minlength=b.n)
            score = total / np.maximum(n, 1)
            counts = [np.diff(w.first), *_word_counts(b, w), _dup_lines(b, w), _repeat_words(b, w, hashes)]
            failed = (counts[0] < 20) | (100 * counts[4] > 30 * counts[0])
            cols = [batch.column("doc_id").slice(b.first, b.n), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *BASE_COLUMNS, "base_failed", "score", "kept"])


def _word_counts(b: Block, w: Words) -> tuple[np.ndarray, np.ndarray]:
    letters = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])
    return per_doc(letters[w.end] - letters[w.start], w.first), per_doc(_SYMBOL[b.data], b.offsets)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED, prior: float = PRIOR) -> DataFrame:
    """Every document's base counts, its mean log-likelihood ratio and the verdict.

    docs: doc_id long, text string; labels: doc_id, quality, toxic. Other columns are
    ignored. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score and kept: false where the base rules fail, else whether score >=
    threshold. A null text has no words and fails; repeated rows are judged again and count
    again; a null doc_id stays null and is never trusted; texts of any length are read whole; a
    score at the threshold is kept. Without trusted documents every score is 0, and the base
    rules decide. An empty table gives no rows.
    """
    table = ratio_table(docs, labels, trusted, prior)
    return _plain(docs).mapInArrow(partial(_judge, table=table, threshold=threshold), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def _keep(batches: Iterator[pa.RecordBatch], table: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [x.column("kept") for x in _judge(iter([batch]), table, threshold)]
        if kept:
            yield batch.filter(pa.concat_arrays(kept))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED, prior: float = PRIOR) -> DataFrame:
    """The rows of docs that judge_quality keeps, with all their columns; nothing is joined or shuffled.

    Null and empty texts go, texts of any length are judged whole, repeated rows alike, a
    score at the threshold stays, and an empty table gives no rows.
    """
    table = ratio_table(docs, labels, trusted, prior)
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    return rows.mapInArrow(partial(_keep, table=table, threshold=threshold), rows.schema)
