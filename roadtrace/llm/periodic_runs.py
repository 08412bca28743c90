"""Periodic runs in texts: stretches of words that repeat with a period at least four times.

At every dyadic scale a text's words are cut into blocks of B words. An exact integer
number-theoretic transform of squared differences tells, for each block and every distance
of a window behind it, whether the block stands there again without a mismatch; a distance
seeds a run, which is extended word by word on both sides. A run of period q and length at
least 4 q holds a whole block, and its copy, at the scale whose distances hold q, so none
is missed.

Work is linear in a text at each scale. A block goes through the transform only where every
word of it recurs within the scale's distances; and where the window lies inside a known
run of a period of at most a quarter of the block, all distances are multiples of it. A
block that is periodic itself meets its copies in arithmetic progressions; only the
distances at which its run's beginning or end meets another run's can be seeds of a longer
period (any other is broken within less than three periods).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.llm.textblocks import Block, blocks, span_hashes, words

#: Bytes of texts that are searched at a time.
PART = 1 << 20
#: Values of one batch of transforms.
BATCH = 1 << 19
#: Primes under 2**32 with a primitive root each: 15 * 2**27 + 1, 27 * 2**26 + 1, 7 * 2**26 + 1.
PRIMES = [(2013265921, 31), (1811939329, 13), (469762049, 3)]
#: A run has at least so many words, and so many times its period.
SHORTEST, TIMES = 6, 4

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
_ARROW_RUN = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])


# -- exact transforms ------------------------------------------------------------------------


def _roots(n: int, prime: int, generator: int, inverse: bool) -> list[np.ndarray]:
    """For each stage of a transform of n values, the powers of its root of unity."""
    out, size = [], 2
    while size <= n:
        w = pow(generator, (prime - 1) // size, prime)
        w = pow(w, prime - 2, prime) if inverse else w
        powers = np.ones(size // 2, np.uint64)
        step = 1
        while step < size // 2:
            powers[step : 2 * step] = powers[: len(powers[step : 2 * step])] * np.uint64(pow(w, step, prime)) % np.uint64(prime)
            step *= 2
        out.append(powers)
        size *= 2
    return out


def _transform(x: np.ndarray, prime: int, roots: list[np.ndarray]) -> np.ndarray:
    """Of each row, to bit-reversed order: decimation in frequency."""
    p, rows = np.uint64(prime), len(x)
    for w in reversed(roots):
        x = x.reshape(rows, -1, 2, len(w))
        a, b = x[:, :, 0], x[:, :, 1]
        y = np.empty_like(x)
        y[:, :, 0] = (a + b) % p
        y[:, :, 1] = (a + (p - b)) % p * w % p
        x = y
    return x.reshape(rows, -1)


def _back(x: np.ndarray, prime: int, roots: list[np.ndarray]) -> np.ndarray:
    """From bit-reversed order, with the inverse roots: decimation in time."""
    p, (rows, n) = np.uint64(prime), x.shape
    for w in roots:
        x = x.reshape(rows, -1, 2, len(w))
        a, b = x[:, :, 0], x[:, :, 1] * w % p
        y = np.empty_like(x)
        y[:, :, 0] = (a + b) % p
        y[:, :, 1] = (a + (p - b)) % p
        x = y
    return x.reshape(rows, n) * np.uint64(pow(n, prime - 2, prime)) % p


def zero_mismatch(block: np.ndarray, window: np.ndarray, lags: int) -> np.ndarray:
    """Where block[i] equals window[i, d : d + B], for each row i and d < lags.

    Values are small non-negative numbers. The sum of squared differences is the blocks'
    and the windows' sums of squares less twice a correlation, all modulo enough primes that
    their product exceeds the largest sum; it is zero only where every word agrees.
    """
    size, n = block.shape[1], 1
    while n < window.shape[1]:
        n *= 2
    bound, product, zero = size * (int(max(block.max(initial=0), window.max(initial=0))) + 1) ** 2, 1, None
    for prime, generator in PRIMES:
        if product > bound:
            break
        if (prime - 1) % n:
            raise ValueError("a text of more words than a transform holds")
        p, roots = np.uint64(prime), _roots(n, prime, generator, False)
        a, b = np.zeros((len(block), n), np.uint64), np.zeros((len(block), n), np.uint64)
        a[:, :size], b[:, : window.shape[1]] = block[:, ::-1], window
        cross = _back(_transform(a, prime, roots) * _transform(b, prime, roots) % p, prime, _roots(n, prime, generator, True))[:, size - 1 : size - 1 + lags]
        sums = np.zeros((len(block), window.shape[1] + 1), np.uint64)
        np.cumsum(b[:, : window.shape[1]] ** 2 % p, axis=1, out=sums[:, 1:])
        squares = (a**2 % p).sum(1)[:, None] + sums[:, size : size + lags] - sums[:, :lags]
        found = (squares % p + (p - cross) + (p - cross)) % p == 0
        zero, product = found if zero is None else zero & found, product * prime
    if product <= bound:
        raise ValueError("a text of more words than a transform holds")
    return zero


# -- runs ------------------------------------------------------------------------------------


def distances(size: int) -> tuple[int, int]:
    """Distances that are sought with blocks of so many words: size is the largest power of two up to (3 q + 1) / 2."""
    return -(-(2 * size - 1) // 3), -(-(4 * size - 1) // 3)


def _next_same(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How far behind each place the same word stands again in the text; far where it does not."""
    key = doc * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    far = np.full(len(word), np.iinfo(np.int64).max)
    same = key[order][1:] == key[order][:-1]
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return far


class Runs:
    """Known runs as whole stretches, asked by period and place."""

    def __init__(self, n: int):
        self.n = n
        self.start, self.end, self.period = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Stretches of periods; one that a smaller period has is no run of its own."""
        start, end, period = (np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        one = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
        start, end, period = start[one], end[one], period[one]
        order = np.lexsort((start, period))
        self.start, self.end, self.period = start[order], end[order], period[order]

    def at(self, period: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which run of that period begins last at or before a place; -1 if none does."""
        key = self.period * (self.n + 1) + self.start
        k = np.searchsorted(key, period * (self.n + 1) + place, "right") - 1
        return np.where((k >= 0) & (self.period[k] == period) if len(key) else False, k, -1)


def _extend(word: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, step: int, d: np.ndarray) -> np.ndarray:
    """Move places by step while the word there equals the one d behind and both stay within [lo, hi)."""
    place = place.copy()
    left, stride = np.arange(len(place)), 8
    while len(left):
        p, q = place[left][:, None] + step * np.arange(stride), d[left][:, None]
        inside = (p >= lo[left][:, None]) & (p + q < hi[left][:, None])
        p = np.clip(p, 0, len(word) - 1)
        good = inside & (word[p] == word[np.minimum(p + q, len(word) - 1)])
        more = np.where(good.all(1), stride, good.argmin(1))
        place[left] += step * more
        left = left[more == stride]
        stride = min(2 * stride, max(8, (1 << 20) // max(1, len(left))))
    return place


def find_runs_of(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (over all texts), length and smallest period of all runs. word: small numbers; text k has those from first[k] on."""
    n, sizes = len(word), np.diff(first)
    known = Runs(n)
    if not n:
        return known.start, known.start, known.start
    doc = np.repeat(np.arange(len(sizes)), sizes)
    far = _next_same(word, doc)
    text_lo, text_hi = first[:-1][doc], first[1:][doc]
    size = 2
    while TIMES * (span := distances(size))[0] <= sizes.max():
        least, beyond = span
        # Blocks of whole texts, without those that cannot stand again within the distances.
        at = _block_starts(first, size)
        at = at[at + size + least <= text_hi[at]]
        at = at[_most(far, at, size) < beyond]
        if len(at) and size >= 4:  # windows inside a run of a period up to size / 4 hold its multiples only
            small = known.period * 4 <= size
            reach = np.zeros(n + 1, np.int64)
            np.maximum.at(reach, known.start[small], known.end[small])
            at = at[np.maximum.accumulate(reach)[at] < np.minimum(at + size + beyond - 1, text_hi[at])]
        many = max(1, BATCH // (4 * size))
        seeds = [_seeds(word, at[i : i + many], size, least, beyond, text_hi, known) for i in range(0, len(at), many)]
        if seeds:
            place, d = (np.concatenate(x) for x in zip(*seeds))
            # Neighbouring blocks with one distance lie in one stretch.
            order = np.lexsort((place, d))
            place, d = place[order], d[order]
            new = np.append(True, (d[1:] != d[:-1]) | (place[1:] != place[:-1] + size) | (doc[place[1:]] != doc[place[:-1]]))[: len(place)]
            a, dist = place[new], d[new]
            last = np.append(place[np.flatnonzero(new)[1:] - 1], place[-1:])[: len(a)] + size
            lo, hi = text_lo[a], text_hi[a]
            start = _extend(word, lo, hi, a - 1, -1, dist) + 1
            end = _extend(word, lo, hi, last, 1, dist) + dist
            whole = (end - start >= TIMES * dist) & (end - start >= SHORTEST)
            known.add(start[whole], end[whole], dist[whole])
        size *= 2
    order = np.lexsort((known.period, known.start))
    return known.start[order], (known.end - known.start)[order], known.period[order]


def _block_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Places of all whole blocks of all texts."""
    count = np.diff(first) // size
    ends = np.cumsum(count)
    return np.repeat(first[:-1], count) + size * (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count))


def _most(x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The largest of x in each [a, a + size), which end before x does."""
    if not len(at):
        return at
    return np.maximum.reduceat(x, np.stack([at, at + size], 1).ravel())[::2]


def _seeds(word: np.ndarray, at: np.ndarray, size: int, least: int, beyond: int, text_hi: np.ndarray, known: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and the distances at which they stand again."""
    block = word[at[:, None] + np.arange(size)]
    reach = at[:, None] + least + np.arange(size + beyond - 1 - least)
    inside = reach < text_hi[at][:, None]
    window = word[np.minimum(reach, len(word) - 1)]
    # Few different values keep the sums small: numbers by order, 0 for what is outside.
    values, numbers = np.unique(np.concatenate([block.ravel(), window[inside]]), return_inverse=True)
    block = numbers[: block.size].reshape(block.shape) + 1
    filled = np.zeros(window.shape, np.int64)
    filled[inside] = numbers[block.size :] + 1
    row, lag = np.nonzero(zero_mismatch(block, filled, beyond - least))
    place, d = at[row], lag + least
    if size < 8:
        return place, d
    # Four copies or more: the block's own period is their step, and a run of it is known.
    count = np.bincount(row, minlength=len(at))
    many = count[row] >= 4
    head = np.concatenate([[0], np.cumsum(count)])[:-1]
    step = (d[np.minimum(head + 1, max(len(d) - 1, 0))] - d[np.minimum(head, max(len(d) - 1, 0))])[row] if len(d) else d
    p, s, e = place[many], d[many], step[many]
    one, two = known.at(e, p), known.at(e, p + s)
    multiple = (s % e == 0) & (p + size + s <= known.end[one])
    joined = (known.end[two] - known.end[one] == s) | (known.start[two] - known.start[one] == s)
    keep = np.ones(len(d), bool)
    keep[many] = (one < 0) | (two < 0) | ~multiple & ((two == one) | joined)
    return place[keep], d[keep]


def word_numbers(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Small numbers, equal for equal words of a block; each text's first word; the words' byte spans."""
    w = words(b)
    h = span_hashes(b.data, w.start, w.end)
    _, one, number = np.unique(h, return_index=True, return_inverse=True)
    size = w.end - w.start
    ends = np.cumsum(size)
    total = ends[-1] if len(ends) else 0
    inner = np.arange(total) - np.repeat(ends - size, size)
    alike = np.array_equal(size[one][number], size) and np.array_equal(b.data[np.repeat(w.start, size) + inner], b.data[np.repeat(w.start[one][number], size) + inner])
    if not alike:  # two words with one hash
        raw, seen = b.data.tobytes(), {}
        number = np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(w.start.tolist(), w.end.tolist())], np.int64)
    return number.astype(np.int64), w.first, w.start, w.end


def _collapsed(b: Block, first: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    """Each text's words outside all but the first period of every run, one space between them."""
    change = np.zeros(len(begin) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    size = end[kept] - begin[kept] + 1  # a word and a space
    stop = np.cumsum(size)
    source = np.repeat(begin[kept] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
    data = b.data[np.minimum(source, max(len(b.data) - 1, 0))] if len(source) else np.zeros(0, np.uint8)
    data[stop - 1] = 32
    count = np.searchsorted(kept, first)
    bounds = np.append(0, stop)[count]
    # The last word of each text has no space behind it.
    some = np.diff(count) > 0
    data = np.delete(data, bounds[1:][some] - 1)
    bounds = bounds - np.concatenate([[0], np.cumsum(some)])
    return pa.Array.from_buffers(pa.large_string(), b.n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column("text"), PART):
            number, first, begin, end = word_numbers(b)
            start, length, period = find_runs_of(number, first)
            at = np.searchsorted(start, first)
            local = start - np.repeat(first[:-1], np.diff(at))
            runs = pa.StructArray.from_arrays([pa.array(local), pa.array(length), pa.array(period)], fields=list(_ARROW_RUN))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), runs)
            part = batch.slice(b.first, b.n)
            new = {"n_words": pa.array(np.diff(first)), "runs": lists, "collapsed": _collapsed(b, first, begin, end, start, length, period)}
            kept = [n for n in part.schema.names if n not in new]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *new.values()], names=[*kept, *new])


def find_runs(docs: DataFrame) -> DataFrame:
    """docs with n_words, runs and collapsed: the periodic runs of every whole text.

    docs: text string; all other columns stay, but for ones with these three names, which are
    replaced. Words are runs of characters other than space and U+0009-000D, numbered from
    0. A run is a stretch of words with smallest period q (words q apart are identical) and
    length >= max(6, 4 q) that no neighbouring word extends; runs: its (start, length,
    period) by start, then period. collapsed: the words that lie in no run behind its first q
    words, joined by a space. Null and empty texts have no words, no runs and an empty
    collapsed text; texts of any length are searched whole; repeated rows are searched again; no
    rows give none. No row moves: the work is a scan.
    """
    rows = docs.withColumn("text", F.col("text").cast("string"))
    more = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    fields = [f for f in rows.schema.fields if f.name not in {m.name for m in more}]
    return rows.mapInArrow(_found, T.StructType([*fields, *more]))


def longest(runs: Column) -> Column:
    """The run with greatest length, of equal ones the smallest start, then period; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs where the words of about every tenth text repeat from a word on, as follows from doc_id alone.

    With h the unsigned crc32 of the decimal doc_id, g = h div 10: where h % 10 = 0 and the text
    has n > 0 words, word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div
    (3 + g % 8). Such texts are their words joined by a space; all others, and those without
    doc_id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    g = F.floor(h / 10).cast("long")

    def periodic(found: Column) -> Column:
        n = F.size(found).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(found, i.cast("int"))), " "))

    found = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    changed = F.get(F.transform(F.array(found), periodic), 0)
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), F.coalesce(changed, "text")).otherwise(F.col("text")))
