"""Columnar text helpers shared by the corpus operators.

Texts stay in Arrow's contiguous UTF-8 buffers: words, lines and their 64-bit
hashes are found with numpy over blocks of about half a megabyte, so that memory
per task is bounded by the block or by one text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240611))
#: One random odd 64-bit value for each byte value.
BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, grown as needed and kept by the worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size <= 1 << 22:
            _powers[base] = out
        return out[:n]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Some consecutive texts of a batch: their bytes and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Null texts count as empty ones. A text is never split."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offset_buf, data_buf = column.buffers()
    offsets = np.frombuffer(offset_buf, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """start, end: byte spans; doc: the text of each word; first: index of each text's first word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def words(b: Block) -> Words:
    """Runs of bytes other than space and 0x09-0x0D, within each text."""
    solid = ~IS_SPACE[b.data]
    if not len(solid):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty, np.zeros(b.n + 1, np.int64))
    before = np.empty(len(solid), bool)
    before[0] = False
    before[1:] = solid[:-1]
    edges = b.offsets[:-1]
    before[edges[edges < len(solid)]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(len(solid), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    edges = b.offsets[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    doc = np.searchsorted(b.offsets, start, "right") - 1
    return Words(start, end, doc, np.searchsorted(start, b.offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: differences of a prefix sum of a polynomial."""
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_KEYS[data] * _power(_R, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_R_INV, len(data))[start] + (end - start).astype(np.uint64))


_ODD = [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, 64, dtype=np.uint64)]


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Of every n consecutive word hashes; window i begins at word i."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m] * _ODD[0]
    for k in range(1, n):
        out = out + hashes[k : k + m] * _ODD[k]
    return mix(out)


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over each [offsets[i], offsets[i + 1])."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
