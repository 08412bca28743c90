"""Token ids of whole texts, by a vocabulary file of the tokenizers library.

A byte-level pre-tokeniser never joins what stands before and after a space that a
visible character follows, nor a line break between visible characters with what
precedes it. Texts are cut there, in whole blocks at a time; pieces are found by 64-bit
hashes and compared byte by byte, and each distinct piece is encoded once per task. What
was encoded is kept in flat arrays, so a block's ids are one gather. Cuts are only made
where they are safe; texts that hold the string of an added token are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np

from roadtrace.llm.textblocks import Block, span_hashes

#: Slots of a task's table of pieces; at half of them it forgets all and starts again.
SLOTS = 1 << 21

_ASCII_VISIBLE = np.zeros(256, bool)
_ASCII_VISIBLE[0x21:0x7F] = True
#: First bytes of letters that cannot begin a white-space character (U+0085, U+00A0, U+1680, U+2000-205F, U+3000).
_HEAD_VISIBLE = _ASCII_VISIBLE.copy()
_HEAD_VISIBLE[0xC3:0xF5] = True
_HEAD_VISIBLE[[0xE1, 0xE2, 0xE3]] = False


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _ranked(path: str) -> Callable[[str], list[int]] | None:
    """A faster encoder over the same merges, where the ids are the ranks of the merges; else None."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    vocab, merges, letters = spec["model"]["vocab"], spec["model"]["merges"], _byte_letters()
    added = {t["content"] for t in spec.get("added_tokens", [])}
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    if any(vocab.get(t) != 256 + i for i, t in enumerate(joined)):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def largest_id(path: str) -> int:
    """The largest id of a vocabulary file, added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def cuts(b: Block) -> np.ndarray:
    """Where pieces begin: every text's start, and the safe cuts inside."""
    data = b.data
    n = len(data)
    head = np.zeros(n, bool)
    if n > 1:
        head[:-1] = _HEAD_VISIBLE[data[1:]]
    cut = (data == 32) & head
    lines = np.flatnonzero((data == 10) & head)
    lines = lines[lines > 2]
    tail, before, first = data[lines - 1], data[lines - 2], data[lines - 3]
    two = (tail >= 0x80) & (before == 0xC3)
    three = (tail >= 0x80) & (before >= 0x80) & (first >= 0xE4) & (first < 0xF0)
    cut[lines[_ASCII_VISIBLE[tail] | two | three]] = True
    starts = b.offsets[:-1][np.diff(b.offsets) > 0]
    ends = b.offsets[1:][np.diff(b.offsets) > 0]
    cut[ends - 1] = False  # what follows the last byte belongs to another text
    cut[starts] = True
    return np.flatnonzero(cut)


class Encoder:
    """ids(block): the texts' ids, as encode(add_special_tokens=False) gives them, and where each text's begin."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.piece = _ranked(path) or (lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids)
        self.forget()

    def forget(self) -> None:
        """Empty the table; its memory is only taken again as it fills."""
        self.slots = np.zeros(SLOTS, np.uint64)
        self.entry = np.zeros(SLOTS, np.int32)
        self.start = np.zeros(SLOTS // 2 + 1, np.int64)
        self.length = np.zeros(SLOTS // 2 + 1, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.raw_start = np.zeros(SLOTS // 2 + 1, np.int64)
        self.raw_length = np.zeros(SLOTS // 2 + 1, np.int32)
        self.raw = np.zeros(1 << 20, np.uint8)
        self.entries = self.filled = self.raw_filled = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slots of hashes; -1 where unknown."""
        at = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        probe = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            have = self.slots[probe]
            hit = have == h[left]
            at[left[hit]] = probe[hit]
            go = ~hit & (have != 0)
            left, probe = left[go], (probe[go] + 1) & (SLOTS - 1)
        return at

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces and keep them; h has no repeats."""
        ids = [self.piece(p.decode("utf-8", "replace")) for p in pieces]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        if self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), total), np.uint32)])
        self.pool[self.filled : self.filled + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        own = np.arange(self.entries, self.entries + len(ids))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        more = int(sizes.sum())
        if self.raw_filled + more > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros(max(len(self.raw), more), np.uint8)])
        self.raw[self.raw_filled : self.raw_filled + more] = np.frombuffer(b"".join(pieces), np.uint8)
        self.raw_start[own] = self.raw_filled + np.cumsum(sizes) - sizes
        self.raw_length[own] = sizes
        self.raw_filled += more
        self.start[own] = self.filled + np.cumsum(lengths) - lengths
        self.length[own] = lengths
        self.filled += total
        self.entries += len(ids)
        left, probe = np.arange(len(h)), (h & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.slots[probe] == 0
            self.slots[probe[free]] = h[left[free]]
            won = free & (self.slots[probe] == h[left])
            self.entry[probe[won]] = own[left[won]]
            left, probe = left[~won], (probe[~won] + 1) & (SLOTS - 1)

    def ids(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        raw = b.data.tobytes()
        if any(a in raw for a in self.added):
            return self._one_by_one(b, raw)
        start = cuts(b)
        end = np.append(start[1:], len(b.data))
        h = span_hashes(b.data, start, end) | np.uint64(1)
        at = self._find(h)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new, first = np.unique(h[unknown], return_index=True)
            if self.entries + len(new) > SLOTS // 2:
                self.forget()
                new, first = np.unique(h, return_index=True)
                unknown = np.arange(len(h))
                if len(new) > SLOTS // 2:
                    return self._one_by_one(b, raw)
            first = unknown[first]
            self._learn(new, [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())])
            at[unknown] = self._find(h[unknown])
        entry = self.entry[at]
        if not self._same(entry, b.data, start, end):
            return self._one_by_one(b, raw)
        length = self.length[entry]
        sums = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(self.start[entry] - sums[:-1], length) + np.arange(sums[-1])]
        return ids, sums[np.searchsorted(start, b.offsets)]

    def _same(self, entry: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
        """Whether every piece has the bytes of the entry that its hash found."""
        size = end - start
        if (self.raw_length[entry] != size).any():
            return False
        # Pieces follow each other without gaps, so their bytes are the block's.
        return np.array_equal(self.raw[np.repeat(self.raw_start[entry] - start, size) + np.arange(len(data))], data)

    def _one_by_one(self, b: Block, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for lo, hi in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist()):
            text = raw[lo:hi].decode("utf-8", "replace")
            out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])
