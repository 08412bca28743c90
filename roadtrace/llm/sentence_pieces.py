"""SentencePiece BPE ids of whole texts, and texts of ids, in vectorised merge rounds.

A text's characters lie in one flat numpy array. It is cut where no piece of the vocabulary
holds the two characters next to each other, since no merge ever crosses such a place; the
distinct words between cuts are merged in rounds. A round finds the best pair of every word
(a segmented minimum of pair ranks), merges its occurrences from the left, all words at
once, and closes the gaps; words without a pair leave. Where a merge makes a pair that is
at least as good as the one merged, order inside the round would matter: such words, and
words of more than LONG characters, go through a queue that takes one pair after another.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.llm.textblocks import Block, _power, blocks, mix

#: Characters of a word that is merged in rounds.
LONG = 1024
#: Bytes of texts, and of a part of a longer text, that are encoded at a time; ids that are decoded at a time.
PART = 1 << 20
SPACE = 0x2581
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)
_NONE = np.int64(1) << np.int64(40)
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)


def _each_bad_byte(e: UnicodeError):
    return "�", e.start + 1


codecs.register_error("each-bad-byte", _each_bad_byte)


@dataclass
class Table:
    """Pairs of symbols that merge, sorted by key, with the merged symbol and its rank; small ranks come first."""

    width: int
    keys: np.ndarray
    merged: np.ndarray
    rank: np.ndarray

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands in the table; -1 where it does not."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


class Model:
    """A model file of the sentencepiece library: BPE, identity normaliser, byte fallback, no symbols of users.

    encode(block) and decode(ids, offsets) give what encode(text, add_eos=eos) and
    decode(ids) of the library give. Other kinds of models are refused with a ValueError.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        kinds = {p.type for p in spec.pieces}
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models that leave texts as they are")
        if not train.byte_fallback or train.treat_whitespace_as_suffix or kinds & {_USER, _UNUSED}:
            raise ValueError("only models with byte fallback and without symbols of users")
        self.prefix, self.eos = norm.add_dummy_prefix, next(i for i, p in enumerate(spec.pieces) if p.piece == (train.eos_piece or "</s>"))
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
        self._symbols(normal, [p.score for p in spec.pieces])
        self.byte_id = np.zeros(256, np.int64)
        surfaces = []
        for i, p in enumerate(spec.pieces):
            if p.type == _BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
            surfaces.append({_BYTE: lambda s: bytes([int(s[3:5], 16)]), _CONTROL: lambda s: b"", _UNKNOWN: lambda s: train.unk_surface.encode()}.get(p.type, lambda s: s.replace("▁", " ").encode())(p.piece))
        self.kind = np.array([p.type for p in spec.pieces], np.int8)
        self.leads = np.array([p.type == _NORMAL and p.piece.startswith("▁") for p in spec.pieces])
        self.size = np.array([len(s) for s in surfaces], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)

    def _symbols(self, normal: dict[str, int], score: list[float]) -> None:
        """Symbols are pieces by id, then letters of pieces that are none themselves; _letter leads to them from code points."""
        letters = sorted({c for p in normal for c in p})
        symbol = dict(normal)
        for c in letters:
            symbol.setdefault(c, len(score) + len(symbol) - len(normal))
        self.n_symbols = len(score) + len(symbol) - len(normal)
        place = {s: k for k, s in enumerate(sorted({-score[i] for i in normal.values()}))}
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.n_symbols + b] = (i, place[-score[i]])
        keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pairs = pairs
        self.table = Table(self.n_symbols, keys, np.array([pairs.get(k, (0, 0))[0] for k in keys.tolist()], np.int64), np.array([pairs.get(k, (0, 0))[1] for k in keys.tolist()], np.int64))
        # Letters have small numbers from 1 on, 0 for all others; two that stand together in a piece have a bit.
        self.n_letters = len(letters) + 1
        number = {c: k + 1 for k, c in enumerate(letters)}
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, self.n_letters)
        self.letter_symbol = np.array([-1, *(symbol[c] for c in letters)], np.int64)
        self.letter_code = np.array([0, *map(ord, letters)], np.int64)
        bits = np.zeros(self.n_letters**2 // 8 + 1, np.uint8)
        for p in normal:
            for a, b in zip(p, p[1:]):
                k = number[a] * self.n_letters + number[b]
                bits[k >> 3] |= 1 << (k & 7)
        self.bits = bits
        self.keys = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, self.n_letters, dtype=np.uint64) | np.uint64(1)
        # Whether a space only ever begins a word or follows spaces, so that long texts may be encoded in parts.
        self.parts = not any("▁" in p.lstrip("▁") for p in normal)

    # -- merging -------------------------------------------------------------------------

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """Merge the best pair, of equal ones the leftmost, until none is left: the plain order, by a queue."""
        width, pairs, n = self.n_symbols, self.pairs, len(symbols)
        sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j < n and (hit := pairs.get(sym[i] * width + sym[j])):
                queue.append((hit[1], i, j, sym[i], sym[j], hit[0]))

        for i in range(n - 1):
            push(i, i + 1)
        heapq.heapify(queue)
        while queue:
            _, i, j, a, b, merged = heapq.heappop(queue)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], sym[j], after[i] = merged, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            size = len(queue)
            push(before[i], i)
            push(i, after[i])
            fresh = queue[size:]
            del queue[size:]
            for x in fresh:
                heapq.heappush(queue, x)
        return [s for s in sym if s >= 0]

    def merged(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of symbols, word k from first[k] on, merged to the end; the symbols left and where each word begins."""
        n = len(first) - 1
        lengths = np.diff(first)
        done_word, done_sym, queued = [], [], []
        for k in np.flatnonzero(lengths > LONG).tolist():
            queued.append(k)
        word = np.repeat(np.arange(n), lengths)
        stay = np.repeat(lengths <= LONG, lengths)
        now, word = sym[stay], word[stay]
        last_rank, last_hits = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        while len(now):
            at = np.full(len(now), -1, np.int64)
            same = np.flatnonzero(word[:-1] == word[1:])
            at[same] = self.table.find(now[same], now[same + 1])
            rank = np.where(at >= 0, self.table.rank[at], _NONE)
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            owner, best = word[begins], np.minimum.reduceat(rank, begins)
            ended = best == _NONE
            late = ~ended & (last_hits[owner] > 1) & (best <= last_rank[owner])
            queued += owner[late].tolist()
            sizes = np.diff(np.append(begins, len(now)))
            if ended.any():
                of = np.repeat(ended, sizes)
                done_word.append(word[of])
                done_sym.append(now[of])
            hit = rank == np.repeat(np.where(ended, -1, best), sizes)
            # Of a row of neighbouring hits the first, third, fifth are merged.
            where = np.flatnonzero(hit)
            starts = np.flatnonzero(np.append(True, np.diff(where) != 1)) if len(where) else where
            rows = np.diff(np.append(starts, len(where)))
            taken = where[(np.arange(len(where)) - np.repeat(starts, rows)) % 2 == 0]
            last_rank[owner], last_hits[owner] = best, 0
            np.add.at(last_hits, word[taken], 1)
            now[taken] = self.table.merged[at[taken]]
            keep = ~np.repeat(ended | late, sizes)
            keep[taken + 1] = False
            now, word = now[keep], word[keep]
        for k in queued:
            out = np.array(self.one_by_one(sym[first[k] : first[k + 1]].tolist()), np.int64)
            done_word.append(np.full(len(out), k))
            done_sym.append(out)
        if not done_word:
            return sym[:0], np.zeros(n + 1, np.int64)
        owner, symbols = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(n + 1))

    # -- texts to ids --------------------------------------------------------------------

    def _ids_of(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in code points, spaces replaced; text k begins at at[k]."""
        none = np.zeros(0, np.int64)
        if not len(codes):
            return none, np.zeros(len(at), np.int64)
        letter = self.letter[codes]
        k = letter[:-1].astype(np.int64) * self.n_letters + letter[1:]
        cut = np.append(True, (self.bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 0)
        cut[at[:-1][np.diff(at) > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(codes)))
        # Distinct words, found by hashes and compared letter by letter.
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.keys[letter] * _power(_R, len(codes)), out=sums[1:])
        h = mix((sums[start + size] - sums[start]) * _power(_R_INV, len(codes))[start] + size.astype(np.uint64))
        _, one, word = np.unique(h, return_index=True, return_inverse=True)
        alike = np.array_equal(size[one][word], size) and np.array_equal(letter[np.repeat(start[one][word] - start, size) + np.arange(len(codes))], letter)
        if not alike:  # two words with one hash
            one, word = np.arange(len(start)), np.arange(len(start))
        first = np.concatenate([[0], np.cumsum(size[one])])
        from_text = np.repeat(start[one] - first[:-1], size[one]) + np.arange(first[-1])
        known = letter[from_text] > 0
        symbols, begins = self.merged(self.letter_symbol[letter[from_text]], first) if known.all() else self._with_unknown(letter[from_text], first, known)
        count = np.diff(begins)[word]
        ends = np.cumsum(count)
        ids = symbols[np.repeat(begins[:-1][word] - (ends - count), count) + np.arange(ends[-1])]
        word_at = np.append(0, ends)[np.searchsorted(start, at)]
        spell = (ids < 0) | (ids >= len(self.kind))
        if not spell.any():
            return ids, word_at
        # Letters that are no pieces are spelled in bytes; unknown ones are words of one letter.
        codes_of = np.zeros(len(ids), np.int64)
        codes_of[ids >= len(self.kind)] = self._code_of_symbol(ids[ids >= len(self.kind)])
        codes_of[ids < 0] = np.repeat(codes[start], count)[ids < 0]
        return self._spelled(ids, codes_of, spell, word_at)

    def _with_unknown(self, letter: np.ndarray, first: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As merged, where words of one unknown letter stay as the symbol -1."""
        strange = ~known[first[:-1]]
        sizes = np.diff(first)
        inner = np.repeat(~strange, sizes)
        symbols, begins = self.merged(self.letter_symbol[letter[inner]], np.concatenate([[0], np.cumsum(sizes[~strange])]))
        count = np.ones(len(sizes), np.int64)
        count[~strange] = np.diff(begins)
        ends = np.cumsum(count)
        out = np.full(ends[-1], -1, np.int64)
        out[np.repeat(~strange, count)] = symbols
        return out, np.append(0, ends)

    def _code_of_symbol(self, symbols: np.ndarray) -> np.ndarray:
        order = np.argsort(self.letter_symbol)
        return self.letter_code[order[np.searchsorted(self.letter_symbol[order], symbols)]]

    def _spelled(self, ids: np.ndarray, codes: np.ndarray, spell: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.ones(len(ids), np.int64)
        size[spell] += (codes[spell] >= 0x80).astype(np.int64) + (codes[spell] >= 0x800) + (codes[spell] >= 0x10000)
        ends = np.cumsum(size)
        out = np.repeat(ids, size)
        raw = np.frombuffer(codes[spell].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out[np.repeat(spell, size)] = self.byte_id[raw]
        return out, np.append(0, ends)[word_at]

    def _normal(self, raw: bytes, offsets: np.ndarray, begins: bool) -> tuple[np.ndarray, np.ndarray]:
        """Code points of texts, spaces replaced, each text behind the prefix that the model asks for."""
        data = np.frombuffer(raw, np.uint8)
        codes = np.frombuffer(raw.decode("utf-8", "each-bad-byte").encode("utf-32-le"), "<u4").astype(np.int64)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = heads[offsets]
        codes[codes == 32] = SPACE
        if self.prefix and begins:
            there = np.flatnonzero(np.diff(at) > 0)
            codes = np.insert(codes, at[:-1][there], SPACE)
            at = at + np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
        return codes, at

    def encode(self, b: Block, eos: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's texts, and where each text's begin. Texts longer than PART go in parts."""
        if b.n > 1 or len(b.data) <= 2 * PART or not self.parts:
            ids, at = self._ids_of(*self._normal(b.data.tobytes(), b.offsets, True))
        else:
            out, begin, spaces = [], 0, np.flatnonzero((b.data[1:] == 32) & (b.data[:-1] != 32)) + 1
            # U+2581 in a text is a space, too: a cut must not stand behind one.
            spaces = spaces[~((b.data[spaces - 1] == 0x81) & (b.data[spaces - 2] == 0x96) & (b.data[spaces - 3] == 0xE2))] if len(spaces) else spaces
            while begin < len(b.data):
                k = np.searchsorted(spaces, begin + PART)
                end = int(spaces[k]) if k < len(spaces) else len(b.data)
                out.append(self._ids_of(*self._normal(b.data[begin:end].tobytes(), np.array([0, end - begin]), begin == 0))[0].astype(np.int32))
                begin = end
            ids = np.concatenate(out)
            at = np.array([0, len(ids)])
        if eos:
            ids, at = np.insert(ids, at[1:], self.eos), at + np.arange(len(at))
        return ids, at

    # -- ids to texts --------------------------------------------------------------------

    def decode(self, ids: np.ndarray, at: np.ndarray) -> Iterator[str]:
        """The text of each [at[k], at[k + 1]) of ids; ids outside the vocabulary raise an IndexError."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.kind)):
            raise IndexError("an id outside the vocabulary")
        seen = np.append(np.flatnonzero(self.kind[ids] != _CONTROL), len(ids))
        head = seen[np.searchsorted(seen, at[:-1])]
        led = (head < at[1:]) & self.leads[ids[np.minimum(head, max(len(ids) - 1, 0))]] if len(ids) else np.zeros(len(at) - 1, bool)
        control = np.flatnonzero(self.kind[ids] == _CONTROL)
        for k, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            # Bytes on both sides of a control id make no letter together.
            stops = [lo, *control[np.searchsorted(control, lo) : np.searchsorted(control, hi)].tolist(), hi]
            text = "".join(self._text(ids[i:j]) for i, j in zip(stops, stops[1:]))
            yield text[1 if led[k] and self.prefix else 0 :]

    def _text(self, ids: np.ndarray) -> str:
        return b"".join(self._surfaces(ids[i : i + PART]) for i in range(0, len(ids), PART)).decode("utf-8", "each-bad-byte")

    def _surfaces(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.surface[np.repeat(self.begin[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _added(part: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The columns, in place of those of the same name where there are any."""
    kept = [i for i, n in enumerate(part.schema.names) if n not in columns]
    return pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *columns.values()], names=[*(part.schema.names[i] for i in kept), *columns])


def _id_lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, eos: bool, back: bool) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for batch in batches:
        for b in blocks(batch.column("text"), PART):
            ids, at = m.encode(b, eos)
            more = {"ids": _id_lists(ids, at)}
            if back:
                more["decoded"] = pa.array(m.decode(ids, at), pa.string())
            yield _added(batch.slice(b.first, b.n), **more)


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for batch in batches:
        lists = batch.column("ids").fill_null([])
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        yield _added(batch, text=pa.array(m.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at), pa.string()))


def _with(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in columns] + [T.StructField(k, v) for k, v in columns.items()])


def encode(docs: DataFrame, path: str, eos: bool = True, back: bool = False) -> DataFrame:
    """docs with ids, those that the sentencepiece library gives for every whole text, and with back also decoded, their text.

    docs: text string; all other columns stay, but for ones named ids (or decoded), which are
    replaced. path: a model file, see Model for what it may hold; with eos the end id follows
    each text. Null and empty texts have the end id only; texts of any length are encoded
    whole, longer ones than a megabyte in parts between words; repeated rows are encoded again;
    nothing is compared by a key, so null ids and ties are no matter. No rows give none. No row
    moves: the work is a scan, and a lost executor costs its own tasks only.
    """
    rows = docs.withColumn("text", F.col("text").cast("string"))
    more = {"ids": T.ArrayType(T.IntegerType(), False)} | ({"decoded": T.StringType()} if back else {})
    return rows.mapInArrow(partial(_encoded, path=path, eos=eos, back=back), _with(rows, **more))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with text, the sentencepiece library's decode(ids) of every row's ids.

    rows: ids array<int>; a column named text is replaced, all others stay. A null list gives an
    empty text; bytes that are no UTF-8 give U+FFFD each; an id outside the vocabulary, or a
    null one, fails.
    """
    rows = rows.withColumn("ids", F.col("ids").cast("array<int>"))
    return rows.mapInArrow(partial(_decoded, path=path), _with(rows, text=T.StringType()))
