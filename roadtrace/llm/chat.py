r"""Chat formatting by columnar byte assembly.

A turn becomes <s>role, a line break, its text, </s> and a line break. A control string
(<s>, </s>, [INST], [/INST]) inside a text gets a backslash behind its first character, and
one that looks escaped already gets one more, so the text can be read back. Turns of many
conversations are assembled at once: segment lengths, cumulative offsets and source
indices are numpy arrays, and one gather copies headers, texts and ends into a buffer that
becomes the Arrow column as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are assembled at once.
BLOCK_BYTES = 1 << 22
OPEN, CLOSE = b"<s>", b"</s>\n"
LEARNED = "assistant"
_CONTROL = re.compile(rb"<\\*/?s>|\[\\*/?INST\]")
_ESCAPED = re.compile(rb"(<)\\(\\*/?s>)|(\[)\\(\\*/?INST\])")
FORMATTED = "conv_id long, n_turns long, formatted binary, loss array<struct<start:long,end:long>>"

def escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one buffer, with a backslash put behind the first byte of each control string."""
    raw = data.tobytes()
    marks = np.array([m.span() for m in _CONTROL.finditer(raw)], np.int64).reshape(-1, 2) if b"<" in raw or b"[" in raw else np.zeros((0, 2), np.int64)
    row = np.searchsorted(offsets, marks[:, 0], "right") - 1
    inside = marks[:, 1] <= offsets[row + 1]
    if not inside.all():  # what spans two texts is none; look again inside each
        keep = np.isin(row, np.unique(np.concatenate([row[~inside], row[~inside] + 1])), invert=True)
        again = np.unique(np.concatenate([row[~inside], np.minimum(row[~inside] + 1, len(offsets) - 2)]))
        found = [offsets[i] + np.array([m.start() for m in _CONTROL.finditer(raw[offsets[i] : offsets[i + 1]])], np.int64) for i in again]
        starts = np.unique(np.concatenate([marks[keep, 0], *found]))
    else:
        starts = marks[:, 0]
    return np.insert(data, starts + 1, ord("\\")), offsets + np.searchsorted(starts, offsets, "left")


def unescaped(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1\2\3\4", text)


def _role_bytes(role: str | None) -> bytes:
    """A role in a header: no line break, and no control string."""
    raw = (role or "").encode().replace(b"\\", b"\\\\").replace(b"\n", b"\\n").replace(b"<", b"\\l").replace(b"[", b"\\b")
    return OPEN + raw + b"\n"


def _role(raw: bytes) -> bytes:
    back = {b"\\\\": b"\\", b"\\n": b"\n", b"\\l": b"<", b"\\b": b"["}
    return re.sub(rb"\\[\\nlb]", lambda m: back[m[0]], raw)


def _assemble(rows: pa.Table) -> pa.RecordBatch:
    """Whole conversations, rows in order."""
    conv = rows.column("conv_id").combine_chunks()
    ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
    void = conv.is_null().to_numpy(zero_copy_only=False)
    n = len(ids)
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (void[1:] != void[:-1])]))
    text = rows.column("text").combine_chunks().cast(pa.large_binary()).fill_null(b"")
    _, offset_buf, data_buf = text.buffers()
    offsets = np.frombuffer(offset_buf, np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8)[offsets[0] : offsets[-1]] if data_buf is not None else np.zeros(0, np.uint8)
    data, offsets = escaped(data, offsets - offsets[0])

    role = rows.column("role").combine_chunks().dictionary_encode()
    names = [*role.dictionary.to_pylist(), None]
    code = role.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
    heads = [_role_bytes(r) for r in names]
    source = np.concatenate([np.frombuffer(b"".join(heads) + CLOSE, np.uint8), data])
    head_at = np.concatenate([[0], np.cumsum([len(h) for h in heads])])
    text_at = head_at[-1] + len(CLOSE) + offsets

    # Three segments a turn: header, text, end.
    start = np.stack([head_at[:-1][code], text_at[:-1], np.full(n, head_at[-1])], 1).ravel()
    length = np.stack([np.diff(head_at)[code], np.diff(offsets), np.full(n, len(CLOSE))], 1).ravel()
    out_at = np.concatenate([[0], np.cumsum(length)])
    buffer = source[np.repeat(start - out_at[:-1], length) + np.arange(out_at[-1])]

    conv_at = np.append(out_at[3 * first], out_at[-1])
    learned = np.flatnonzero(np.array([r == LEARNED for r in names])[code])
    owner = np.searchsorted(first, learned, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(out_at[3 * learned + k] - conv_at[owner], pa.int64()) for k in (1, 2)], names=["start", "end"])
    loss = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32), spans)
    formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(conv_at), pa.py_buffer(buffer)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(np.diff(np.append(first, n)), pa.int64()), formatted, loss], names=["conv_id", "n_turns", "formatted", "loss"])


def _bounded(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Whole conversations, assembled some BLOCK_BYTES of text at a time, since an index is held for each byte."""
    conv = rows.column("conv_id").combine_chunks()
    ids, void = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
    border = np.append(np.flatnonzero((ids[1:] != ids[:-1]) | (void[1:] != void[:-1])) + 1, len(ids))
    size = np.cumsum(pc.fill_null(pc.binary_length(rows.column("text").combine_chunks()), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ids):
        before = size[at - 1] if at else 0
        to = border[min(len(border) - 1, np.searchsorted(size[border - 1], before + BLOCK_BYTES, "left"))]
        yield _assemble(rows.slice(at, to - at))
        at = int(to)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation; the last one of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_pylist()
        start = len(ids) - 1
        while start and ids[start - 1] == ids[-1]:
            start -= 1
        if start or held and held[-1].column("conv_id")[0].as_py() != ids[0]:
            done = [*held, batch.slice(0, start)] if start else held
            yield from _bounded(pa.Table.from_batches(done))
            held = []
        held.append(batch.slice(start))
    if held:
        yield from _bounded(pa.Table.from_batches(held))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: its formatted bytes and the spans a loss is taken over.

    turns: conv_id long, turn, role string, text string; other columns are ignored. Turns
    stand in the order of turn (nulls first), ties by role, then text; repeated rows are
    turns of their own. A null text or role is empty. Rows without conv_id form one
    conversation, whose id is null. Returns conv_id, n_turns, formatted (UTF-8) and loss:
    byte spans in formatted that hold the escaped texts of the assistant. Texts of any
    length stay whole; no rows give no conversations.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_format, FORMATTED)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of every turn, unescaped."""
    out = []
    for turn in formatted.split(CLOSE)[:-1]:
        head, _, text = turn.partition(b"\n")
        out.append((_role(head[len(OPEN) :]), unescaped(text)))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for formatted, loss in zip(batch.column("formatted"), batch.column("loss").to_pylist()):
            raw = formatted.as_py()
            turns = parse(raw)
            learned = b"".join(unescaped(raw[s["start"] : s["end"]]) for s in loss)
            cols["n_turns"].append(len(turns))
            cols["turns_sha256"].append(hashlib.sha256(b"".join(x for r, t in turns for x in (r, b"\n", t, b"\n"))).hexdigest())
            cols["loss_chars"].append(len(learned.decode()))
            cols["loss_sha256"].append(hashlib.sha256(learned).hexdigest())
            cols["formatted_chars"].append(len(raw.decode()))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in cols.items())], names=["conv_id", *cols])


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what can be read back from format_chats' output."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
