"""What secret and personal-data scans share: span columns, their digests and redaction."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: Rows whose texts are Python strings at a time.
ROWS = 256


def _scan(batches: Iterator[pa.RecordBatch], find: Callable[[str], list[Span]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] if t else [] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, SPAN_TYPE)], names=["doc_id", "spans"])


def scan(docs: DataFrame, find: Callable[[str], list[Span]]) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of every document, in find's order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_scan, find=find), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def digests(found: DataFrame, kinds: list[str]) -> DataFrame:
    """A count of each base kind, the digest of all base spans, all spans as text, and whether there is any."""
    counts = [F.size(of_kinds(F.col("spans"), [k])).cast("long").alias(f"n_{k}") for k in kinds]
    base = F.sha2(written(of_kinds(F.col("spans"), kinds)), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, written(F.col("spans")).alias("spans"), (F.size("spans") > 0).alias("found"))


def replaced(text: str, spans: list[Span], mark: Callable[[str], str]) -> str:
    """The text with every span, overlapping ones as one, replaced by its mark."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], mark(kind)]
        at = end
    return "".join([*out, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch], find: Callable[[str], list[Span]], mark: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            texts = [replaced(t, s, mark) if t and (s := find(t)) else t for t in part.column("text").to_pylist()]
            k = part.schema.get_field_index("text")
            yield part.set_column(k, "text", pa.array(texts, part.schema.field(k).type))


def redact(docs: DataFrame, find: Callable[[str], list[Span]], mark: Callable[[str], str]) -> DataFrame:
    """The same rows and columns, the spans in text replaced by their marks; null texts stay null."""
    return docs.mapInArrow(partial(_redact, find=find, mark=mark), docs.schema)
