"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it
kept, and returns a DataFrame that is written as Parquet and read again. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.llm.mixing import mixed_rows, tempered_weights, with_places
from roadtrace.llm.neardup import keep_one_of_each
from roadtrace.llm.packing import pack
from roadtrace.llm.quality import keep_quality
from roadtrace.llm.secret_scan import redact_secrets
from roadtrace.session import materialise, table

#: Near duplicates share 80 % of their five-word shingles.
SHINGLE_WORDS, PERCENT = 5, 80
#: Target weights of sources are this power of their characters.
MIX_POWER = 0.5
WINDOW = 1024


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them.

    Texts of any length are judged whole; repeated rows are judged alike; an empty table, or
    one without trusted documents, is no error.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Rows equal in doc_id and text are one document, of which one row stays. A doc_id with
    several texts is several documents: those that are no near duplicates all stay. Rows
    without doc_id, or without words, all stay.
    """
    return keep_one_of_each(docs, SHINGLE_WORDS, PERCENT)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in whole texts are overwritten; n_chars follows. All rows stay, null texts as they are."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once, in the order of the mix: files and rows in them follow the schedule.

    A null source is a source of its own, a null text an empty one; no rows give none.
    """
    return mixed_rows(docs, tempered_weights(docs, MIX_POWER))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, numbered along the mix and filled with lexical neighbours out of a stretch of it.

    A table's files are read in any order, so the places of the mix, which follow from the
    rows alone, are taken again and the windows laid by them: a prefix of the sequences
    holds the sources in their target shares until a source runs dry. Null texts, repeated
    rows and long texts as in pack; no rows give no pieces.
    """
    placed = with_places(docs, tempered_weights(docs, MIX_POWER)).select("row.doc_id", "row.text", "slot", "place")
    return pack(placed, public_tokenizers.path("byte_bpe_50k.json"), WINDOW, order=["slot", "place"])


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact),
    ("mix", mix_sources),
    ("pack", pack_windows),
]

#: SQL expresses neither the join's trees nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
