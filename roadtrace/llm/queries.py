"""The queries of the training-data operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.llm import sharding, urls_sql
from roadtrace.llm.chat import format_chats, read_back
from roadtrace.llm.image_match import find_copies, rendered
from roadtrace.llm import lexical_search
from roadtrace.llm.mixing import mix, tempered_weights
from roadtrace.llm.neardup import near_duplicates
from roadtrace.llm.packing import pack
from roadtrace.llm.periodic_runs import find_runs, longest, with_planted_periods
from roadtrace.llm.personal_data import BASE_KINDS as PERSONAL_KINDS
from roadtrace.llm.personal_data import find_personal_data
from roadtrace.llm.quality import judge_quality
from roadtrace.llm.sentence_pieces import encode
from roadtrace.session import materialise, table
from roadtrace.llm.secret_scan import BASE_KINDS as SECRET_KINDS
from roadtrace.llm.secret_scan import find_secrets
from roadtrace.llm.spans import digests
from roadtrace.llm.url_reputation import filter_urls


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(rendered(table(spark, sf_dir, "embeddings")))


def op2_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return read_back(format_chats(turns.unionByName(more)))


def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_chosen_path_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), urls_sql.RULES)


def op7_slot_table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", sharding.SHARDS, sharding.SLOTS).select("doc_id", "slot", "shard")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_secrets(table(spark, sf_dir, "documents")), SECRET_KINDS)


#: Target weights of sources are this power of their characters.
MIX_POWER = 0.5


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, tempered_weights(docs, MIX_POWER))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_personal_data(table(spark, sf_dir, "documents")), PERSONAL_KINDS)


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), back=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = longest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialise(lexical_search.build_index(table(spark, sf_dir, "documents")), "lexical-index")
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_image_copies": op1_image_copies,
        "op2_ngram_quality": op2_ngram_quality,
        "op3_chat_format": op3_chat_format,
        "op4_bm25_packing": op4_bm25_packing,
        "op5_chosen_path_near_duplicates": op5_chosen_path_near_duplicates,
        "op6_host_reputation": op6_host_reputation,
        "op7_slot_table_sharding": op7_slot_table_sharding,
        "op8_secret_scan": op8_secret_scan,
        "op9_pfair_mixing": op9_pfair_mixing,
        "op10_personal_data": op10_personal_data,
        "op11_sentence_pieces": op11_sentence_pieces,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_host_reputation": urls_sql.SQL,
        "op7_slot_table_sharding": sharding.oracle("documents", "doc_id", sharding.SHARDS, sharding.SLOTS),
        "op13_lexical_search": lexical_search.SQL,
    }
