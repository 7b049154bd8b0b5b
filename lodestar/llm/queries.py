"""Queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import arrow_shards, compact_windows, golay_simhash, jpeg_media, lang_id, line_templates, mixing, packing, preference, sorted_projection, tokens
from lodestar.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_lines(docs)


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.repeated_answer_pairs(table(spark, sf_dir, "conversations"))
    return preference.format_pairs(pairs).withColumnRenamed("pair_id", "conv_id")


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


def op5_sorted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_projection.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.default_vocabulary())


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.stored_digest(table(spark, sf_dir, "documents"))


def op9_arrow_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_shards.index(table(spark, sf_dir, "documents"), tokens.default_vocabulary())


def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language_id, op2_line_templates, op3_preference_pairs, op4_compact_windows, op5_sorted_projection, op6_best_fit_packing, op7_source_mixing, op8_jpeg_media, op9_arrow_shards, op10_golay_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op3_preference_pairs": preference.ORACLE_SQL, "op7_source_mixing": mixing.ORACLE_SQL}
