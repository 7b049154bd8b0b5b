"""A corpus pipeline of five stages: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of documents. `run` applies them in turn; between stages, the rows are written to the shared checkpoint folder, as a
scheduler that stores each stage's output would do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import lang_id, line_templates, mixing, near_texts, packing, tokens
from lodestar.llm.common import shared_dir, small_batches, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents that are not held out. Texts without a letter and ambiguous ones go."""
    small_batches(spark)
    model = lang_id.train(docs)
    found = lang_id.predict(docs, model, docs.columns, ("_lang", "_score", "_ambiguous"))
    sure = (F.col("_lang") != lang_id.UNDETERMINED) & ~F.col("_ambiguous")
    return found.where(sure).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; documents with nothing else go whole."""
    small_batches(spark)
    cleaned = line_templates.drop_lines(docs, ("_lines", "_dropped"))
    left = (F.col("_dropped") == 0) | (F.trim("text") != "")
    return _measured(cleaned.where(left).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return near_texts.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that is taken twice stands there twice."""
    small_batches(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed in sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, tokens.default_vocabulary())


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
