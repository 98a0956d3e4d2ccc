"""Corpus pipeline: five stages over the documents table, each calling one
operator of ``renown.llm``.  Every function takes (spark, docs, sf_dir) and
returns a DataFrame; each stage is written as Parquet and read again as the
next one's documents.  Nulls, empty texts, repeated rows, extra columns and
empty tables behave as the operators' docstrings say."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renown.llm import decontaminate, jaccard_join, language, mixing, secrets
from renown.llm.common import table
from renown.session import ensure_checkpoint_dir, ship_package

MIN_LANGUAGE_SCORE = 0.25  # the least possible score among two families of two languages


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: only ``und`` documents (null or letterless texts) go.  With
    the learned two families of two languages the score is the product of two
    best shares of at least 0.5 each, so MIN_LANGUAGE_SCORE rejects no other
    document: texts of a language not learned, and noise of letters, stay."""
    return language.identified(docs, MIN_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of linked documents the row with the smallest id stays (null ids last)."""
    return jaccard_join.one_per_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents with a verified benchmark overlap go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: secrets are replaced, n_chars follows the new text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: passes over the sources to their target weights."""
    return mixing.mix(docs)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("mixing", mix_sources)]

# learned models, substitution-tolerant seeds and hash permutations have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
