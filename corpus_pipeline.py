"""A training corpus from `documents`: five stages, each written and read again before the next.

Null and empty texts pass all stages; the mix takes them like other rows of their source, for no words. Null ids and
sources are groups of their own. Rows that repeat id and text leave one in the second stage. Long texts are worked
whole. Columns beyond those of `documents` are kept, whatever their names; the last stage adds copy_no. An empty table
passes all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm import decontam, forest, mixing, pii, toxicity
from codeatlas.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the severity model judges toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return forest.keep_one(docs, k=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a twentieth or more of their words in benchmark windows go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes [KIND]; n_chars follows the text."""
    clean = pii.redact(docs, pii.extract(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's target asks, with copy_no."""
    return mixing.take(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the fitted model of the first stage; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
