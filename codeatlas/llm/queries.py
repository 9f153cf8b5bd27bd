"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collisions, ctw, decontam, fim, forest, html_text, langid, mixing, pii, quality, ranked, rules, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.extract(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=True)
    return found.drop("items", "row_key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_context_tree": op2_context_tree,
        "op3_pii": op3_pii,
        "op4_quality": op4_quality,
        "op5_collisions": op5_collisions,
        "op6_minhash_forest": op6_minhash_forest,
        "op7_decontamination": op7_decontamination,
        "op8_mixing": op8_mixing,
        "op9_html": op9_html,
        "op10_language": op10_language,
        "op11_rules": op11_rules,
        "op12_fim": op12_fim,
        "op13_ranked": op13_ranked,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_decontamination": decontam.ORACLE_SQL,
        "op8_mixing": mixing.ORACLE_SQL,
        "op12_fim": fim.ORACLE_SQL,
        "op13_ranked": ranked.ORACLE_SQL,
    }
