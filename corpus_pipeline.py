"""From raw documents to packed training sequences: stages that run one after another, each on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm import exact_dedup, near_dedup, packing, pii, quality_rules
from tapeworks.llm.common import materialise, table
from tapeworks.session import clear, tables


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.stage(spark, docs, sf_dir)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.stage(spark, docs, sf_dir)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.stage(spark, docs, sf_dir)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    return pii.stage(spark, docs, sf_dir)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.stage(spark, docs, sf_dir)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Iterated estimates, sketches and packing are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next stage, and what only led to it is deleted."""
    docs, others = table(spark, sf_dir, "documents"), tables(spark)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear(spark, {x for x in tables(spark) - others if f"/pipeline-{name}-" not in x})
    return STAGES[-1][1](spark, docs, sf_dir)
