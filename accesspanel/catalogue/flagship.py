"""The headline question over the layers, each written before the next starts from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accesspanel.catalogue import derived
from accesspanel.plans import questions


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts, clean tables, panel and fact as written layers, and the gap in one scan
    of the last. No plan spans more than one layer, so planning stays short."""
    return questions.fragility_gap(derived.staged(spark, sf_dir, "curated.fact_county_year"), derived.YEAR)
