"""Queries of the operators that compare documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import chaining, linededup, neardup
from lodestack.llm.common import sf_table


def op8_superminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(sf_table(spark, sf_dir, "documents"), width=4, percent=80).drop("th")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicate(sf_table(spark, sf_dir, "documents"), report=True)


def op5_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(sf_table(spark, sf_dir, "documents"))
