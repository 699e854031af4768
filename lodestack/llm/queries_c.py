"""Queries of the operators on a corpus and its target, vectors and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import hostpaths, importance, whitening
from lodestack.llm.common import sf_table


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(sf_table(spark, sf_dir, "documents"), sf_table(spark, sf_dir, "benchmark"))


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(sf_table(spark, sf_dir, "embeddings"))


def op11_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostpaths.extract(sf_table(spark, sf_dir, "pages"))
