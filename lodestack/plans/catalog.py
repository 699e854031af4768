"""All queries of the engine, with the SQL that says what each must return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.plans import q_acquire, q_corpus, q_incremental, q_rules, q_runs, q_search, q_sources, q_text, q_tools, registry

MODULES = (q_search, q_corpus, q_incremental, q_text, q_acquire, q_rules, q_runs, q_sources, q_tools)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_search.hybrid_search(spark, sf_dir)
