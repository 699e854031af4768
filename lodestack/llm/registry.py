"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import importance_sql, queries_a, queries_b, queries_c, secrets_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in (queries_a, queries_b, queries_c) for name, f in vars(module).items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": secrets_sql.ORACLE, "op12_importance_resample": importance_sql.ORACLE}
