"""Runs queries against their SQL, as the driver does: columns by name, rows without order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    return x


def rows_of(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def expected(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    with duckdb.connect() as con:
        con.execute("set timezone = 'UTC'")
        for t in TABLES:
            path = Path(sf_dir) / f"{t}.parquet"
            con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        return sorted(names), rows_of(names, got.fetchall())


def actual(df: DataFrame) -> tuple[list[str], Counter]:
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def difference(spark: SparkSession, f, sql: str, sf_dir: str) -> str:  # noqa: ANN001
    names, want = expected(sql, sf_dir)
    have_names, have = actual(f(spark, sf_dir))
    if names != have_names:
        return f"columns {have_names}, not {names}"
    if want == have:
        return ""
    return f"{sum(have.values())} rows, not {sum(want.values())}; only here {list((have - want).items())[:3]}; missing {list((want - have).items())[:3]}"
