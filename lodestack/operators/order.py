"""Numbers of rows in an order, without a window over all of them.

Rows are sorted by range over all tasks and written with their place in their
partition; a group's rows follow one another, so a row's number is its place
plus the rows that the group has in the partitions before: a table with a row
for each group and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.stored import scratch

#: monotonically_increasing_id() has the partition above this many bits and the place in it below.
PLACE_BITS = 33


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "row_no", few: bool = False) -> DataFrame:
    """``rows`` with their number from 0 within ``by``, in ``order``; ties get numbers next to each other.

    ``by`` may be empty; null keys are a group of their own. With ``few`` groups
    the table of partitions is broadcast, so wide rows are not shuffled again.
    """
    keys = [F.col(c) for c in by]
    held = scratch(rows.orderBy(*keys, *order).withColumn("__mid", F.monotonically_increasing_id()), "numbered")
    placed_path = held._scratch_path
    placed = held.withColumn("__part", F.shiftright("__mid", PLACE_BITS))
    parts = placed.groupBy(*by, "__part").agg(F.count("*").alias("__held"), F.min("__mid").alias("__first"))
    w = (Window.partitionBy(*by) if by else Window).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), (F.coalesce(F.sum("__held").over(w), F.lit(0)) - F.col("__first")).alias("__shift"))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    out = placed.join(F.broadcast(shift) if few else shift, same).select(*rows.columns, (F.col("__mid") + F.col("__shift")).alias(name))
    out._scratch_path = placed_path
    return out


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """For each group the values at some ranks (from 1, told in terms of ``n``, the group's size): exact percentiles of groups of any size. Rows without a group are left out."""
    if not by:
        raise ValueError("ranks are those of groups")
    held = numbered(rows.select(*by, value), by, [value], "__no")
    sizes = held.groupBy(*by).agg(F.count("*").alias("n"))
    placed = held.join(sizes, by)
    wanted = {name: (F.col("__no") + 1) == at.cast("long") for name, at in ranks.items()}
    return placed.groupBy(*by).agg(*[F.max(F.when(hit, F.col(value))).alias(name) for name, hit in wanted.items()])
