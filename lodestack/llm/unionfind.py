"""Distributed union-find: alternating large-star and small-star steps over an edge table.

Every step is a groupBy-min and a join; each round's edges are written to the
shared folder, so lineage stays short. Nothing but a yes or no a round reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import cut, drop

MAX_ROUNDS = 60


def _star(nbr: DataFrame, keep_smaller: bool) -> DataFrame:
    """nbr(u, v): for each u the least of itself and its neighbours; its neighbours then point there."""
    least = nbr.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = nbr.join(least, "u")
    if keep_smaller:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one root that points nowhere: then the edges are the answer."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
    counted = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return counted.where("up > 1 or (up = 1 and root = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component.

    Self-links and repeated links are ignored, null ends are dropped; an empty
    edge table gives an empty result.
    """
    hi, lo = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    now = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(hi.alias("a"), lo.alias("b")).where("a > b").distinct(), "uf")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, keep_smaller=False)
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), keep_smaller=True)
        after = cut(small, "uf")
        drop(now)
        now = after
    else:
        raise RuntimeError("union-find did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
