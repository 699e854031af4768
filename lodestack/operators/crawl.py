"""Breadth-first crawl of a tree that is given as listings: which entries each folder shows.

One round a level: the level's new folders meet the listings by a join, so the
work of a round is that of its entries, and the depth isn't limited. A folder
is opened once, at its first entry in breadth-first order, wherever else it is
listed; if that entry's title is excluded it is never opened, and nothing below
it is seen unless another way leads there. Loops therefore end.

Each round's entries are written to the shared folder before the next begins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.stored import scratch


def crawl(listings: DataFrame, root: str, excluded: Column, max_nodes: int | None = None, max_rounds: int = 10_000) -> DataFrame:
    """uid, parent_uid, level, title, folder, href, path of all entries that are seen, excluded ones left out.

    listings: parent (the folder that shows the entry), seq (its place there),
    title, folder (what it opens, null for none), href. ``excluded`` is a
    condition on title. ``uid`` sorts as breadth-first order does. More than
    ``max_nodes`` entries are an error.
    """
    shown = listings.select("parent", F.col("seq").cast("long").alias("seq"), F.coalesce("title", F.lit("(untitled)")).alias("title"), "folder", "href").withColumn("excluded", F.coalesce(excluded, F.lit(False)))
    step = lambda c: F.format_string("%010d", c)
    level = scratch(shown.where(F.col("parent") == root).select(step(F.col("seq")).alias("uid"), F.lit(None).cast("string").alias("parent_uid"), F.lit(0).alias("level"), "title", "folder", "href", "excluded", F.array("title").alias("path")), "crawl")
    levels, visited, seen = [], None, 0
    for depth in range(max_rounds):
        kept = level.where(~F.col("excluded"))
        n = kept.count()
        seen += n
        if max_nodes is not None and seen > max_nodes:
            raise ValueError(f"more than {max_nodes} nodes at depth {depth}")
        levels.append(kept.drop("excluded"))
        if not n:
            break
        # of a folder's entries on this level the first decides
        first = level.where(F.col("folder").isNotNull()).groupBy("folder").agg(F.min_by(F.struct("uid", "excluded", "path"), "uid").alias("f"))
        fresh = first if visited is None else first.join(visited, "folder", "left_anti")
        fresh = scratch(fresh.select("folder", "f.*"), "crawl-folders")
        visited = fresh.select("folder") if visited is None else visited.union(fresh.select("folder"))
        below = shown.join(fresh.where(~F.col("excluded")).select(F.col("folder").alias("parent"), F.col("uid").alias("parent_uid"), F.col("path").alias("above")), "parent")
        level = scratch(below.select(F.concat_ws(".", "parent_uid", step(F.col("seq"))).alias("uid"), "parent_uid", F.lit(depth + 1).alias("level"), "title", "folder", "href", "excluded", F.concat("above", F.array("title")).alias("path")), "crawl")
    else:
        raise ValueError(f"deeper than {max_rounds} levels")
    return reduce(DataFrame.unionByName, levels)


def closure(nodes: DataFrame, ident: str, parent: str, max_rounds: int = 40) -> DataFrame:
    """(ancestor, node, distance) pairs of a forest, each node its own ancestor at distance 0.

    Paths double in length each round, so a tree of depth d takes log2(d)
    rounds. A loop is an error.
    """
    own = nodes.select(F.col(ident).alias("ancestor"), F.col(ident).alias("node"), F.lit(0).cast("long").alias("distance"))
    steps = scratch(nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias("ancestor"), F.col(ident).alias("node"), F.lit(1).cast("long").alias("distance")), "closure")
    # only parents that are nodes themselves
    known = steps.join(nodes.select(F.col(ident).alias("ancestor")), "ancestor", "left_semi")
    pairs, reach = scratch(known, "closure"), 1
    for _ in range(max_rounds):
        if not pairs.where("ancestor = node").isEmpty():
            raise ValueError("the tree has a loop")
        # a path longer than reach is one of exactly reach, then one more
        far = pairs.where(F.col("distance") == reach).select("ancestor", F.col("node").alias("via"))
        more = far.join(pairs.select(F.col("ancestor").alias("via"), "node", "distance"), "via").select("ancestor", "node", (F.col("distance") + reach).alias("distance"))
        more = scratch(more, "closure")
        if more.isEmpty():
            return own.unionByName(pairs)
        pairs, reach = scratch(pairs.unionByName(more), "closure"), 2 * reach
    raise ValueError("the tree is too deep or has a loop")
