"""Mixing sources to target weights by subset-sum budget fitting.

Targets: all words are shared among the sources by weight; a source gets at
most ``max_repeats`` times its own size, and what it can't take is shared again
by weight until none is above. A source's target is then met by whole repeats
of the source and a subset of its documents for the rest. The subset is fitted
on counts alone: documents are counted by exact length, each length gives its
proportional share, and a bounded-knapsack dynamic programme over what is left
fills the remaining budget to the word if it can. Which documents of a length
are taken is decided by a seeded hash.

Only counts by (source, length) meet in a task, at most as many rows as a
source has lengths. Documents of one source and length are ranked in
sub-buckets of their hash, so that no group of equal lengths lands in one task.

Null text has size 0, a null source is a source of its own that comes last.
Documents of size 0 are never taken. Repeated rows are documents of their own.
Ties are broken by a hash of id and text, so equal rows alone are interchangeable.
Any number of sources; an empty table gives an empty one. Extra columns are
carried along by :func:`mix`, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import cut, n_words, partitions, quoted, require

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20240229
#: Up to so many sources (a row of about 60 bytes each) are sent to all executors.
BROADCAST_SOURCES = 50_000
#: (source, length) groups above this size are ranked in sub-buckets.
GROUP = 4096
#: The dynamic programme's last budget, in multiples of the greatest length left.
REACH = 2


def shares(sizes: list[int], weights: list[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Targets: total size by weight, none above ``max_repeats`` times its size, the excess shared again by weight."""
    caps = [float(max_repeats * s) for s in sizes]
    out = [0.0] * len(sizes)
    free, left = [i for i, w in enumerate(weights) if w > 0], float(sum(sizes))
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > caps[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = caps[i]
        left -= sum(caps[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def fit(lengths: list[int], counts: list[int], budget: int, seed: int) -> list[int]:
    """How many of each length to take so that their sum comes as near to ``budget`` as can be found."""
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    if budget <= 0:
        return [0] * len(lengths)
    taken = [c * budget // total for c in counts]
    left = budget - sum(a * b for a, b in zip(lengths, taken, strict=True))
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    # single documents in seeded order, while far more than one document's length is left
    for i in order:
        if taken[i] < counts[i] and 0 < lengths[i] and left - lengths[i] >= REACH * lengths[i]:
            n = min(counts[i] - taken[i], max(1, (left - REACH * lengths[i]) // lengths[i] // len(order)))
            taken[i] += n
            left -= n * lengths[i]
    for i in sorted(order, key=lambda i: -lengths[i]):
        if lengths[i] > 0 and left > REACH * lengths[i]:
            n = min(counts[i] - taken[i], left // lengths[i] - REACH)
            if n > 0:
                taken[i] += n
                left -= n * lengths[i]
    _knapsack(lengths, counts, taken, left, order)
    return taken


def _knapsack(lengths: list[int], counts: list[int], taken: list[int], left: int, order: list[int]) -> None:
    """Adds to ``taken`` the sub-multiset whose sum is nearest to ``left``: reachable sums as bits, lengths in binary multiples."""
    if left <= 0:
        return
    width = 2 * left + 1
    mask = (1 << width) - 1
    items, reach, history = [], 1, []
    seeded = {i: k for k, i in enumerate(order)}
    for i in sorted(order, key=lambda i: (-lengths[i] if lengths[i] <= left else 1, seeded[i])):
        size, have, k = lengths[i], counts[i] - taken[i], 1
        while have > 0 and 0 < size * min(k, have) < width:
            n = min(k, have)
            items.append((i, n, size * n))
            have -= n
            k *= 2
    for item in items:
        after = (reach | reach << item[2]) & mask
        if after != reach:
            history.append((item, reach))
            reach = after
        if reach >> left & 1:
            break
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    up = left + 1 + ((above & -above).bit_length() - 1) if above else None
    at = up if up is not None and up - left < left - below else below
    for (i, n, size), before in reversed(history):
        if not before >> at & 1:
            taken[i] += n
            at -= size


def _fitter(seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        first = group.iloc[0]
        taken = fit([int(x) for x in group["size"]], [int(x) for x in group["n"]], int(first["budget"]), seed + int(first["rank"]))
        return pd.DataFrame({"rank": group["rank"], "size": group["size"], "n": group["n"], "repeats": group["repeats"], "extra": taken})

    return run


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """rank, source, source_size, target of each source (source, total), whatever their number.

    Ranks come from ranges of the sorted sources and their offsets. The level
    of the targets, words per unit of weight, rises until no source is above
    its limit; a round is one sum over the sources.
    """
    spark = totals.sparkSession
    order = [F.asc_nulls_last("source")]
    dealt = cut(totals.repartitionByRange(partitions(spark), *order).withColumn("pid", F.spark_partition_id()), "mix-sources")
    held = sorted((r.pid, r.n) for r in dealt.groupBy("pid").agg(F.count("*").alias("n")).collect())
    before, at = {}, 0
    for pid, n in held:
        before[pid], at = at, at + n
    if not at:
        return dealt.select(F.lit(0).alias("rank"), "source", F.col("total").alias("source_size"), F.lit(0.0).alias("target"))
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    place = F.row_number().over(Window.partitionBy("pid").orderBy(*order)) - 1
    ranked = dealt.withColumn("rank", place + F.element_at(offsets, F.col("pid")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    table = cut(ranked.select("rank", "source", F.col("total").alias("source_size"), weight.alias("w"), (F.col("total") * max_repeats).cast("double").alias("most")), "mix-ranked")
    of = table.where("w > 0")
    whole = table.agg(F.sum("source_size").alias("size")).first().size
    level, full = 0.0, -1
    while True:
        over = F.col("w") * level > F.col("most") if full >= 0 else F.lit(False)
        got = of.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)).alias("taken"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("free"), F.count_if(over).alias("n")).first()
        if got.n == full or not got.free:
            break
        full, level = got.n, (whole - got.taken) / got.free
    share = F.when(F.col("w") <= 0, 0.0).otherwise(F.least(F.col("w") * level, F.col("most"))) if got.free else F.when(F.col("w") <= 0, 0.0).otherwise(F.col("most"))
    return table.select("rank", "source", "source_size", share.alias("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED, row: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document; its whole row too if ``row``."""
    require(docs, "doc_id", "text", "source")
    kept = [F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")] if row else []
    dice = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    table = cut(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), dice.alias("dice"), *kept), "mix")
    counted = cut(table.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    shared = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")), weights, max_repeats)
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("long")
    budget = F.least(F.round("target").cast("long") - F.col("repeats") * F.col("source_size"), F.col("source_size"))
    of_source = cut(shared.withColumn("repeats", times).withColumn("budget", F.when(F.col("repeats") < max_repeats, budget).otherwise(0)), "mix-targets")
    # beyond this number of sources the same joins are shuffled
    few = of_source.count() <= BROADCAST_SOURCES
    side = (F.broadcast(of_source) if few else of_source).alias("s")
    same = F.col("s.source").eqNullSafe(F.col("c.source"))
    quota = counted.alias("c").join(side, same).where("size > 0").select("rank", "size", "n", "repeats", "budget")
    fitted = quota.groupBy("rank").applyInPandas(_fitter(seed), "rank int, size long, n long, repeats long, extra long")
    fitted = cut(fitted, "mix-fit")

    ranked = table.alias("c").join(side, same).select("c.doc_id", "rank", "c.size", "dice", "source_size", "target", *(["c.row"] if row else []))
    joined = ranked.join(fitted, ["rank", "size"], "left")
    # cells are ranges of the seeded hash, so a document's place doesn't depend on their number: whole cells are in or out, only the one at the edge needs a rank within
    drawn = F.shiftrightunsigned("dice", 33)
    fine = F.floor(drawn * F.ceil(F.col("n") / GROUP) / (1 << 31)).cast("int")
    partial = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    edge = table.alias("c").join(side, same).select("rank", "c.size", "dice").join(fitted.where(partial), ["rank", "size"])
    sizes = edge.groupBy("rank", "size", fine.alias("cell")).agg(F.count("*").alias("held"))
    before = sizes.withColumn("before", F.sum("held").over(Window.partitionBy("rank", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).drop("held")
    whole = joined.where(~F.coalesce(partial, F.lit(False))).withColumn("in", F.coalesce((F.col("extra") == F.col("n")).cast("long"), F.lit(0)))
    split = joined.where(partial).withColumn("cell", fine).join(before, ["rank", "size", "cell"])
    place = F.row_number().over(Window.partitionBy("rank", "size", "cell").orderBy(drawn, "dice", "doc_id"))
    split = split.withColumn("in", (place + F.col("before") <= F.col("extra")).cast("long")).drop("cell", "before")
    both = whole.unionByName(split)
    taken = (F.coalesce("repeats", F.lit(0)) + F.col("in")) * F.col("size")
    return both.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if row else []))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns they came with."""
    chosen = plan(docs, weights, max_repeats, seed, row=True).where("taken > 0")
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return chosen.select("row", F.explode(times).alias("__time")).select("row.*")
