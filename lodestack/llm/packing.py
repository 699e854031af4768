"""Variable-capacity best-fit packing.

Documents longer than the greatest capacity are cut into pieces of that length
(the last one shorter). Pieces are dealt by a hash into shards of about
``shard_rows`` and each shard is packed on its own: longest first, each piece
into the open bin that it fills best. If none has room, a bin of the least-cost
size is opened: for each permitted size the bin is filled in thought with the
pieces still to come, greedily, and the size with the least cost a token (after
downsizing) is taken. This plan competes with those that open every bin at one
least size; the cheapest in the end stays. Finally every bin is downsized to
the least permitted size that holds its contents.

A bin costs its capacity plus ``overhead``. Waste at a shard's edge is less
than one bin of each kind in ``shard_rows`` pieces.

Shards depend on the rows alone (id, text, piece and number among equal rows),
never on how they are dealt to tasks, so reruns agree. Null or empty texts have
no tokens and no piece. Repeated rows are pieces of their own; ties go by
doc_id, hash of the text, piece, number. An empty table gives an empty one.
Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import GAP, cut, n_words, require

CAPACITIES = (256, 512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
SHARD_ROWS = 40_000
PACKED = "shard long, bin long, capacity long, fill long, slot long, at long, doc_id long, th long, copy long, piece long, length long"


def best_fit(lengths: list[int], capacities: tuple[int, ...], least: int) -> tuple[list[int], list[int]]:
    """(bin of each length, fill of each bin); lengths in falling order. A new bin has at least the capacity ``least``."""
    room: list[tuple[int, int]] = []
    fill: list[int] = []
    where = []
    for n in lengths:
        i = bisect_left(room, (n, -1))
        if i < len(room):
            left, b = room.pop(i)
        else:
            left, b = max(least, capacities[bisect_left(capacities, n)]), len(fill)
            fill.append(0)
        fill[b] += n
        where.append(b)
        if left > n:
            insort(room, (left - n, b))
    return where, fill


def least_cost(n: int, lengths: list[int], counts: dict[int, int], capacities: tuple[int, ...], overhead: int) -> int:
    """The size to open for a piece of length ``n``; ``lengths``: the distinct lengths to come, rising, ``counts``: how many of each."""
    best, size = None, n
    for c in capacities[bisect_left(capacities, n) :]:
        room, at = c - n, len(lengths)
        while room > 0:
            at = bisect_right(lengths, room, 0, at) - 1
            if at < 0:
                break
            room -= lengths[at] * min(counts[lengths[at]], room // lengths[at])
        price = (capacities[bisect_left(capacities, c - room)] + overhead) / (c - room)
        if best is None or price <= best:
            best, size = price, c
    return size


def best_fit_priced(lengths: list[int], capacities: tuple[int, ...], overhead: int) -> tuple[list[int], list[int]]:
    """As :func:`best_fit`, but each new bin has the size that :func:`least_cost` finds."""
    counts: dict[int, int] = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    rising = sorted(counts)
    known: dict[int, int] = {}
    room: list[tuple[int, int]] = []
    fill: list[int] = []
    where = []
    for n in lengths:
        counts[n] -= 1
        if not counts[n]:
            rising.pop()  # lengths fall, so the greatest is used up first
            known.clear()
        i = bisect_left(room, (n, -1))
        if i < len(room):
            left, b = room.pop(i)
        else:
            # bins of one length differ in price only by the last few of its own pieces
            if n not in known:
                known[n] = least_cost(n, rising, counts, capacities, overhead)
            left, b = known[n], len(fill)
            fill.append(0)
        fill[b] += n
        where.append(b)
        if left > n:
            insort(room, (left - n, b))
    return where, fill


def cost(fill: list[int], capacities: tuple[int, ...], overhead: int) -> tuple[int, list[int]]:
    """Total cost of the downsized bins, and their capacities."""
    sizes = [capacities[bisect_left(capacities, f)] for f in fill]
    return sum(sizes) + overhead * len(sizes), sizes


def pack_shard(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin of each length, capacity of each bin, fill of each bin) of the cheapest plan; lengths in falling order."""
    best = None
    for least in (None, *capacities):
        where, fill = best_fit(lengths, capacities, least) if least else best_fit_priced(lengths, capacities, overhead)
        total, sizes = cost(fill, capacities, overhead)
        if best is None or total < best[0]:
            best = (total, where, sizes, fill)
    return best[1:]


def _packer(capacities: tuple[int, ...], overhead: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "th", "piece", "copy"], ascending=[False, True, True, True, True], na_position="first", kind="stable").reset_index(drop=True)
        where, sizes, fill = pack_shard(group["length"].tolist(), capacities, overhead)
        where = np.asarray(where)
        order = np.argsort(where, kind="stable")
        group, where = group.iloc[order], where[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1))
        ends = np.cumsum(group["length"].to_numpy())
        begins = ends - group["length"].to_numpy()
        runs = np.diff(np.append(first, len(where)))
        return group.assign(bin=where, capacity=np.asarray(sizes)[where], fill=np.asarray(fill)[where], slot=np.arange(len(where)) - np.repeat(first, runs), at=begins - np.repeat(begins[first], runs))

    return run


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: shard and bin it is packed in, the bin's capacity and fill, the piece's slot and offset in it."""
    require(docs, "doc_id", "text")
    capacities = tuple(sorted(set(capacities)))
    top = capacities[-1]
    words = n_words(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words.alias("n")).where("n > 0")
    # equal rows meet as a count and are numbered from it
    counted = rows.groupBy("doc_id", "th", "n").agg(F.count("*").alias("copies"))
    numbered = counted.select("doc_id", "th", "n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    pieces = numbered.select("doc_id", "th", "copy", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top))).alias("piece"))
    pieces = cut(pieces.select("doc_id", "th", "copy", "piece", F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("length")), "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    dealt = pieces.select(F.pmod(F.xxhash64("doc_id", "th", "piece", "copy"), F.lit(shards)).alias("shard"), "doc_id", "th", "copy", "piece", "length")
    return dealt.groupBy("shard").applyInPandas(_packer(capacities, overhead), PACKED)


def sequences(docs: DataFrame, packed: DataFrame, ids: Column | None = None, top: int | None = None) -> DataFrame:
    """One row per bin: shard, bin, capacity, fill, doc_ids, tokens and segments (number of the piece that each token is of).

    ``ids``: the tokens of a document as array<int>, by default the words'
    hashes; their number must be what was packed. ``top``: the greatest
    capacity that was packed with. A bin meets in one row, which its capacity
    bounds.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), GAP, -1), lambda w: w != "")
    ids = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(1 << 31)).cast("int")) if ids is None else ids
    top = top or CAPACITIES[-1]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), ids.alias("ids")).dropDuplicates(["doc_id", "th"])
    named = texts.join(packed.select("doc_id", "th", "shard", "bin", "capacity", "fill", "slot", "piece", "length"), ["th"]).where(texts.doc_id.eqNullSafe(packed.doc_id))
    of_piece = F.slice("ids", (F.col("piece") * top + 1).cast("int"), F.col("length").cast("int"))
    held = named.select("shard", "bin", "capacity", "fill", F.struct("slot", texts.doc_id.alias("doc_id"), of_piece.alias("ids")).alias("p"))
    bins = held.groupBy("shard", "bin", "capacity", "fill").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return bins.select("shard", "bin", "capacity", "fill", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.flatten(F.transform("p", lambda x: x["ids"])).alias("tokens"), F.flatten(F.transform("p", lambda x, i: F.array_repeat(i, F.size(x["ids"])))).alias("segments"))
