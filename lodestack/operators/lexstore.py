"""A stored inverted index: built once for all sources, opened, and read by term and block.

Rows of a source are numbered in the order of their ids. A term's postings are
cut into blocks of a fixed range of row numbers, the same grid for all terms:

* ``postings``: source_id, bucket, term, block, n, most (the greatest score
  part in the block, but for idf), rows, tfs, norms and places (of each
  occurrence: column * 2**32 + position);
* ``terms``: source_id, bucket, term, df, blocks, most;
* ``rows``: source_id, row_no, row_id, length; ``sources``: source_id, n, mean.

Rows are sorted by range once, with their tokens; each task turns its rows into
pieces of postings, so what is shuffled by term is postings, not single tokens.
Postings are range-partitioned by (source, bucket, term, block) when written,
so a frequent term is spread over tasks and files; folders are by source and
bucket, so a query lists and reads only the buckets of its own terms.

A query adds the block maxima of its terms, block by block: an upper bound.
The blocks of the highest bounds are scored first; blocks whose bound can't
reach the k-th score found there are never decoded. The result is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import stored
from lodestack.operators.lexical import K1, LEAST_IDF, B, bm25, top
from lodestack.operators.order import numbered

FORMAT = "postings-1"
#: Rows of a block, buckets of terms in a source.
BLOCK_ROWS, BUCKETS = 8192, 256
#: Blocks that are scored before the others are held against the k-th score.
FIRST_BLOCKS = 64
#: Tokens that a task inverts, or places that it joins, at a time; the pieces of a block are joined when postings are written.
PIECE_TOKENS = 1_000_000
#: Parts of the buckets that are shuffled and written one after another.
PASSES = 4
#: Bounds are sums of doubles in another order than scores.
SLACK = 1e-9
_POSTINGS = "term string, block long, n int, most double, rows array<int>, tfs array<int>, norms array<double>, places array<array<long>>, source_id string, bucket int"
_TERMS = "term string, df long, blocks long, most double, source_id string, bucket int"
_COLUMN_BITS = 32


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(tokens: DataFrame, path: str, *, block_rows: int = BLOCK_ROWS, buckets: int = BUCKETS) -> None:
    """Index of ``tokens`` (source_id, row_id, col, tokens) for every source at once; ``path`` must not exist."""
    spark = tokens.sparkSession
    # dealt out once, by range of rows: their numbers and their postings are made where they lie
    # (a source that is the same everywhere would be folded away, and with it the range that the grouping and the numbering rely on)
    opaque = F.concat("source_id", F.coalesce(F.substring(F.col("row_id").cast("string"), 1, 0), F.lit("")))
    whole = tokens.withColumn("source_id", opaque).repartitionByRange("source_id", "row_id").groupBy("source_id", "row_id").agg(F.sort_array(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), "tokens"))).alias("parts"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.coalesce(F.size(p["tokens"]), F.lit(0)))
    held = numbered(whole.withColumn("length", length), ["source_id"], ["row_id"], few=True)
    held.select("source_id", "row_no", "row_id", "length").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    rows.groupBy("source_id").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).coalesce(1).write.parquet(f"{path}/sources")
    sources = spark.read.parquet(f"{path}/sources")

    inverted = held.select("source_id", "row_no", "length", "parts").mapInArrow(_inverted(block_rows), "source_id string, term string, block long, first long, rows array<int>, ends array<int>, lengths array<int>, places array<long>")
    bucketed = inverted.withColumn("bucket", _bucket(F.col("term"), buckets))
    pieces = stored.scratch(bucketed.withColumn("pass", F.col("bucket") % PASSES), "pieces", "pass")
    stored.drop(held)
    order = ["source_id", "bucket", "term", "block"]
    # some buckets at a time, so that no more than their part is on disk twice
    for i in range(PASSES):
        joined = _joined(pieces.where(F.col("pass") == i), sources, order).sortWithinPartitions(*order)
        stored.tidily(spark, lambda joined=joined: joined.write.mode("append").option("compression", "zstd").partitionBy("source_id", "bucket").parquet(f"{path}/postings"))
        stored.drop(pieces, f"pass={i}")
    stored.drop(pieces)
    known = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").groupBy("source_id", "bucket", "term").agg(F.sum("n").cast("long").alias("df"), F.count("*").alias("blocks"), F.max("most").alias("most"))
    known.repartitionByRange("source_id", "bucket", "term").sortWithinPartitions("source_id", "bucket", "term").write.partitionBy("source_id", "bucket").parquet(f"{path}/terms")
    stored.close(spark, path, {"format": FORMAT, "block_rows": block_rows, "buckets": buckets, "k1": K1, "b": B})


def _joined(pieces: DataFrame, sources: DataFrame, order: list[str]) -> DataFrame:
    """Postings: the pieces of each block put together in order of their rows, where the range has dealt them."""
    with_mean = pieces.join(F.broadcast(sources.select("source_id", "mean")), "source_id").select(*order, "first", "mean", "rows", "ends", "lengths", "places")
    return with_mean.repartitionByRange(*order).sortWithinPartitions(*order, "first").mapInArrow(_joined_rows, "source_id string, bucket int, " + _POSTINGS.removesuffix(", source_id string, bucket int"))


def _joined_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of pieces in order; the pieces of a block follow one another, and it may go on in the next batch."""
    kept: pa.RecordBatch | None = None
    for batch in batches:
        held = batch if kept is None else pa.concat_batches([kept, batch])
        if not held.num_rows:
            continue
        code = lambda c, held=held: held.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
        keys = [code("source_id"), code("term"), held.column("block").to_numpy()]
        first = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        yield from _blocks(held, first[:-1], int(first[-1]))
        kept = held.slice(int(first[-1]))
    if kept is not None:
        yield from _blocks(kept, np.zeros(1, np.int64), kept.num_rows)


def _blocks(held: pa.RecordBatch, first: np.ndarray, until: int) -> Iterator[pa.RecordBatch]:
    """A posting for each block of the pieces before ``until``, blocks of about PIECE_TOKENS places at a time; ``first`` tells where a block's pieces begin."""
    if not until:
        return
    before = np.cumsum(pc.list_value_length(held.column("places")).to_numpy()[:until])
    begin = 0
    while begin < len(first):
        done = int(before[first[begin] - 1]) if first[begin] else 0
        end = max(begin + 1, int(np.searchsorted(first, np.searchsorted(before, done + PIECE_TOKENS, "right"), "right")) - 1)
        end = len(first) if before[-1] - done <= PIECE_TOKENS else end
        stop = int(first[end]) if end < len(first) else until
        yield _postings(held.slice(int(first[begin]), stop - int(first[begin])), first[begin:end] - first[begin])
        begin = end


def _postings(held: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
    """Lists that follow one another are joined by their outer offsets alone."""
    size = lambda c: pc.list_value_length(held.column(c)).to_numpy().astype(np.int64)
    flat = lambda c: held.column(c).flatten()
    n, n_places = size("rows"), size("places")
    ends = flat("ends").to_numpy() + np.repeat(np.cumsum(n_places) - n_places, n)
    tfs = np.diff(np.r_[0, ends])
    norms = K1 * (1 - B + B * flat("lengths").to_numpy() / np.repeat(held.column("mean").to_numpy(), n))
    bounds = np.r_[(np.cumsum(n) - n)[first], n.sum()]
    most = np.maximum.reduceat(tfs * (K1 + 1) / (tfs + norms), bounds[:-1])
    lists = lambda values: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
    places = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), flat("places"))
    key = lambda c: held.column(c).take(pa.array(first))
    columns = [key("source_id"), key("bucket"), key("term"), key("block"), pa.array(np.diff(bounds), pa.int32()), pa.array(most), lists(flat("rows")), lists(pa.array(tfs, pa.int32())), lists(pa.array(norms)), lists(places)]
    return pa.RecordBatch.from_arrays(columns, names=["source_id", "bucket", "term", "block", "n", "most", "rows", "tfs", "norms", "places"])


def _runs(source: pa.Array, number: np.ndarray, sizes: np.ndarray, block_rows: int) -> Iterator[tuple[int, int]]:
    """Rows that follow one another within a block of a source, PIECE_TOKENS tokens at a time."""
    code = source.dictionary_encode(null_encoding="encode").indices.to_numpy()
    breaks = (np.diff(code) != 0) | (np.diff(number) != 1) | (np.diff(number // block_rows) != 0)
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and (breaks[i - 1] or held + n > PIECE_TOKENS):
            yield begin, i
            begin, held = i, 0
        held += n
    if len(number):
        yield begin, len(number)


def _inverted(block_rows: int):
    """Pieces of postings of rows in order: the terms of each run of rows with the rows that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, number, length, parts = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            col, lists = parts.flatten().flatten()
            owner = np.repeat(np.arange(len(number)), pc.list_value_length(parts).to_numpy())
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            terms, ends = lists.flatten(), np.cumsum(sizes)
            place = np.arange(len(terms)) - np.repeat(ends - sizes, sizes) + (np.repeat(col.to_numpy().astype(np.int64), sizes) << _COLUMN_BITS)
            row = np.repeat(owner, sizes)
            edge = np.searchsorted(row, np.arange(len(number) + 1))
            for i, j in _runs(source, number, np.diff(edge), block_rows):
                s, e = int(edge[i]), int(edge[j])
                if s == e:
                    continue
                named = terms.slice(s, e - s).dictionary_encode(null_encoding="encode")
                code = named.indices.to_numpy()
                order = np.lexsort((place[s:e], row[s:e], code))
                c, r, p = code[order], row[s:e][order], place[s:e][order]
                at = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])])
                ends = np.r_[at[1:], len(c)]
                first = np.flatnonzero(np.r_[True, c[at][1:] != c[at][:-1]])
                lists_of = lambda values, first=first, n=len(at): pa.ListArray.from_arrays(pa.array(np.r_[first, n], pa.int32()), values)
                block, k = int(number[i]) // block_rows, len(first)
                # places of a term follow one another; its rows tell where theirs end
                opened = at[first]
                ends = ends - np.repeat(opened, np.diff(np.r_[first, len(at)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(source[i], k), named.dictionary.take(pa.array(c[at][first])), pa.repeat(pa.scalar(block, pa.int64()), k), pa.repeat(pa.scalar(int(number[i]), pa.int64()), k),
                        lists_of(pa.array(number[r[at]] - block * block_rows, pa.int32())), lists_of(pa.array(ends, pa.int32())), lists_of(pa.array(length[r[at]], pa.int32())),
                        pa.ListArray.from_arrays(pa.array(np.r_[opened, len(c)], pa.int32()), pa.array(p, pa.int64())),
                    ],
                    names=["source_id", "term", "block", "first", "rows", "ends", "lengths", "places"],
                )

    return run


@dataclass(frozen=True)
class _Source:
    n: int
    mean: float


class LexicalStore:
    """A stored index, opened: its files are those of its manifest."""

    def __init__(self, spark: SparkSession, path: str, sources: set[str] | None = None, verify: bool = False) -> None:
        head = stored.header(spark, path)
        if (head.get("format"), head.get("k1"), head.get("b")) != (FORMAT, str(K1), str(B)):
            raise stored.StoredError(f"{path} is an index of another kind: {head}")
        stored.require_whole(spark, path, hashed=verify)
        self.spark, self.path = spark, path
        self.block_rows, self.buckets = int(head["block_rows"]), int(head["buckets"])
        self.rows = spark.read.parquet(f"{path}/rows")
        self.sources = {r.source_id: _Source(r.n, r.mean) for r in spark.read.parquet(f"{path}/sources").collect()}
        if sources is not None and set(self.sources) != sources:
            raise stored.StoredError(f"index of {sorted(self.sources)}, not of {sorted(sources)}")
        self.postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
        self.terms = spark.read.schema(_TERMS).parquet(f"{path}/terms")

    def _mine(self, table: DataFrame, source: str, terms: list[str]) -> DataFrame:
        """Rows of a source's terms: folders by bucket, row groups by term."""
        folders = F.col("bucket").isin(*[_bucket(F.lit(t), self.buckets) for t in terms])
        return table.where((F.col("source_id") == source) & folders & F.col("term").isin(terms))

    def read_files(self, source: str, terms: list[str]) -> DataFrame:
        """(file, length) of the files that a query of these terms opens."""
        return self._mine(self.postings, source, terms).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length")).distinct()

    def statistics(self, source: str, terms: list[str]) -> dict[str, tuple[int, int, float]]:
        """df, blocks and greatest part of each term that the source has: one small table read."""
        if source not in self.sources:
            return {}
        return {r.term: (r.df, r.blocks, r.most) for r in self._mine(self.terms, source, terms).select("term", "df", "blocks", "most").collect()}

    def positional(self, source: str, terms: list[str]) -> DataFrame:
        """Postings as (source_id, term, row_id, col, positions), for phrases."""
        mine = self._mine(self.postings, source, terms)
        spread = mine.select("source_id", "term", "block", F.explode(F.arrays_zip("rows", "places")).alias("e")).select("source_id", "term", (F.col("block") * self.block_rows + F.col("e.rows")).alias("row_no"), F.col("e.places").alias("places"))
        # a posting has all places of its term in its row, so its columns are told apart where it lies
        column = lambda p: F.shiftright(p, _COLUMN_BITS).cast("int")
        each = spread.select("source_id", "term", "row_no", "places", F.explode(F.array_distinct(F.transform("places", column))).alias("col"))
        low = F.lit((1 << _COLUMN_BITS) - 1).cast("long")
        by_col = each.select("source_id", "term", "row_no", "col", F.transform(F.filter("places", lambda p: column(p) == F.col("col")), lambda p: p.bitwiseAND(low).cast("int")).alias("positions"))
        return by_col.withColumnRenamed("row_no", "row_id")

    def _scored(self, source: str, weights: dict[str, float], blocks: Column | DataFrame) -> DataFrame:
        """(row_no, score) of the rows of some blocks that hold every term."""
        mine = self._mine(self.postings, source, list(weights))
        mine = mine.where(blocks) if isinstance(blocks, Column) else mine.join(blocks, "block", "left_semi")
        weight = _looked_up(weights)
        e = mine.select("block", "term", F.explode(F.arrays_zip("rows", "tfs", "norms")).alias("e"))
        part = weight * F.col("e.tfs") * (K1 + 1) / (F.col("e.tfs") + F.col("e.norms"))
        hits = e.groupBy("block", F.col("e.rows").alias("row")).agg(F.sum(part).alias("score"), F.count("*").alias("held"))
        return hits.where(F.col("held") == len(weights)).select((F.col("block") * self.block_rows + F.col("row")).alias("row_no"), "score")

    def search(self, source: str, phrases: list[list[str]], k: int, pool: DataFrame | None = None) -> DataFrame:
        """(row_id, score, rank) of the k best rows that hold every phrase, among those of ``pool`` (row_id) if given.

        Ties go to the lower id. Statistics are those of the whole source.
        """
        nothing = self.rows.select("row_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        wanted = sorted({t for p in phrases for t in p})
        found = self.statistics(source, wanted) if wanted else {}
        if not wanted or len(found) < len(wanted):
            return nothing
        mine = self.rows.where(F.col("source_id") == source)
        allowed = None if pool is None else mine.join(pool.select("row_id"), "row_id", "left_semi").select("row_no")
        if any(len(p) > 1 for p in phrases):
            rows = mine.select("source_id", F.col("row_no").alias("row_id"), "length")
            hits = bm25(self.positional(source, wanted), rows, phrases).select(F.col("row_id").alias("row_no"), "score")
            return self._best(hits, mine, k, allowed)
        weights = {t: _idf(self.sources[source].n, found[t][0]) * c for t, c in Counter(p[0] for p in phrases).items()}
        if min(found[t][1] for t in wanted) <= FIRST_BLOCKS:
            return self._best(self._scored(source, weights, F.lit(True)), mine, k, allowed)
        meta = self._mine(self.postings, source, wanted).select("block", "term", "most")
        bounds = meta.groupBy("block").agg(F.sum(_looked_up(weights) * F.col("most")).alias("bound"), F.count("*").alias("held")).where(F.col("held") == len(wanted)).select("block", "bound")
        first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
        early = self._admitted(self._scored(source, weights, F.col("block").isin(first)), allowed)
        held = top(early, k, "row_no").agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        reach = bounds.where(~F.col("block").isin(first))
        if held.n >= k:
            reach = reach.where(F.col("bound") >= held.least - SLACK)
        later = self._scored(source, weights, reach.select("block"))
        return self._best(early.unionByName(self._admitted(later, allowed)), mine, k, None)

    @staticmethod
    def _admitted(hits: DataFrame, allowed: DataFrame | None) -> DataFrame:
        return hits if allowed is None else hits.join(allowed, "row_no", "left_semi")

    def _best(self, hits: DataFrame, rows: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
        best = top(self._admitted(hits, allowed), k, "row_no")
        # k rows at most
        return rows.select("row_no", "row_id").join(F.broadcast(best), "row_no").select("row_id", "score", "rank")


def _idf(n: int, df: int) -> float:
    raw = math.log((n - df + 0.5) / (df + 0.5))
    return raw if raw > 0 else LEAST_IDF


def _looked_up(weights: dict[str, float]) -> Column:
    """The weight of ``term``."""
    out = F.lit(None).cast("double")
    for t, w in weights.items():
        out = F.when(F.col("term") == t, F.lit(w)).otherwise(out)
    return out
