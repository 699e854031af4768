"""A stored plane of signed byte vectors: blocks in id order, bound to the rows they were made from.

* ``blocks``: source_id, block, n, first_id, last_id, ids (8 bytes each, little
  endian), data (n * dim signed bytes), digest (sha256 of ids and data);
* ``places``: source_id, chunk_id, block, pos, sorted by chunk_id;
* ``sources``: source_id, n, dim, first_id, last_id, digest.

Eligible rows become a bitmap for each block, by a join with ``places`` and a
built-in bitmap aggregate; the plane is joined with these by block number, so a
block without an eligible row is never multiplied and a row outside the bitmap
never leaves its block. A scope that is one document is a range of ids: blocks
outside it are pruned by their first and last id before anything is read.

A source's digest is that of its blocks' digests in order of their numbers, and
a block's can be made from the vectors anew, so the check names the blocks that
differ instead of failing as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import stored
from lodestack.operators.lexical import top
from lodestack.operators.order import numbered
from lodestack.operators.vector import SCALE, is_finite, quantized

FORMAT = "bytes-1"
#: Vectors of a block; a bitmap of Spark's holds 32,768 bits.
BLOCK_ROWS = 4096
_BLOCKS = "source_id string, block long, n int, first_id long, last_id long, ids binary, data binary, digest string"


def _packed(rows: DataFrame) -> DataFrame:
    """Blocks of (source_id, block, chunk_id, embedding as signed bytes)."""
    # one row a vector, a few thousand a block: the list is bounded by the block
    lists = rows.groupBy("source_id", "block").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "embedding"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for source, block, v in zip(*[b.column(i) for i in range(3)], strict=True):
                held = v.values
                ids = held.field("chunk_id").to_numpy(zero_copy_only=False).astype("<i8")
                data = held.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.int8)
                packed = (ids.tobytes(), data.tobytes())
                out.append((source.as_py(), block.as_py(), len(ids), int(ids[0]), int(ids[-1]), *packed, hashlib.sha256(packed[0] + packed[1]).hexdigest()))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["source_id", "block", "n", "first_id", "last_id", "ids", "data", "digest"])

    return lists.mapInArrow(run, _BLOCKS)


def require_finite(vectors: DataFrame, ident: str, column: str) -> None:
    """Refuses vectors that hold a null or a non-finite number, naming the first ones."""
    bad = vectors.where(F.col(column).isNull() | ~is_finite(F.col(column))).select(ident).orderBy(ident).limit(5).collect()
    if bad:
        raise ValueError(f"non-finite vectors: {', '.join(str(r[0]) for r in bad)}")


def build(vectors: DataFrame, path: str, *, dim: int | None = None, block_rows: int = BLOCK_ROWS) -> None:
    """Plane of ``vectors`` (source_id, chunk_id, embedding of floats) of every source; ``path`` must not exist.

    A non-finite vector, a repeated id or vectors of different lengths are errors.
    """
    if not 0 < block_rows <= 32_768:
        raise ValueError("a block has 1 to 32768 vectors")
    spark = vectors.sparkSession
    require_finite(vectors, "chunk_id", "embedding")
    bytes_ = vectors.select("source_id", "chunk_id", quantized(F.col("embedding"), dim).alias("embedding"))
    told = bytes_.groupBy("source_id").agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("dim"))
    uneven = told.where("low <> dim").collect()
    twice = bytes_.groupBy("source_id", "chunk_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if uneven or twice:
        raise ValueError(f"vectors of different lengths: {uneven}" if uneven else f"vector {twice[0].chunk_id} twice")
    rows = numbered(bytes_, ["source_id"], ["chunk_id"]).withColumn("block", F.expr(f"row_no div {block_rows}"))
    _packed(rows).repartitionByRange("source_id", "block").sortWithinPartitions("source_id", "block").write.partitionBy("source_id").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    places = rows.select("source_id", "chunk_id", "block", (F.col("row_no") - F.col("block") * block_rows).cast("int").alias("pos"))
    places.repartitionByRange("source_id", "chunk_id").sortWithinPartitions("source_id", "chunk_id").write.partitionBy("source_id").parquet(f"{path}/places")
    _summed(blocks).join(told.select("source_id", "dim"), "source_id").coalesce(1).write.parquet(f"{path}/sources")
    stored.close(spark, path, {"format": FORMAT, "block_rows": block_rows, "dim": dim or 0})


def _summed(blocks: DataFrame) -> DataFrame:
    """Count, bounds and digest of each source, from its blocks' columns without the vectors."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"])
    return blocks.groupBy("source_id").agg(F.sum("n").cast("long").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sha2(F.concat_ws("", listed), 256).alias("digest"))


class Plane:
    """A stored plane, opened: its files are those of its manifest."""

    def __init__(self, spark: SparkSession, path: str, verify: bool = False) -> None:
        head = stored.header(spark, path)
        if head.get("format") != FORMAT:
            raise stored.StoredError(f"{path} is a plane of another kind: {head}")
        stored.require_whole(spark, path, hashed=verify)
        self.spark, self.path = spark, path
        self.block_rows, self.dim = int(head["block_rows"]), int(head["dim"]) or None
        self.sources = {r.source_id: r for r in spark.read.parquet(f"{path}/sources").collect()}
        self.blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
        self.places = spark.read.parquet(f"{path}/places")

    def vector(self, source: str, chunk_id: int) -> list[int]:
        """A stored vector: its place, then one block."""
        at = self.places.where((F.col("source_id") == source) & (F.col("chunk_id") == chunk_id)).limit(2).collect()
        if len(at) != 1:
            raise ValueError(f"no unique vector {chunk_id}")
        dim = self.sources[source].dim
        cut = F.expr(f"substring(data, {at[0].pos} * {dim} + 1, {dim})")
        got = self.blocks.where((F.col("source_id") == source) & (F.col("block") == at[0].block)).select(cut.alias("v")).first()
        return np.frombuffer(got.v, np.int8).tolist()

    def bitmaps(self, source: str, eligible: DataFrame, strict: bool = True) -> DataFrame:
        """(block, bits) of the eligible ids; an id that the plane lacks is an error if ``strict``."""
        asked = eligible.select("chunk_id").distinct()
        placed = asked.join(self.places.where(F.col("source_id") == source), "chunk_id", "left" if strict else "inner")
        if strict:
            lost = placed.where("block is null").select("chunk_id").limit(5).collect()
            if lost:
                raise ValueError(f"eligible chunks without a vector: {', '.join(str(r[0]) for r in lost)}")
        return placed.groupBy("block").agg(F.bitmap_construct_agg(F.col("pos").cast("long")).alias("bits"))

    def kept_bitmaps(self, source: str, eligible: DataFrame, key: str) -> DataFrame:
        """Bitmaps of what ``key`` (a filter and the generation it ran on) admits: made once, written beside the plane's store, read by later searches."""
        told = hashlib.sha256(f"{self.path}|{source}|{key}".encode()).hexdigest()
        path = f"{stored.shared_folder(self.spark)}/bitmaps-{told[:32]}"
        if not stored.there(self.spark, f"{path}/_SUCCESS"):
            # a folder without its success marker is that of a search that broke off, or of one that runs beside this
            self.bitmaps(source, eligible, strict=False).write.mode("overwrite").parquet(path)
        return self.spark.read.schema("block long, bits binary").parquet(path)

    def nearest(self, source: str, query: list[int], k: int, eligible: DataFrame | None = None, between: tuple[int, int] | None = None, strict: bool = False, key: str | None = None) -> DataFrame:
        """(chunk_id, raw, score, rank) of the k greatest inner products among eligible ids, or ids ``between`` two; ``key`` names what is eligible, so that it is kept."""
        mine = self.blocks.where(F.col("source_id") == source)
        if between:
            mine = mine.where((F.col("last_id") >= between[0]) & (F.col("first_id") <= between[1]))
        if eligible is not None:
            # without a hint: Spark knows how large the bitmaps are once they are made
            bits = self.bitmaps(source, eligible, strict) if key is None else self.kept_bitmaps(source, eligible, key)
            mine = mine.join(bits, "block").select("n", "ids", "data", "bits")
        else:
            mine = mine.select("n", "ids", "data", F.lit(None).cast("binary").alias("bits"))
        best = top(mine.mapInArrow(_best(query, k, between), "chunk_id long, raw int"), k, "chunk_id", score="raw")
        return best.select("chunk_id", "raw", (F.col("raw") / float(SCALE * SCALE)).alias("score"), "rank")

    def binding_faults(self, vectors: DataFrame) -> DataFrame:
        """(source_id, block, fault): blocks whose bytes are not their digest's, and blocks that the vectors given now would make otherwise."""
        own = self.blocks.select("source_id", "block", "digest", F.sha2(F.concat("ids", "data"), 256).alias("now"))
        bytes_ = vectors.select("source_id", "chunk_id", quantized(F.col("embedding"), self.dim).alias("embedding"))
        numbers = bytes_.join(self.places, ["source_id", "chunk_id"], "left").select("source_id", F.coalesce("block", F.lit(-1)).alias("block"), "chunk_id", "embedding")
        again = _packed(numbers).select("source_id", "block", F.col("digest").alias("made"))
        both = own.join(again, ["source_id", "block"], "full_outer")
        fault = F.when(F.col("digest").isNull(), "vectors without a place").when(F.col("digest") != F.col("now"), "bytes").when(F.col("made").isNull() | (F.col("made") != F.col("digest")), "vectors")
        return both.select("source_id", "block", fault.alias("fault")).where("fault is not null")

    def bound_to(self, source: str) -> Column:
        """The digest that a manifest binds this source's plane by."""
        return F.lit(self.sources[source].digest)


def _best(query: list[int], k: int, between: tuple[int, int] | None):
    q = np.array(query, np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sums of products of bytes stay below 2**24 for up to 1040 dimensions, so float32 is exact
        exact = np.float32 if len(q) <= 1040 else np.float64
        by = q.astype(exact)
        for b in batches:
            found_ids, found = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for n, ids, data, bits in zip(*[b.column(i) for i in range(4)], strict=True):
                n, ids = n.as_py(), np.frombuffer(ids.as_buffer(), "<i8")
                vectors = np.frombuffer(data.as_buffer(), np.int8).reshape(n, -1)
                if vectors.shape[1] != len(q):
                    raise ValueError(f"query of {len(q)} dimensions, vectors of {vectors.shape[1]}")
                keep = None
                if bits.is_valid:
                    keep = np.flatnonzero(np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=n, bitorder="little"))
                if between:
                    inside = np.flatnonzero((ids >= between[0]) & (ids <= between[1]))
                    keep = inside if keep is None else np.intersect1d(keep, inside)
                if keep is not None:
                    ids, vectors = ids[keep], vectors[keep]
                raw = (vectors.astype(exact) @ by).astype(np.int32)
                best = np.lexsort((ids, -raw))[:k]
                found_ids.append(ids[best])
                found.append(raw[best])
            ids, raw = np.concatenate(found_ids), np.concatenate(found)
            best = np.lexsort((ids, -raw))[:k]
            yield pa.record_batch([pa.array(ids[best], pa.int64()), pa.array(raw[best], pa.int32())], names=["chunk_id", "raw"])

    return run
