"""Exact search over signed byte vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.lexical import top

SCALE = 127
LEAST_NORM = 1e-12


def quantized(c: Column, dim: int | None = None) -> Column:
    """Unit length, clipped to one, times 127, rounded half away from zero; zeros for a vector without length."""
    v = F.transform(F.slice(c, 1, dim) if dim else c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(v, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / norm)) * SCALE).cast("tinyint"))
    return F.when(norm <= LEAST_NORM, F.transform(v, lambda x: F.lit(0).cast("tinyint"))).otherwise(unit)


def is_finite(c: Column) -> Column:
    return F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def dot(a: Column, b: Column) -> Column:
    """Exact integer inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[int], k: int, eligible: DataFrame | None = None, ident: str = "chunk_id", column: str = "embedding", numpy: bool = True) -> DataFrame:
    """The k vectors of greatest inner product with ``query``: ident, raw, score (raw / 127²), rank.

    Ineligible rows go before any product is computed. With ``numpy`` each
    Arrow batch is one matrix product and only its k best rows come back.
    """
    pool = vectors.select(ident, column)
    if eligible is not None:
        pool = pool.join(eligible.select(ident).distinct(), ident, "left_semi")
    if numpy:
        kind = vectors.schema[ident].dataType.simpleString()
        scored = pool.mapInArrow(_products(query, k), f"{ident} {kind}, raw int")
    else:
        scored = pool.select(ident, dot(F.col(column), F.array(*[F.lit(int(x)) for x in query])).alias("raw"))
    return top(scored, k, ident, score="raw").withColumn("score", F.col("raw") / float(SCALE * SCALE))


def _products(query: list[int], k: int):
    q = np.array(query, np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            # sums of products of bytes stay below 2**24 for up to 1040 dimensions, so float32 is exact
            exact = np.float32 if len(q) <= 1040 else np.float64
            raw = (flat.reshape(b.num_rows, -1).astype(exact) @ q.astype(exact)).astype(np.int32)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            best = np.lexsort((ids, -raw))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[best]), pa.array(raw[best], pa.int32())], names=[b.schema.names[0], "raw"])

    return run


def similar_to(vectors: DataFrame, seed_id: int, k: int, ident: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """Neighbours of a stored vector; the seed leaves after the cut, so k - 1 rows may remain."""
    seed = vectors.where(F.col(ident) == seed_id).select(column).limit(2).collect()
    if len(seed) != 1:
        raise ValueError(f"no unique vector {seed_id}")
    return nearest(vectors, list(seed[0][0]), k, ident=ident, column=column).where(F.col(ident) != seed_id)
