"""Whitening of embeddings by their leading principal components, without the covariance matrix.

Entries become integers (a fixed grid), so that equal vectors are exactly equal
and sums are exact. The fit list holds each distinct vector once.

Block subspace iteration: a pass over the fit list computes Xᵀ(XQ) of centred
rows for a block Q of orthonormal columns, in numpy within each task; Spark
sums a d-by-block table, and that is all that reaches the driver, at any number
of rows. There QR and Rayleigh-Ritz give the leading eigenpairs within the
space seen so far. The next block is made from the residuals, orthogonal to
that space, which therefore grows until the residuals certify all ``k``
components; it spans everything after d / block passes, so the iteration ends
for flat spectra too, where iterating on one block alone would hardly move.

Output: for each row and component the whitened coordinate. Components whose
eigenvalue is zero to double precision can't be whitened and are left out, so
fewer than ``k`` may be returned (none if all vectors are alike).

Rows with a null vector or with a null or non-finite entry are dropped. Shorter
vectors count as filled up with zeros to the longest one's length. Null and
repeated ids, ties and repeated vectors are rows like others. Entries of over
2**53 / 256 are beyond the grid; a deviation that no long can hold is null. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from lodestack.llm.common import cut, require

#: Columns of Q in a pass.
BLOCK = 32
#: Residual of an eigenpair, as a share of the largest eigenvalue, that certifies it.
RESIDUAL = 1e-12
#: An eigenvalue below this share of the largest is zero but for rounding.
ZERO = 1e-13


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    largest: int
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def _grid(rows: DataFrame, vector: str, scale: int, shift: int) -> DataFrame:
    """Rows with a finite vector; ``x`` holds it on the integer grid."""
    bad = lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf"))
    ok = F.col(vector).isNotNull() & ~F.exists(vector, bad)
    return rows.where(ok).withColumn("x", F.transform(vector, lambda e: F.floor(e.cast("double") * scale).cast("long") + shift))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index("x"))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _sums(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows, sum and largest size of each dimension in a partition, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, top = 0, np.zeros(d, object), 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                high = max(int(x.max()), -int(x.min()))
                n, top = n + len(x), max(top, high)
                s += (x if high * len(x) < 1 << 62 else x.astype(object)).sum(axis=0).astype(object)
        if n:
            kind = pa.decimal128(38, 0)
            yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([int(v) for v in s], kind), pa.array([top] * d, kind)], names=["i", "n", "s", "top"])

    return run


def _product(mean: np.ndarray, q: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Xᵀ(XQ) of a partition's centred rows, a row a dimension; row -1 has the sum of their squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, squares, seen = np.zeros(q.shape), 0.0, False
        for b in batches:
            if b.num_rows:
                x = _matrix(b).astype(float) - mean
                made += x.T @ (x @ q)
                squares += float(np.einsum("ij,ij->", x, x))
                seen = True
        if seen:
            made = np.vstack((made, np.full((1, q.shape[1]), squares)))
            yield pa.record_batch([pa.array([*range(len(q)), -1], pa.int32()), *[pa.array(c) for c in made.T.copy()]], names=["i", *[f"c{j}" for j in range(q.shape[1])]])

    return run


def _gram(mean: np.ndarray, w: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """WᵀW of a partition's whitened rows, W = (X - mean) w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, seen = np.zeros((w.shape[1] + 1, w.shape[1])), False
        for b in batches:
            if b.num_rows:
                y = (_matrix(b).astype(float) - mean) @ w
                made += np.vstack((y.T @ y, y.sum(axis=0)))
                seen = True
        if seen:
            yield pa.record_batch([pa.array(range(len(made)), pa.int32()), *[pa.array(c) for c in made.T.copy()]], names=["i", *[f"c{j}" for j in range(w.shape[1])]])

    return run


def _summed(fit: DataFrame, run: Callable, width: int) -> dict[int, np.ndarray]:
    """Spark adds the tasks' tables; what comes back has a row a dimension, whatever the number of tasks."""
    names = [f"c{j}" for j in range(width)]
    kind = StructType([StructField("i", IntegerType()), *[StructField(c, DoubleType()) for c in names]])
    rows = fit.mapInArrow(run, kind).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return {r["i"]: np.array(r[1:], float) for r in rows}


def _fresh(basis: np.ndarray, wanted: np.ndarray, width: int, draw: np.random.Generator) -> np.ndarray:
    """Up to ``width`` orthonormal columns orthogonal to ``basis``, from ``wanted`` and, where these fall short, from random ones."""
    d = len(wanted)
    width = min(width, d - basis.shape[1])
    found = np.empty((d, 0))
    for candidate in (wanted, draw.standard_normal((d, width)), draw.standard_normal((d, width))):
        if found.shape[1] == width:
            break
        held = np.hstack((basis, found))
        norms = np.linalg.norm(candidate, axis=0)
        c = candidate[:, norms > 0] / norms[norms > 0]
        for _ in range(2):
            c = c - held @ (held.T @ c)
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        u = u[:, s > 1e-8]
        u = u - held @ (held.T @ u)
        found = np.hstack((found, np.linalg.qr(u)[0]))[:, :width]
    return found


def _pairs(fit: DataFrame, d: int, n: int, mean: np.ndarray, k: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Leading eigenvectors and values of the covariance, its trace, and the passes it took."""
    draw = np.random.default_rng(seed)
    basis, image, trace, passes = np.empty((d, 0)), np.empty((d, 0)), 0.0, 0
    q = _fresh(basis, draw.standard_normal((d, min(block, d))), block, draw)
    while True:
        got = _summed(fit, _product(mean, q), q.shape[1])
        passes += 1
        trace = got[-1][0] / n
        basis, image = np.hstack((basis, q)), np.hstack((image, np.vstack([got[i] for i in range(d)]) / n))
        h = basis.T @ image
        values, inner = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, inner = values[order], inner[:, order]
        axes = basis @ inner
        rest = image @ inner - axes * values
        bound = RESIDUAL * max(values[0], np.finfo(float).tiny)
        if basis.shape[1] == d or (basis.shape[1] >= k and np.all(np.linalg.norm(rest[:, :k], axis=0) <= bound)):
            return axes[:, :k], values[:k], trace, passes
        q = _fresh(basis, rest[:, :block], block, draw)


def fit(grid: DataFrame, d: int, k: int = 4, block: int = BLOCK, seed: int = 0) -> Whitening | None:
    """Fit on a table of distinct vectors ``x`` of length ``d``; None where there is nothing to fit."""
    if not d:
        return None
    kind = StructType([StructField("i", IntegerType()), StructField("n", LongType()), StructField("s", DecimalType(38, 0)), StructField("top", DecimalType(38, 0))])
    told = sorted(grid.mapInArrow(_sums(d), kind).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("top").alias("top")).collect(), key=lambda r: r["i"])
    if not told:
        return None
    n, sums = told[0]["n"], [int(r["s"]) for r in told]
    mean = np.array([s / n for s in sums])
    axes, values, trace, passes = _pairs(grid, d, n, mean, min(k, d), block, seed)
    good = values > ZERO * max(values[0], 0.0)
    good &= values > 0
    if not good.any():
        return None
    axes, values = axes[:, good], values[good]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    got = _summed(grid, _gram(mean, axes / np.sqrt(values)), axes.shape[1])
    c = len(values)
    means = got[c] / n
    cov = np.vstack([got[i] for i in range(c)]) / n - np.outer(means, means)
    return Whitening(n, sums, max(int(r["top"]) for r in told), axes, values, trace, float(np.abs(cov - np.eye(c)).max()), passes)


def _apply(model: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n, c, d = model.n, len(model.values), len(model.sums)
    mean, w = np.array([s / n for s in model.sums]), model.axes / np.sqrt(model.values)
    # |n x - S| <= 2 n top in each dimension
    small = d * (2 * n * max(model.largest, 1)) ** 2 < 1 << 62
    sums = np.array(model.sums, np.int64 if small else object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b)
            off = (x if small else x.astype(object)) * n - sums
            far = (off * off).sum(axis=1)
            far = pa.array(far if small else [int(v) if v < 1 << 63 else None for v in far], pa.int64())
            y = (x.astype(float) - mean) @ w
            each = np.repeat(np.arange(len(x)), c)
            take = pa.array(each)
            yield pa.record_batch(
                [
                    b.column(b.schema.get_field_index("vec_id")).take(take),
                    pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n, np.int64)),
                    far.take(take),
                    pa.array(y.ravel()),
                    pa.array(np.tile(model.values / model.trace, len(x))),
                    pa.array(np.full(len(each), model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(rows: DataFrame, k: int = 4, *, scale: int = 256, shift: int = 0, block: int = BLOCK, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every row that has a finite vector."""
    require(rows, vec_id, vector)
    spark = rows.sparkSession
    kept = cut(_grid(rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("__v")), "__v", scale, shift).select("vec_id", "x"), "grid")
    d = kept.agg(F.max(F.size("x"))).first()[0] or 0
    filled = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
    model = fit(cut(filled.select("x").distinct(), "distinct"), d, k, block)
    kind = StructType([StructField("vec_id", kept.schema["vec_id"].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), *[StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    if model is None:
        return spark.createDataFrame([], kind)
    return filled.mapInArrow(_apply(model), kind)
