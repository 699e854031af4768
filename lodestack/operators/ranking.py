"""Ranked lists (chunk_id, score) and what is done with them: fusion, diversity, recency, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the ranking.
RRF_K = 60
DEFAULT_K, MAX_K = 8, 50
PER_DOC, PER_DOC_MAX = 2, 3
OVERFETCH, LEAST_FRONTIER = 5, 50


def frontier(k: int) -> int:
    return max(OVERFETCH * k, LEAST_FRONTIER)


def ranked(df: DataFrame, *ties: str, score: str = "score") -> DataFrame:
    """Ranks of an already bounded list."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), *[F.col(t).asc() for t in ties])))


def rrf(*lists: DataFrame, ident: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of lists that carry ``rank``."""
    parts = [x.select(ident, (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("part")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(ident).agg(F.sum("part").alias("score"))


def with_metadata(fused: DataFrame, meta: DataFrame, ident: str = "chunk_id") -> DataFrame:
    """Candidates with the columns of ``meta``; one that has no row there is an error that names it, raised where the plan runs.

    ``fused`` is a bounded list (two frontiers at most), so it is broadcast to
    the metadata, and what matches is as small.
    """
    found = meta.join(F.broadcast(fused.select(ident)), ident)
    told = [c for c in meta.columns if c != ident]
    both = fused.join(found.withColumn("__held", F.lit(True)), ident, "left")
    known = F.when(F.col("__held").isNull(), F.raise_error(F.concat(F.lit("candidate without metadata: "), F.col(ident).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return both.where(known).select(*fused.columns, *told)


def diverse(df: DataFrame, k: int, cap: int = PER_DOC, doc: str = "document", ident: str = "chunk_id") -> DataFrame:
    """At most ``cap`` hits of a document, documents by their best hit.

    Within a document hits stand by (is_intro, score falling, id); its score is
    the greatest of the first three, its hits the first ``cap``. Places that
    the cap frees stay free.
    """
    cap = min(max(cap, 1), PER_DOC_MAX)
    within = Window.partitionBy(doc).orderBy(F.col("is_intro").asc(), F.col("score").desc(), F.col(ident).asc())
    placed = df.withColumn("place", F.row_number().over(within)).where(F.col("place") <= PER_DOC_MAX)
    placed = placed.withColumn("doc_score", F.max("score").over(Window.partitionBy(doc))).where(F.col("place") <= cap)
    order = [F.col("doc_score").desc(), F.col(doc).asc(), F.col("place").asc()]
    best = placed.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def by_recency(df: DataFrame, k: int, doc: str = "document", ident: str = "chunk_id", date: str = "date") -> DataFrame:
    """Newest first, undated last; ties by document, then id."""
    order = [F.col(date).desc_nulls_last(), F.col(doc).asc(), F.col(ident).asc()]
    best = df.drop("rank").orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def truncation(candidates: int, records: int, k: int) -> dict:
    """Whether more could be had, and the next k to ask for."""
    cut = candidates > records
    return {"truncated": cut, "next_k": min(2 * k, MAX_K) if cut and k < MAX_K else None}
