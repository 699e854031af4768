"""Strict all-term BM25 over a positional index.

An index is two tables, partitioned by source: ``postings`` (source_id, row_id,
col, term, positions) and ``rows`` (source_id, row_id, length). A query reads
the postings of its own terms only; statistics are those of the whole source,
whatever is filtered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import index_tokens, query_terms

K1, B = 1.2, 0.75
#: What a term in more than half of the rows weighs.
LEAST_IDF = 1e-6


def tokenised(rows: DataFrame, text: str, stem: bool = True) -> DataFrame:
    """``rows`` with ``tokens``: the index tokeniser, in Arrow batches."""
    fields = [f for f in rows.schema if f.name != text]
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "tokens array<string>"])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [index_tokens(t, stem) if t else [] for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in names], pa.array(tokens, pa.list_(pa.string()))], names=[*names, "tokens"])

    return rows.mapInArrow(run, ddl)


def build_index(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, rows) of ``tokens`` (source_id, row_id, col, tokens)."""
    spread = tokens.select("source_id", "row_id", "col", F.posexplode("tokens").alias("pos", "term"))
    postings = spread.groupBy("source_id", "term", "row_id", "col").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    rows = tokens.groupBy("source_id", "row_id").agg(F.sum(F.size("tokens")).cast("long").alias("length"))
    return postings, rows


def write_index(postings: DataFrame, rows: DataFrame, path: str) -> None:
    """Sorted by term within each source's files, so that a term's row groups can be picked by their statistics."""
    postings.repartition("source_id", F.pmod(F.hash("term"), F.lit(64))).sortWithinPartitions("source_id", "term", "row_id").write.mode("overwrite").partitionBy("source_id").parquet(f"{path}/postings")
    rows.write.mode("overwrite").partitionBy("source_id").parquet(f"{path}/rows")


def phrase_hits(postings: DataFrame, phrase: list[str]) -> DataFrame:
    """(source_id, row_id, tf): rows that hold the words of ``phrase`` one after another in one column."""
    mine = postings.where(F.col("term").isin(phrase))
    if len(phrase) == 1:
        return mine.groupBy("source_id", "row_id").agg(F.sum(F.size("positions")).cast("long").alias("tf"))
    # the place where the phrase would begin, if each of its words agrees
    parts = [F.when(F.col("term") == t, _shifted(i)) for i, t in enumerate(phrase)]
    by_word = [F.max(p).alias(f"p{i}") for i, p in enumerate(parts)]
    grouped = mine.groupBy("source_id", "row_id", "col").agg(*by_word)
    starts = reduce(F.array_intersect, [F.col(f"p{i}") for i in range(len(phrase))])
    found = grouped.withColumn("n", F.size(starts)).where("n > 0")
    return found.groupBy("source_id", "row_id").agg(F.sum("n").cast("long").alias("tf"))


def _shifted(by: int) -> Column:
    return F.transform("positions", lambda p: p - by)


def _frequency(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def bm25(postings: DataFrame, rows: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(source_id, row_id, score) of the rows that match every phrase. Phrases that occur twice count twice."""
    if not phrases:
        return rows.select("source_id", "row_id", F.lit(0.0).alias("score")).limit(0)
    wanted = sorted({t for p in phrases for t in p})
    pruned = postings.where(F.col("term").isin(wanted))
    hits = [phrase_hits(pruned, p).select("source_id", "row_id", "tf", F.lit(i).alias("term")) for i, p in enumerate(phrases)]
    hit = reduce(DataFrame.unionByName, hits)
    corpus = rows.groupBy("source_id").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = hit.groupBy("source_id", "term").agg(F.count("*").alias("df"))
    weight = df.join(corpus, "source_id").select("source_id", "term", "mean", idf(F.col("n"), F.col("df")).alias("idf"))
    # a row for each source and term of the query; joined by a shuffle, all hits of a term would meet in one task
    scored = hit.join(F.broadcast(weight), ["source_id", "term"]).join(rows, ["source_id", "row_id"])
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy("source_id", "row_id").agg(F.sum(part).alias("score"), F.count("*").alias("matched")).where(F.col("matched") == len(phrases)).drop("matched")


def query_phrases(query: str, stem: bool = True) -> list[list[str]]:
    """Each query term by the index tokeniser: hyphens and apostrophes make it a phrase."""
    return [p for p in (index_tokens(t, stem) for t in query_terms(query)) if p]


def scan_bm25(docs: DataFrame, tokens: Column, terms: list[str]) -> DataFrame:
    """Score without an index: one pass for the statistics, one for the scores; ``docs`` gains ``score``, rows that miss a term go."""
    counted = docs.withColumn("__len", F.size(tokens)).select("*", *[_frequency(tokens, t).alias(f"__tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("__n"), F.avg("__len").alias("__mean"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))])
    hit = counted.where(reduce(lambda a, b: a & b, [F.col(f"__tf{i}") > 0 for i in range(len(terms))]))
    # one row of statistics
    both = hit.crossJoin(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("__len") / F.col("__mean"))
    parts = [idf(F.col("__n"), F.col(f"__df{i}")) * F.col(f"__tf{i}") * (K1 + 1) / (F.col(f"__tf{i}") + norm) for i in range(len(terms))]
    return both.withColumn("score", reduce(lambda a, b: a + b, parts)).select(*docs.columns, "score")


def top(df: DataFrame, k: int, *ties: str, score: str = "score") -> DataFrame:
    """The k best by score, then by ``ties``, with their ``rank`` from 1; the limit comes first, so one task ranks k rows at most."""
    order = [F.col(score).desc(), *[F.col(t).asc() for t in ties]]
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
