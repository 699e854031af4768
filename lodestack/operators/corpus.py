"""Statistics, retrieval tools and link graphs over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.crawl import closure

CITED_BY_LIMIT = 100
CHUNK_IDS, CHARS, CHARS_HARD, CONTEXT = 100, 50_000, 200_000, 20
DEFINITIONS, MAX_DEFINITIONS, LEAST_DEFINITIONS = 100, 20, 5


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def prefix_breakdown(docs: DataFrame, ident: str, title: str) -> DataFrame:
    """Upper-case first segment of the id, its documents, and the title of its first one."""
    prefix = F.upper(F.element_at(F.split(F.col(ident), "/", -1), 1))
    return docs.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"), F.min_by(title, ident).alias("first_title"))


def prefix_breakdown_window(docs: DataFrame, ident: str, title: str) -> DataFrame:
    """The same in one pass of windows: a composed title is preferred to one that only repeats the prefix; its text before the dash describes the prefix."""
    tagged = docs.withColumn("prefix", F.upper(F.element_at(F.split(F.col(ident), "/", -1), 1)))
    plain = F.when(F.col(title).startswith(F.concat("prefix", F.lit(" "))), 1).otherwise(0)
    w = Window.partitionBy("prefix")
    placed = tagged.withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(plain, ident)))
    return placed.where("place = 1").select("prefix", "n", F.substring_index(title, " — ", 1).alias("description"))


def chunk_bounds(docs: DataFrame, chunks: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    """First and last chunk of each document (none for one without chunks), their number, and whether the ids are contiguous."""
    spans = chunks.groupBy(*keys).agg(F.min(chunk).alias("first_chunk_id"), F.max(chunk).alias("last_chunk_id"), F.count("*").alias("n_chunks"))
    out = docs.select(*keys).join(spans, keys, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return out.withColumn("contiguous", F.coalesce(F.col("last_chunk_id") - F.col("first_chunk_id") + 1 == F.col("n_chunks"), F.lit(True)))


def cited_by(citations: DataFrame, docs: DataFrame, limit: int = CITED_BY_LIMIT) -> DataFrame:
    """Distinct citing documents of each target: newest first, undated last, then source and id; with the total before the cut.

    citations: target, source_id, native_id; docs: source_id, native_id, date.
    """
    citing = citations.select("target", "source_id", "native_id").distinct().join(docs.select("source_id", "native_id", "date"), ["source_id", "native_id"])
    w = Window.partitionBy("target")
    placed = citing.withColumn("total", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("date").desc_nulls_last(), "source_id", "native_id")))
    return placed.where(F.col("rank") <= limit)


def neighbours(requests: DataFrame, chunks: DataFrame, before: int, after: int, doc: str, ord_: str, bounded: bool = False) -> DataFrame:
    """Requested chunks with their context, each once, in the order of requests.

    A neighbour that is itself asked for later waits for its own place.
    requests: seq, doc, ord; ``bounded`` says that their number is checked, so
    that they may be broadcast.
    """
    asked = requests.select("seq", doc, F.col(ord_).alias("center"))
    spread = asked.withColumn(ord_, F.explode(F.sequence(F.greatest(F.col("center") - min(before, CONTEXT), F.lit(0).cast("bigint")), F.col("center") + min(after, CONTEXT))))
    own = asked.groupBy(doc, F.col("center").alias(ord_)).agg(F.min("seq").alias("own_seq"))
    spread = spread.join(own, [doc, ord_], "left").where("own_seq is null or own_seq <= seq or center = " + ord_)
    first = spread.groupBy(doc, ord_).agg(F.min(F.struct("seq", "center")).alias("s"))
    return chunks.join(F.broadcast(first) if bounded else first, [doc, ord_]).select(doc, ord_, F.col("s.seq").alias("seq"), *[c for c in chunks.columns if c not in (doc, ord_)])


def budgeted(rows: DataFrame, text: str, order: list[str], budget: int, by: list[str] | None = None) -> DataFrame:
    """What of each text fits a budget of characters: ``start`` of its span in the whole, ``take``, and ``resume`` where it was cut."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("length", F.length(text)).withColumn("start", F.sum("length").over(w) - F.col("length"))
    take = F.greatest(F.lit(0), F.least(F.col("length").cast("bigint"), F.lit(budget) - F.col("start")))
    return placed.withColumn("take", take).where((F.col("take") > 0) | (F.col("length") == 0) & (F.col("start") <= budget)).withColumn("resume", F.when(F.col("take") < F.col("length"), F.col("take")))


def definitions(defs: DataFrame, docs: DataFrame, term: str, document: str | None, statutory: tuple[str, ...] = ("PAC", "REG"), most: int = LEAST_DEFINITIONS) -> DataFrame:
    """Statutory definitions of a term: those of the asking document first, of its first path segments next, others last."""
    most = min(most, MAX_DEFINITIONS)
    mine = defs.where(F.col("norm_term") == term).join(docs.where(F.col("type").isin(*statutory)).select("source_id", "native_id"), ["source_id", "native_id"])
    first = mine.orderBy("native_id", "ord", "term").limit(DEFINITIONS)
    numbered = first.withColumn("seq", F.row_number().over(Window.orderBy("native_id", "ord", "term")))
    once = numbered.withColumn("copy", F.row_number().over(Window.partitionBy("native_id", "body").orderBy("seq"))).where("copy = 1")
    same = F.substring_index("native_id", "/", 2)
    rank = F.when(F.col("native_id") == document, 0).when(same == F.substring_index(F.lit(document), "/", 2), 1).otherwise(2) if document else F.lit(2)
    return once.withColumn("near", rank).orderBy("near", "seq").limit(most)


def full_outer_compare(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows that only one side has, or whose values differ (null equals null)."""
    left = a.select(*keys, F.struct(*values).alias("left"))
    right = b.select(*keys, F.struct(*values).alias("right"))
    both = left.join(right, keys, "full_outer")
    verdict = F.when(F.col("left").isNull(), "only_right").when(F.col("right").isNull(), "only_left").when(~F.col("left").eqNullSafe(F.col("right")), "differs")
    return both.withColumn("verdict", verdict).where("verdict is not null").select(*keys, "verdict")


def table_digest(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Per group: rows and an order-free digest, the sum of the leading 60 bits of each row's sha256 modulo 2**61 - 1.

    Fields are prefixed with their length, so no two rows share a spelling. A
    sum is associative: it combines in the map stage, where a hash over sorted
    rows would need them all in one place.
    """
    field = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    head = F.conv(F.substring(F.sha2(F.concat_ws("|", *[field(c) for c in columns]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(head) % F.lit((1 << 61) - 1).cast("decimal(38,0)")).cast("bigint").alias("digest"))


def descendants(nodes: DataFrame, ident: str, parent: str, rounds: int = 8) -> DataFrame:
    """(ancestor, node) pairs of a tree, itself included: one join a level for shallow trees, doubled paths for those deeper than ``rounds``."""
    pairs = nodes.select(F.col(ident).alias("ancestor"), F.col(ident).alias("node"))
    edges = nodes.where(F.col(parent).isNotNull()).select(F.col(ident).alias("child"), F.col(parent).alias("node"))
    level, out = pairs, pairs
    for _ in range(rounds):
        level = level.join(edges, "node").select("ancestor", F.col("child").alias("node"))
        if level.isEmpty():
            return out
        out = out.union(level)
    return closure(nodes, ident, parent).select("ancestor", "node")


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
