"""Snapshots, cursors and versions: what has changed, what is newest, what must be read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERLAP = "INTERVAL 7 DAYS"
SHRINK_PERCENT, ACQUIRED_PERCENT = 50, 99


def reconcile(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and action: insert, replace, unchanged or delete. A key twice in the new snapshot is an error of its own (see schema.require_unique)."""
    a = old.select(key, F.col(digest).alias("old_hash"))
    b = new.select(key, F.col(digest).alias("new_hash"))
    action = F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), "delete").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("replace")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key; others stay."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is unknown are added; of equal keys one."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def compact_log(log: DataFrame, key: str, line: str, ok: Column, gone: Column) -> DataFrame:
    """Last write wins, but a failure after a success doesn't erase it; a tombstone does."""
    telling = log.where(ok | gone)
    return telling.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(line).desc()))).where(F.col("__n") == 1).where(~gone).drop("__n")


def overlap(rows: DataFrame, at: str, cursor: Column, ceiling: Column) -> DataFrame:
    """Rows from ``OVERLAP`` before the cursor up to the start of this scan: late ones are read again."""
    return rows.where((F.col(at) >= cursor - F.expr(OVERLAP)) & (F.col(at) <= ceiling))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def high_water(rows: DataFrame, at: str, ident: str, previous: Column) -> DataFrame:
    """The greatest (time, id), never behind the previous one."""
    return rows.agg(F.greatest(F.max(F.struct(F.col(at).alias("at"), F.col(ident).alias("id"))), previous).alias("c")).select("c.*")


def shrunk(previous: int, now: int, percent: int = SHRINK_PERCENT) -> bool:
    """A snapshot that must be refused: less than ``percent`` of the last one."""
    return 100 * now < percent * previous


def acquired_enough(discovered: int, acquired: int, percent: int = ACQUIRED_PERCENT) -> bool:
    return 100 * acquired >= percent * discovered


def feed_diff(feed: DataFrame, done: DataFrame, key: str, status: str, terminal: tuple[str, ...]) -> DataFrame:
    """Feed rows that no record with a terminal status settles."""
    return feed.join(done.where(F.col(status).isin(*terminal)).select(key), key, "left_anti")


def reusable(now: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows of ``now`` with ``reuse``: held under the same revision and URL, and still valid."""
    had = held.select(key, F.col("revision").alias("__r"), F.col("url").alias("__u"), F.col("valid").alias("__v"))
    return now.join(had, key, "left").withColumn("reuse", F.coalesce((F.col("revision") == F.col("__r")) & (F.col("url") == F.col("__u")) & F.col("__v"), F.lit(False))).drop("__r", "__u", "__v")


def order_faults(rows: DataFrame, by: list[str], seq: str, value: str) -> DataFrame:
    """Rows that are less than the one before."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(seq))
    return rows.withColumn("before", before).where(F.col(value) < F.col("before"))


def range_faults(rows: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
    """Ranges that don't begin right after the one before: gap or overlap."""
    before = F.lag(last).over(Window.partitionBy(*by).orderBy(first, last))
    return rows.withColumn("expected", before + 1).where(F.col("expected").isNotNull() & (F.col(first) != F.col("expected"))).withColumn("fault", F.when(F.col(first) > F.col("expected"), "gap").otherwise("overlap"))


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts (by sha256) that the model's cache lacks."""
    held = cache.where(F.col("model_id") == model).select("text_sha256")
    return texts.select(F.sha2("text", 256).alias("text_sha256"), "text").dropDuplicates(["text_sha256"]).join(held, "text_sha256", "left_anti")


def aimd_step(state: tuple, ok: bool, floor: int = 1) -> tuple:
    """(limit, successes, ceiling, congested) after one answer: one more slot after ``limit`` successes, half after congestion.

    The ceiling is learnt once in each episode of congestion.
    """
    limit, good, ceiling, congested = state
    if ok:
        good += 1
        if good >= limit:
            return (min(limit + 1, ceiling), 0, ceiling, False)
        return (limit, good, ceiling, congested)
    if not congested:
        ceiling = max(floor, limit - 1)
    return (max(floor, limit // 2), 0, ceiling, True)
