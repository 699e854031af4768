"""The authoritative version of each key, kept by a stateful operator with timers and a fallback.

A key's version is its best one by (current, latest, key of the version). A
current version is told at once. Where only versions that aren't current have
come, a timer waits ``grace`` of event time for a current one; then the
fallback (what the register held at the scan's boundary, given as the
operator's initial state) is told instead. A key without a fallback is told as
missing, never left out.

Rows that come late or twice give the same result: a worse version than the one
held changes nothing.

Needs the state store of RocksDB (:func:`configure`).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Columns of a version; ``order_key`` sorts as versions do.
VERSION = "id string, order_key string, is_current boolean, is_latest boolean, at timestamp, payload string"
RESULT = "id string, order_key string, payload string, origin string"
#: One value of a key, so a call of the operator reads and writes its state once: the best version, the fallback, when the timer goes off.
_HELD = "order_key string, is_current boolean, is_latest boolean, payload string, has_back boolean, back_key string, back_payload string, timer long"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rank(current: bool | None, latest: bool | None, order_key: str) -> tuple[bool, bool, str]:
    return bool(current), bool(latest), order_key


class Authoritative(StatefulProcessor):
    def __init__(self, grace_ms: int) -> None:
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        held = self.held.get()
        if held is None or held[5] <= initialState.order_key:
            self.held.update((None, None, None, None, True, initialState.order_key, initialState.payload, None))

    def _told(self, key: tuple, order_key: str | None, payload: str | None, origin: str) -> Row:
        return Row(id=key[0], order_key=order_key, payload=payload, origin=origin)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.held.get()
        before = tuple(held[:4]) if held and held[0] is not None else None
        best, newest = before, 0
        for r in rows:
            if best is None or _rank(r.is_current, r.is_latest, r.order_key) > _rank(best[1], best[2], best[0]):
                best = (r.order_key, bool(r.is_current), bool(r.is_latest), r.payload)
            newest = max(newest, int(r.at.timestamp() * 1000))
        if best is None or best == before:
            return
        back = tuple(held[4:7]) if held else (False, None, None)
        if held and held[7] is not None:
            self.handle.deleteTimer(held[7])
        timer = None if best[1] else max(newest, timerValues.getCurrentWatermarkInMs()) + self.grace_ms
        self.held.update((*best, *back, timer))
        if timer is None:
            yield self._told(key, best[0], best[3], "version")
        else:
            self.handle.registerTimer(timer)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        held = self.held.get()
        if held is None or held[1]:
            return
        self.held.update((*held[:7], None))
        yield self._told(key, held[5], held[6], "fallback" if held[4] else "missing")

    def close(self) -> None:
        pass


def resolved(stream: DataFrame, fallback: DataFrame, watermark: str = "1 hour", grace_ms: int = 3_600_000) -> DataFrame:
    """(id, order_key, payload, origin) of each change of a key's authoritative version; the last one of a key holds.

    stream: ``VERSION``; fallback: id, order_key, payload.
    """
    keyed = stream.withWatermark("at", watermark).groupBy("id")
    return keyed.transformWithState(statefulProcessor=Authoritative(grace_ms), outputStructType=RESULT, outputMode="update", timeMode="eventtime", initialState=fallback.select("id", "order_key", "payload").groupBy("id"))


def resolved_batch(versions: DataFrame, fallback: DataFrame) -> DataFrame:
    """The same of a whole table."""
    best = versions.groupBy("id").agg(F.max(F.struct(F.coalesce("is_current", F.lit(False)).alias("c"), F.coalesce("is_latest", F.lit(False)).alias("l"), "order_key", "payload")).alias("v"))
    back = fallback.groupBy("id").agg(F.max(F.struct("order_key", "payload")).alias("f"))
    both = best.join(back, "id", "left")
    pick = lambda c: F.when(F.col("v.c"), F.col(f"v.{c}")).otherwise(F.col(f"f.{c}"))
    origin = F.when(F.col("v.c"), "version").when(F.col("f").isNotNull(), "fallback").otherwise("missing")
    return both.select("id", pick("order_key").alias("order_key"), pick("payload").alias("payload"), origin.alias("origin"))


def last_told(changes: DataFrame, seq: Column) -> DataFrame:
    """The last change of each key."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(seq.desc()))
    return changes.withColumn("__n", place).where("__n = 1").drop("__n")
