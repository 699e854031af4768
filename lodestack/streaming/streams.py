"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestack.operators.incremental import aimd_step

OVERLAP = "7 days"


def read_stream(spark: SparkSession, path: str, ddl: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replayed(stream: DataFrame, at: str, keys: list[str], overlap: str = OVERLAP) -> DataFrame:
    """Late rows within the overlap are taken, each key once; state older than that is dropped."""
    return stream.withWatermark(at, overlap).dropDuplicatesWithinWatermark(keys)


def newest_by_key(stream: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The authoritative state of each key: its greatest (time, value). For update or complete output."""
    return stream.groupBy(key).agg(F.max(F.struct(at, value)).alias("newest")).select(key, "newest.*")


def limits(stream: DataFrame, key: str, at: str, ok: str) -> DataFrame:
    """The adaptive concurrency limit of each key after each batch of answers: key, answers, limit."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limit, good, ceiling, congested, seen = state.get if state.exists else (4, 0, 64, False, 0)
        held = (limit, good, ceiling, congested)
        whole = pd.concat(list(frames)).sort_values(at, kind="stable")
        for answer in whole[ok]:
            held = aimd_step(held, bool(answer))
        seen += len(whole)
        state.update((*held, seen))
        yield pd.DataFrame({key: [k[0]], "answers": [seen], "limit": [held[0]]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, answers long, limit int", "lim int, good int, ceiling int, congested boolean, seen long", "update", GroupStateTimeout.NoTimeout)


def upserting(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through ``apply`` (reconcile, then an atomic swap); a batch number seen before must be a no-op there."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """All that is there now, to Parquet."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
