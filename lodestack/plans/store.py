"""Structures that are built once from a table and read back by every later query."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import count

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestack.operators import stored

_opened: dict[tuple[str, str], object] = {}


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Of the files of some tables: names, lengths and times, not contents."""
    told = hashlib.sha256()
    for p in paths:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", "length", F.unix_micros("modificationTime").alias("at"))
        for r in sorted(map(tuple, listed.collect())):
            told.update(repr(r).encode())
    return told.hexdigest()[:24]


def once[T](spark: SparkSession, kind: str, tables: list[str], build: Callable[[str], None], opened: Callable[[str], T]) -> T:
    """Opens the structure made from ``tables`` as they are now; builds it if there is none. A folder that a build left unfinished is passed by."""
    at = f"{stored.shared_folder(spark)}/{kind}-{fingerprint(spark, *tables)}"
    key = (spark.sparkContext.applicationId, at)
    if key not in _opened:
        for attempt in count():
            path = f"{at}-{attempt}"
            if not stored.exists(spark, path):
                if stored.there(spark, path):
                    continue
                build(path)
            _opened[key] = opened(path)
            break
    return _opened[key]
