"""A table of downloaded payloads that is updated by copy-on-write, and keeps the last good payload.

Rows live in buckets of their id's hash; a version of the table is a small
listing of which folder holds each bucket. An update rewrites the buckets in
which a row changes, into a folder of its own, and then writes the next
listing; all other files stay as they are, byte for byte, and earlier versions
can still be read. A listing counts once its success marker is there, so an
update that breaks off changes nothing.

What a download does to the row of its id:

* success: replaces it (same content and href: no change at all);
* failure after a success: the payload stays, the failure is noted in the
  ``refresh_`` columns; the next success clears them;
* failure without a success before: the failure is the row.

Of several answers for one id in an update the last by ``attempted_at`` counts,
a success before a failure at the same time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.stored import StoredError, scratch, there

FETCHED = "canonical_id string, href string, status string, http_status int, error string, content binary, attempted_at timestamp"
ROW = "canonical_id string, href string, status string, http_status int, error string, sha256 string, content binary, downloaded_at timestamp, refresh_status string, refresh_http_status int, refresh_error string, refresh_href string, refresh_attempted_at timestamp"
_LISTING = "bucket int, folder string"
BUCKETS = 256
_REFRESH = ("status", "http_status", "error", "href", "attempted_at")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("canonical_id"), F.lit(buckets)).cast("int")


class Payloads:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def version(self) -> int:
        """The newest whole version, 0 before the first."""
        n = 0
        while there(self.spark, f"{self.path}/listing-{n + 1:08d}/_SUCCESS"):
            n += 1
        return n

    def listing(self, version: int | None = None) -> list[tuple[int, str]]:
        """(bucket, folder) of a version: as many rows as there are buckets at most."""
        n = self.version() if version is None else version
        if not n:
            return []
        if not there(self.spark, f"{self.path}/listing-{n:08d}/_SUCCESS"):
            raise StoredError(f"{self.path} has no version {n}")
        return sorted((r.bucket, r.folder) for r in self.spark.read.schema(_LISTING).parquet(f"{self.path}/listing-{n:08d}").collect())

    def _of(self, listing: list[tuple[int, str]]) -> DataFrame:
        if not listing:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*[f"{self.path}/{folder}" for _, folder in listing])

    def read(self, version: int | None = None) -> DataFrame:
        return self._of(self.listing(version))

    def update(self, fetched: DataFrame) -> dict[str, int]:
        """Merges downloads; the new version and how many buckets were rewritten."""
        now, listing = self.version(), self.listing()
        ok = F.col("status") == "success"
        last = fetched.where(F.col("canonical_id").isNotNull()).groupBy("canonical_id").agg(F.max_by(F.struct("href", "status", "http_status", "error", "content", "attempted_at"), F.struct("attempted_at", ok)).alias("new"))
        last = scratch(last.withColumn("bucket", _bucket(self.buckets)), "fetched")
        asked = {r.bucket for r in last.select("bucket").distinct().collect()}
        # only the buckets that are asked for are read
        held = self._of([x for x in listing if x[0] in asked]).select("canonical_id", F.struct(*[F.col(c) for c in self._columns()]).alias("old"))
        merged = scratch(held.join(last.drop("bucket"), "canonical_id", "full_outer").select("canonical_id", *_merged(), _changed().alias("changed")).withColumn("bucket", _bucket(self.buckets)), "merged")
        touched = sorted(r.bucket for r in merged.where("changed").select("bucket").distinct().collect())
        if not touched:
            return {"version": now, "rewritten": 0}
        folder = f"data-{now + 1:08d}"
        attempt = sum(there(self.spark, f"{self.path}/{folder}-{i}") for i in range(100))
        folder = f"{folder}-{attempt}"
        merged.where(F.col("bucket").isin(touched)).drop("changed").repartition("bucket").sortWithinPartitions("bucket", "canonical_id").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        after = {b: f for b, f in listing} | {b: f"{folder}/bucket={b}" for b in touched}
        self.spark.createDataFrame(sorted(after.items()), _LISTING).coalesce(1).write.parquet(f"{self.path}/listing-{now + 1:08d}")
        return {"version": now + 1, "rewritten": len(touched)}

    @staticmethod
    def _columns() -> list[str]:
        return re.findall(r"(\w+) \w+(?:,|$)", ROW)[1:]


def _succeeds() -> Column:
    return F.coalesce(F.col("new.status") == "success", F.lit(False))


def _keeps() -> Column:
    """Whether an earlier success outlives what came."""
    return F.coalesce(F.col("old.status") == "success", F.lit(False)) & ~_succeeds()


def _same() -> Column:
    """A success that brings what is held already."""
    return _succeeds() & F.col("old.status").eqNullSafe(F.lit("success")) & F.col("old.refresh_status").isNull() & F.sha2("new.content", 256).eqNullSafe(F.col("old.sha256")) & F.col("new.href").eqNullSafe(F.col("old.href"))


def _merged() -> list[Column]:
    stays = F.col("new").isNull() | _same()
    by = lambda old, new: F.when(stays | _keeps(), F.col(f"old.{old}")).otherwise(new)
    content = F.when(_succeeds(), F.coalesce("new.content", F.lit(b"")))
    own = [by(c, F.col(f"new.{c}")).alias(c) for c in ("href", "status", "http_status", "error")]
    own += [by("sha256", F.sha2(content, 256)).alias("sha256"), by("content", content).alias("content"), by("downloaded_at", F.col("new.attempted_at")).alias("downloaded_at")]
    noted = lambda c: F.when(stays, F.col(f"old.refresh_{c}")).when(_keeps(), F.col(f"new.{c}"))
    return own + [noted(c).alias(f"refresh_{c}") for c in _REFRESH]


def _changed() -> Column:
    return F.col("new").isNotNull() & ~_same()
