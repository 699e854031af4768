"""Control of update and build runs: locks, staged steps, pinned states, per-source updates, timings.

State lives beside the tables on the file system that Spark uses, so the driver
can be replaced between steps. Nothing here touches rows on the driver; a step
is a table that executors write.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.sources.acquire import fingerprint

#: Answers that are worth another attempt.
RETRYABLE = frozenset({408, 425, 429, 500, 502, 503, 504})
PHASES = ("resolve", "filter", "retrieve", "fuse", "hydrate")
OUTCOMES = ("current", "updated", "partial", "failed")
READY = 20
_DIGEST = "^[0-9a-f]{64}$"


class Folder:
    """A folder on the file system of the session."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs
        self._fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):  # noqa: ANN202
        return self._paths.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(""))) if self.exists("") else []

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self.path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one."""
        try:
            stream = self._fs.create(self.path(name), False)
        except Exception as e:
            if self.exists(name):
                return False
            raise e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """A reader finds the old text or the new one, never none: one rename takes the place of the old file."""
        temp = f".{name.replace('/', '_')}.{hashlib.sha256(text.encode()).hexdigest()[:12]}.tmp"
        self.remove(temp)
        self.create(temp, text)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        target = self.path(name)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self.path(temp), target, options)


@contextmanager
def exclusive(folder: Folder, owner: str) -> Iterator[None]:
    """One run at a time: a lock file that only its maker removes."""
    if not folder.create("run.lock", owner):
        raise ValueError(f"locked by {folder.read('run.lock')}")
    try:
        yield
    finally:
        folder.remove("run.lock")


def checked_run(run: str, workspace: str, full: bool, workspace_empty: bool) -> None:
    """A run's folder must not overlap its workspace, and a full refresh needs a fresh one."""
    a, b = (x.rstrip("/") + "/" for x in (run, workspace))
    if a.startswith(b) or b.startswith(a):
        raise ValueError("the run's folder and the workspace overlap")
    if full and not workspace_empty:
        raise ValueError("a full refresh needs a fresh workspace")


class Staged:
    """Steps of a long acquisition; each is a table, and counts once the state names it.

    A step that was cut off is written anew, for its table is not named yet.
    """

    def __init__(self, folder: Folder) -> None:
        self.folder = folder

    def state(self) -> dict:
        return json.loads(self.folder.read("state.json") or '{"steps": 0, "cursor": null}')

    def advance(self, rows: DataFrame, cursor: str) -> int:
        """Writes the next step, then moves the state on; the number of steps."""
        n = self.state()["steps"]
        rows.write.mode("overwrite").parquet(f"{self.folder.root}/step-{n:06d}")
        self.folder.replace("state.json", json.dumps({"steps": n + 1, "cursor": cursor}))
        return n + 1

    def rows(self) -> DataFrame | None:
        n = self.state()["steps"]
        return self.folder.spark.read.parquet(*[f"{self.folder.root}/step-{i:06d}" for i in range(n)]) if n else None


class Pinned:
    """Progress of a build, bound to the versions and fingerprints that it began with."""

    def __init__(self, folder: Folder, pins: dict[str, str]) -> None:
        self.folder, self.pins = folder, dict(sorted(pins.items()))

    def done(self) -> list[str]:
        """What is done; a state with other pins is an error that names them."""
        text = self.folder.read("build.json")
        if text is None:
            return []
        held = json.loads(text)
        changed = sorted(k for k in {*held["pins"], *self.pins} if held["pins"].get(k) != self.pins.get(k))
        if changed:
            raise ValueError(f"the build began with other {', '.join(changed)}")
        return held["done"]

    def finish(self, name: str) -> None:
        self.folder.replace("build.json", json.dumps({"pins": self.pins, "done": sorted({*self.done(), name})}))


@dataclass
class Outcome:
    source: str
    status: str
    changed: int = 0
    faults: list[str] = field(default_factory=list)


def update_sources(updates: dict[str, Callable[[], tuple[int, list[str]]]], at_once: int = 4) -> list[Outcome]:
    """Runs each source's update; what one raises does not reach the others.

    An update gives the number of changed rows and the faults of single rows.
    """

    def one(source: str) -> Outcome:
        try:
            changed, faults = updates[source]()
        except Exception as e:
            return Outcome(source, "failed", 0, [f"{type(e).__name__}: {e}"])
        return Outcome(source, "partial" if faults else "updated" if changed else "current", changed, list(faults))

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return list(pool.map(one, sorted(updates)))


def retry_after(status: int | None, attempt: int, told: float | None = None, attempts: int = 5, most: float = 120.0) -> float | None:
    """Seconds to wait before the next attempt (from 1), None if there is none; a null status is a lost connection."""
    if attempt >= attempts or (status is not None and status not in RETRYABLE):
        return None
    return min(most, max(0.0, told) if told is not None else float(2 ** (attempt - 1)))


class Ready:
    """The READY latest keys (generation, source, ...) with what was prepared for them."""

    def __init__(self, most: int = READY) -> None:
        self.most, self.held = most, OrderedDict()

    def get(self, key: tuple, make: Callable[[], object]) -> object:
        if key not in self.held:
            self.held[key] = make()
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return self.held[key]


class Timings:
    """Microseconds of each phase of a search, of the queue before it and in all: always the same fields."""

    def __init__(self, queued: int = 0) -> None:
        self.queued, self.started = queued, time.perf_counter_ns()
        self.spent = dict.fromkeys(PHASES, 0)

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        begun = time.perf_counter_ns()
        if name not in self.spent:
            raise ValueError(f"no phase {name}")
        try:
            yield
        finally:
            self.spent[name] += (time.perf_counter_ns() - begun) // 1000

    def told(self) -> dict[str, int]:
        return {**{f"{p}_us": n for p, n in self.spent.items()}, "queue_us": self.queued, "total_us": self.queued + (time.perf_counter_ns() - self.started) // 1000}


def tree_fingerprint(spark: SparkSession, root: str, ignored: tuple[str, ...] = ("run.lock", "staging")) -> tuple[int, int]:
    """Files below a folder and a digest of their paths and bytes; parts of a path in ``ignored`` are left out.

    Each file's digest is over the lengths too, so no two trees share a
    spelling; the digests add up on the executors.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    above = "/" + root.split(":", 1)[-1].strip("/")
    below = F.substring(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), len(above) + 2, 1 << 30)
    kept = ~F.arrays_overlap(F.split("below", "/"), F.array(*[F.lit(x) for x in ignored])) if ignored else F.lit(True)
    named = files.withColumn("below", below).where(kept)
    line = F.concat_ws(":", F.octet_length("below"), "below", F.octet_length("content"), F.sha2("content", 256))
    got = fingerprint(named.select(F.lit(1).alias("all"), line.alias("line")), "line", ["all"]).first()
    return (got.records, got.digest) if got else (0, 0)


def entry_faults(entries: DataFrame, formats: dict[str, int]) -> DataFrame:
    """source_id and faults of the entries of a manifest (kind, format, path, sha256, first_id, last_id, rows) that break a rule."""
    known = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("format") == v), True) for k, v in formats.items()], F.lit(False))
    safe = F.coalesce(~F.col("path").rlike(r"(^|/)\.\.?(/|$)|^/|\\|//|^$"), F.lit(False))
    digest = F.coalesce(F.col("sha256").rlike(_DIGEST), F.lit(False))
    whole = F.coalesce((F.col("last_id") - F.col("first_id") + 1 == F.col("rows")) & (F.col("first_id") >= 0), F.lit(False))
    rules = {"format": known, "path": safe, "digest": digest, "range": whole}
    why = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return entries.select("source_id", "kind", why.alias("faults")).where(F.size("faults") > 0)


def schema_faults(have: StructType, want: StructType) -> list[str]:
    """Columns that are missing, unknown or of another type; order does not count."""
    a, b = ({f.name: f.dataType.simpleString() for f in s} for s in (have, want))
    return [f"{n}: {a.get(n, 'missing')}, not {b.get(n, 'known')}" for n in sorted({*a, *b}) if a.get(n) != b.get(n)]


def evaluated(cases: DataFrame, hits: DataFrame, top: int, slowest_ms: float) -> DataFrame:
    """Verdict of each case (case_id, expected array, evidence, latency_ms) on its hits (case_id, rank, document, text).

    recall: share of the expected documents among the first ``top`` hits; a
    case passes with all of them, its evidence (if any) in a hit, whatever the
    case and blanks, and its latency within the limit.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    # at most ``top`` hits a case meet here
    got = hits.where(F.col("rank") <= top).groupBy("case_id").agg(F.collect_set("document").alias("docs"), F.collect_list(plain(F.col("text"))).alias("texts"))
    none = F.array().cast("array<string>")
    both = cases.join(got, "case_id", "left").withColumn("docs", F.coalesce("docs", none)).withColumn("texts", F.coalesce("texts", none))
    missing = F.array_except(F.coalesce("expected", none), "docs")
    n = F.size(F.array_distinct(F.coalesce("expected", none)))
    shown: Column = F.coalesce(F.exists("texts", lambda t: F.contains(t, plain(F.col("evidence")))), F.lit(True)) | F.col("evidence").isNull()
    fast = F.coalesce(F.col("latency_ms") <= slowest_ms, F.lit(False))
    told = both.select("case_id", F.when(n > 0, (n - F.size(missing)) / n).otherwise(F.lit(1.0)).alias("recall"), shown.alias("evidence_found"), fast.alias("fast"))
    return told.withColumn("passed", (F.col("recall") == 1) & F.col("evidence_found") & F.col("fast"))
