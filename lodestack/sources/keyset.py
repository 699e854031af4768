"""Keyset paging as a Spark data source: ordered pages up to a fixed ceiling, in batch or as a stream.

What pages a service has answered is kept as it came (:func:`record`): a folder
``page=N`` for each page, rows as JSON lines in the order of the keys. The
source reads these as it would read the service. Each task takes a run of
pages, checks that no page is larger than asked for and that keys rise within
and across pages, and stops at the ceiling. The last key of the run before is
part of a task's description, so the order is checked across tasks too.

Options: ``path``, ``keys`` (comma-separated, most significant first),
``page_size``, ``ceiling`` and ``lower`` (JSON arrays of keys, inclusive),
``pages_per_task``, ``pages_per_batch`` (stream).

    spark.dataSource.register(KeysetSource)
    spark.read.format("keyset").schema(ddl).option("path", p).option("keys", "at,id").load()
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import DataType, DateType, DecimalType, StructType, TimestampType

from lodestack.operators.order import numbered


class PagingError(ValueError):
    """Pages that are out of order, too large or missing."""


def record(rows: DataFrame, keys: list[str], page_size: int, path: str, ceiling: tuple | None = None) -> None:
    """Pages of ``rows`` as a keyset scan up to ``ceiling`` would get them. Rows are numbered by a range sort, not by one task."""
    if not 0 < page_size:
        raise ValueError(f"page size {page_size}")
    if ceiling is not None:
        rows = rows.where(F.struct(*keys) <= F.struct(*[F.lit(v).cast(rows.schema[k].dataType) for k, v in zip(keys, ceiling, strict=True)]))
    paged = numbered(rows, [], keys, "__no").withColumn("page", F.expr(f"__no div {page_size}"))
    paged.repartition("page").sortWithinPartitions("page", "__no").drop("__no").write.partitionBy("page").json(path)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _pages(path: str) -> list[tuple[int, list[str]]]:
    """Numbers and files of all pages, in order; a missing number is an error."""
    fs, root = _opened(path)
    found: dict[int, list[str]] = {}
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
        if info.is_file and (m := re.search(r"/page=(\d+)/[^/_.][^/]*$", info.path)):
            found.setdefault(int(m[1]), []).append(info.path)
    numbers = sorted(found)
    if numbers != list(range(len(numbers))):
        raise PagingError(f"pages are missing: {len(numbers)} of {numbers[-1] + 1}")
    return [(n, sorted(found[n])) for n in numbers]


def _rows(path: str, files: list[str]) -> list[dict]:
    fs, _ = _opened(path)
    out = []
    for f in files:
        with fs.open_input_stream(f) as s:
            out += [json.loads(line) for line in s.read().decode("utf-8").splitlines() if line.strip()]
    return out


@dataclass
class Run(InputPartition):
    """A run of pages and the last key before it."""

    pages: list[tuple[int, list[str]]]
    after: list | None
    last: bool


def _value(v: object, kind: DataType) -> object:
    if v is None:
        return None
    if isinstance(kind, TimestampType):
        return datetime.fromisoformat(str(v))
    if isinstance(kind, DateType):
        return date.fromisoformat(str(v))
    return Decimal(str(v)) if isinstance(kind, DecimalType) else v


class _Reading:
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path = schema, options["path"]
        self.keys = [k.strip() for k in options["keys"].split(",")]
        self.size = int(options.get("page_size", 1000))
        bound = lambda name: json.loads(options[name]) if name in options else None
        self.lower, self.ceiling = bound("lower"), bound("ceiling")
        self.per_task = int(options.get("pages_per_task", 16))
        self.per_batch = int(options.get("pages_per_batch", 1 << 30))

    def key(self, row: dict) -> list:
        return [row.get(k) for k in self.keys]

    def runs(self, pages: list[tuple[int, list[str]]], before: list[str] | None, whole: bool) -> list[Run]:
        """Pages in runs; of the page before each run only its last key is read."""
        out, previous = [], before
        for i in range(0, len(pages), self.per_task):
            part = pages[i : i + self.per_task]
            rows = _rows(self.path, previous) if previous else []
            out.append(Run(part, self.key(rows[-1]) if rows else None, whole and i + self.per_task >= len(pages)))
            previous = part[-1][1]
        return out

    def read(self, run: Run) -> Iterator[tuple]:
        after = run.after
        for at, (number, files) in enumerate(run.pages):
            rows = _rows(self.path, files)
            if len(rows) > self.size:
                raise PagingError(f"page {number} has {len(rows)} rows, {self.size} were asked for")
            if len(rows) < self.size and not (run.last and at == len(run.pages) - 1):
                raise PagingError(f"page {number} is short, but not the last")
            for row in rows:
                key = self.key(row)
                if after is not None and key <= after:
                    raise PagingError(f"page {number}: {key} after {after}")
                after = key
                if self.ceiling is not None and key > self.ceiling:
                    return
                if self.lower is None or key >= self.lower:
                    yield tuple(_value(row.get(f.name), f.dataType) for f in self.schema)


class KeysetReader(_Reading, DataSourceReader):
    """The whole scan."""

    def partitions(self) -> list[Run]:
        return self.runs(_pages(self.path), None, True) or [Run([], None, True)]


class KeysetStream(_Reading, DataSourceStreamReader):
    """The scan as a stream: an offset is a number of pages, so a restart goes on where the checkpoint says."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        super().__init__(schema, options)
        self.reached = 0

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        """All whole pages, at most so many more than before; the last, short page comes once it is full or a batch read takes it."""
        pages = _pages(self.path)
        self.reached = min(len(pages), self.reached + self.per_batch)
        return {"pages": self.reached}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        pages = _pages(self.path)
        self.reached = max(self.reached, end["pages"])
        before = pages[start["pages"] - 1][1] if start["pages"] else None
        return self.runs(pages[start["pages"] : end["pages"]], before, end["pages"] == len(pages)) or [Run([], None, True)]

    def commit(self, end: dict) -> None:
        pass


class KeysetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> str:
        raise ValueError("give the schema of the pages' rows")

    def reader(self, schema: StructType) -> KeysetReader:
        return KeysetReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> KeysetStream:
        return KeysetStream(schema, dict(self.options))
