"""A stable snapshot of a source that is read page by page while it changes, and pages of an immutable ranking.

A scan is trusted when a second one, begun after it ended, gives the same: same
number of rows, same bounds, same digest of the set. Digests are sums of row
hashes, so both scans are reduced where they are read. What a scan declares
about its pages is checked by interval coverage: ranges must follow each other
without gap or overlap up to the declared total.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.stored import scratch

ATTEMPTS = 3


class Unstable(ValueError):
    """A source that changed between the scans of every attempt."""


@dataclass(frozen=True)
class Seal:
    """What two scans must agree on."""

    rows: int
    first: str | None
    last: str | None
    digest: str


def sealed(rows: DataFrame, key: str, columns: list[str]) -> Seal:
    """One aggregate over a scan; null fields and separators can't be confused, for each field is hashed with its name."""
    whole = F.xxhash64(*[F.coalesce(F.concat(F.lit(f"{c}="), F.col(c).cast("string")), F.lit(f"{c}-")) for c in columns])
    again = F.xxhash64(F.lit(7), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    total = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    got = rows.agg(F.count("*").alias("n"), F.min(key).cast("string").alias("a"), F.max(key).cast("string").alias("z"), F.concat_ws("/", total(whole), total(again)).alias("d")).first()
    return Seal(got.n, got.a, got.z, got.d)


def stable(scan: Callable[[int], DataFrame], key: str, attempts: int = ATTEMPTS) -> tuple[DataFrame, Seal, int]:
    """(rows, seal, scans made). ``scan(i)`` reads the source for the i-th time.

    A scan that agrees with the one before is the snapshot; a disagreement makes
    the later one the next candidate, so each new attempt costs one scan. The
    candidate is kept as it was read, not read again.
    """
    held = scratch(scan(0), "scan")
    seal = sealed(held, key, held.columns)
    for i in range(1, attempts + 1):
        now = scratch(scan(i), "scan")
        other = sealed(now, key, held.columns)
        if other == seal:
            return now, seal, i + 1
        held, seal = now, other
    raise Unstable(f"the source changed between all of {attempts + 1} scans; last: {seal}")


def coverage_faults(ranges: DataFrame, by: list[str], first: str, last: str, total: str) -> DataFrame:
    """Gaps, overlaps and wrong ends of declared page ranges (inclusive): by, fault, from, to.

    A range may lie within earlier ones, so each is held against the greatest
    end of all before it, not against its neighbour.
    """
    order = Window.partitionBy(*by).orderBy(first, last)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one shuffle and one sort for all kinds of faults: what has come so far is, at the last range, the whole
    told = ranges.select(
        *by,
        F.col(first).cast("long").alias("__a"),
        F.col(last).cast("long").alias("__b"),
        F.coalesce(F.max(last).over(before), F.lit(0)).cast("long").alias("__end"),
        F.lead(F.lit(True)).over(order).isNull().alias("__done"),
        F.max(last).over(so_far).cast("long").alias("__last"),
        F.max(total).over(so_far).cast("long").alias("__total"),
        F.min(total).over(so_far).cast("long").alias("__least"),
    )
    kinds = (
        ("gap", "__a > __end + 1", "__end + 1", "__a - 1"),
        ("overlap", "__a <= __end", "__a", "least(__b, __end)"),
        ("short", "__done and __last < __total", "__last + 1", "__total"),
        ("beyond", "__done and __last > __total", "__total + 1", "__last"),
        ("moving total", "__done and __least < __total", "__least", "__total"),
    )
    each = F.array(*[F.when(F.expr(holds), F.struct(F.lit(name).alias("fault"), F.expr(low).alias("from"), F.expr(high).alias("to"))) for name, holds, low, high in kinds])
    return told.select(*by, F.inline(F.filter(each, lambda x: x.isNotNull())))


def cursor_of(ranking: str, score: float, ident: int) -> str:
    raw = json.dumps({"ranking": ranking, "score": float(score).hex(), "id": ident}, separators=(",", ":"), sort_keys=True)
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def _decoded(cursor: str, ranking: str) -> tuple[float, int]:
    try:
        told = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if told["ranking"] != ranking:
            raise ValueError("cursor of another ranking")
        return float.fromhex(told["score"]), int(told["id"])
    except (KeyError, TypeError, UnicodeDecodeError, json.JSONDecodeError) as e:
        raise ValueError("not a cursor") from e


class Ranking:
    """An immutable ranking (id, score), stored in ranking order and read by seeking.

    A page is what lies behind (score, id) of the last row of the page before.
    The ranking is stored sorted by range, so that condition prunes files and
    row groups by their bounds: no page reads the ones before it.
    """

    def __init__(self, stored_rows: DataFrame, name: str, ident: str = "chunk_id", score: str = "score") -> None:
        self.rows, self.name, self.ident, self.score = stored_rows, name, ident, score

    @classmethod
    def store(cls, scored: DataFrame, path: str, name: str, ident: str = "chunk_id", score: str = "score") -> Ranking:
        """NaN and null scores are no ranks: they are left out."""
        kept = scored.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).withColumn(score, F.col(score).cast("double"))
        kept.orderBy(F.col(score).desc(), F.col(ident).asc()).write.parquet(path)
        return cls(scored.sparkSession.read.parquet(path), name, ident, score)

    def _behind(self, score: float, ident: int) -> Column:
        s, i = F.col(self.score), F.col(self.ident)
        return (s <= score) & ((s < score) | (i > ident))

    def page(self, size: int, cursor: str | None = None) -> tuple[DataFrame, str | None]:
        """The next ``size`` rows, and the cursor of the page after them (None if there is none)."""
        if size < 1:
            raise ValueError("a page has at least one row")
        left = self.rows if cursor is None else self.rows.where(self._behind(*_decoded(cursor, self.name)))
        best = left.orderBy(F.col(self.score).desc(), F.col(self.ident).asc()).limit(size + 1).collect()
        page = best[:size]
        more = cursor_of(self.name, page[-1][self.score], page[-1][self.ident]) if len(best) > size else None
        return self.rows.sparkSession.createDataFrame(page, self.rows.schema), more
