"""Policy filters as Column builders; Catalyst pushes what it can into the scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed policy values.
OLD_CONTENT_CUTOFF = "2000-01-01"
DEFAULT_EXCLUDED_TYPES = ("EV",)
LEGISLATION_TYPES = ("PAC", "REG", "RPC", "RRG")
POLICY_SOURCE = "ato"


def like_pattern(glob: str, wild: str = "*") -> str:
    """A glob as a LIKE pattern with ``\\`` escapes: characters of ``wild`` match anything, all else is literal."""
    return "".join("%" if c in wild else "\\" + c if c in "%_\\" else c for c in glob)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def glob(c: Column, pattern: str, wild: str = "*") -> Column:
    """LIKE that ignores the case of ASCII letters only."""
    lowered = "".join(x.lower() if x.isascii() else x for x in pattern)
    return ascii_lower(c).like(like_pattern(lowered, wild))


@dataclass(frozen=True)
class FilterSpec:
    """What a search is limited to. No types and an empty list of types are the same."""

    source: str
    types: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    scope: str | None = None
    include_old: bool = False
    current_only: bool = True
    policy_source: str = field(default=POLICY_SOURCE)

    def key(self) -> str:
        return repr(self)


def type_filter(types: tuple[str, ...], c: Column) -> Column:
    """Any of the exact types (case counts) or type globs (``*`` only; case doesn't)."""
    exact = [t for t in types if "*" not in t]
    out = c.isin(exact) if exact else F.lit(False)
    for t in types:
        if "*" in t:
            out = out | glob(c, t)
    return out


def document_filter(spec: FilterSpec) -> Column:
    """The conjunction of all that ``spec`` asks of a document row."""
    out = F.col("source_id") == spec.source
    kind, date = F.col("type"), F.col("date")
    policy = spec.source == spec.policy_source
    if spec.types:
        out = out & type_filter(tuple(spec.types), kind)
    elif policy:
        out = out & ~kind.isin(*DEFAULT_EXCLUDED_TYPES)
    if spec.date_from:
        out = out & (date >= spec.date_from)
    if spec.date_to:
        out = out & (date <= spec.date_to)
    if spec.scope:
        out = out & glob(F.col("native_id"), spec.scope, "*%")
    if policy and not spec.include_old:
        out = out & (date.isNull() | (date >= OLD_CONTENT_CUTOFF) | kind.isin(*LEGISLATION_TYPES))
    if spec.current_only:
        out = out & F.col("withdrawn_date").isNull() & F.col("superseded_by").isNull()
    return out


def unknown_types(documents: DataFrame, source: str, types: list[str]) -> list[str]:
    """Exact types asked for that the source doesn't have."""
    exact = sorted({t for t in types if "*" not in t})
    if not exact:
        return []
    spark = documents.sparkSession
    asked = spark.createDataFrame([(t,) for t in exact], "type string")
    have = documents.where((F.col("source_id") == source) & F.col("type").isin(exact)).select("type").distinct()
    return [r.type for r in asked.join(have, "type", "left_anti").orderBy("type").collect()]


def require_types(documents: DataFrame, source: str, types: list[str]) -> None:
    bad = unknown_types(documents, source, types)
    if bad:
        raise ValueError(f"unknown types for {source}: {', '.join(bad)}")


def scope_bounds(document_filter_rows: DataFrame, source: str, scope: str) -> tuple[str, int | None, int | None]:
    """``empty``, ``range`` (one document: its first and last chunk) or ``unbounded``."""
    rows = document_filter_rows.where((F.col("source_id") == source) & glob(F.col("native_id"), scope, "*%")).select("first_chunk_id", "last_chunk_id").limit(2).collect()
    if not rows:
        return "empty", None, None
    return ("range", rows[0][0], rows[0][1]) if len(rows) == 1 else ("unbounded", None, None)
