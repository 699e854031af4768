"""Inventories read line by line, bad lines as rows with their reasons, and the contract of a whole snapshot in the same pass.

``read`` never fails on content: each line that isn't blank becomes a document
or a quarantined row. ``contract`` aggregates once over what was read and tells
what holds of the snapshot as a whole (not empty, ids unique, each with a
rendition). ``require`` turns both into an error, for callers that want all or
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack import schema
from lodestack.operators import stored

#: Fixed limits, in bytes.
VERSION_BYTES, TITLE_BYTES, KIND_BYTES, ID_BYTES = 32 * 1024, 128 * 1024, 256, 256
MAX_LINE = 16 * 1024 * 1024
DISCOVERED = "native_id string, upstream_version string, title string, document_type string, date string, citation string, canonical_url string, renditions array<struct<url: string, kind: string>>"
_CONTROL = r"[\x00-\x1F\x7F-\u009F]"


def text_faults(c: Column, name: str, most: int | None = None, optional: bool = False) -> list[tuple[str, Column]]:
    """Reasons why a text is refused, each with its condition."""
    there = c.isNotNull() if optional else F.lit(True)
    rules = [
        (f"{name}: missing", c.isNull() & F.lit(not optional)),
        (f"{name}: empty", there & (F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "") == "")),
        (f"{name}: white space around it", there & c.rlike(r"^[\s ]+\S|\S[\s ]+$")),
        (f"{name}: control characters", there & c.rlike(_CONTROL)),
    ]
    if most:
        rules.append((f"{name}: longer than {most} bytes", there & (F.octet_length(c) > most)))
    return rules


def url_faults(c: Column, name: str, hosts: list[str]) -> list[tuple[str, Column]]:
    host = F.lower(F.regexp_extract(c, r"^https://(?:[^/?#]*@)?\[?([^/?#:\]]+)", 1))
    return [
        (f"{name}: missing", c.isNull()),
        (f"{name}: not https", ~c.startswith("https://")),
        (f"{name}: white space", c.rlike(r"[\s ]")),
        (f"{name}: credentials", c.rlike(r"^https://[^/?#]*@")),
        (f"{name}: port", c.rlike(r"^https://[^/?#]*:\d+(?:[/?#]|$)")),
        (f"{name}: another host", ~host.isin([h.lower() for h in hosts])),
    ]


def media_type_faults(c: Column, name: str) -> list[tuple[str, Column]]:
    token = r"[A-Za-z0-9!#$&^_.+-]+"
    return [*text_faults(c, name), (f"{name}: no media type", ~c.rlike(rf"^{token}/{token}(?:\s*;\s*{token}=(?:{token}|\"[^\"]*\"))*$"))]


def path_faults(c: Column, name: str) -> list[tuple[str, Column]]:
    """Payload paths: relative, forward slashes, no empty, ``.`` or ``..`` part."""
    parts = F.split(F.regexp_replace(c, "^/", ""), "/", -1)
    return [*text_faults(c, name), (f"{name}: absolute", c.rlike(r"^(?:/|[A-Za-z]:)")), (f"{name}: backslash", c.contains("\\")), (f"{name}: parts", F.exists(parts, lambda p: p.isin("", ".", "..")))]


def digest_faults(c: Column, name: str) -> list[tuple[str, Column]]:
    return [(f"{name}: missing", c.isNull()), (f"{name}: no sha256", ~c.rlike("^[0-9a-f]{64}$"))]


def html_faults(c: Column, name: str) -> list[tuple[str, Column]]:
    """Markup that can act: scripts, event handlers, script URLs, embedded documents."""
    return [
        (f"{name}: active element", c.rlike(r"(?i)<\s*(?:script|iframe|object|embed|applet|form|base|meta|link)\b")),
        (f"{name}: event handler", c.rlike(r"(?i)<[^>]*\son[a-z]+\s*=")),
        (f"{name}: script URL", c.rlike(r"(?i)(?:href|src)\s*=\s*[\"']?\s*(?:javascript|vbscript|data)\s*:")),
    ]


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that are broken; a rule that can't be decided for a null is not."""
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())


def discovery_rules(hosts: list[str]) -> list[tuple[str, Column]]:
    """What each discovered document must satisfy."""
    c = F.col
    dated = c("date").isNotNull() & ~F.coalesce(schema.is_date(c("date")), F.lit(False))
    bad_url = lambda u: (~u.rlike(r"^https://[^\s/?#@:]+(?:[/?#]\S*)?$")) | ~F.lower(F.regexp_extract(u, r"^https://([^/?#:]+)", 1)).isin([h.lower() for h in hosts])
    return [
        *text_faults(c("native_id"), "native_id", ID_BYTES),
        *text_faults(c("upstream_version"), "upstream_version", VERSION_BYTES),
        *text_faults(c("title"), "title", TITLE_BYTES),
        *text_faults(c("document_type"), "document_type", KIND_BYTES),
        ("date: no day", dated),
        *url_faults(c("canonical_url"), "canonical_url", hosts),
        ("renditions: none", c("renditions").isNull() | (F.size("renditions") == 0)),
        ("renditions: a bad url", F.exists("renditions", lambda r: F.coalesce(bad_url(r["url"]), F.lit(True)))),
    ]


def read(spark: SparkSession, path: str, ddl: str = DISCOVERED, rules: list[tuple[str, Column]] | None = None, key: str = "native_id", max_bytes: int | None = None, max_line: int = MAX_LINE) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantined) of JSON lines: quarantined rows are (line, bytes, reasons).

    Lines end with a line feed, with or without a carriage return; blank ones
    are skipped. A line that is too long, no UTF-8 or no JSON of the schema, or
    breaks a rule, is quarantined; of lines with one key all are. Files of more
    than ``max_bytes`` together are refused before any is read.
    """
    if max_bytes is not None:
        held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length").alias("n")).first().n or 0
        if held > max_bytes:
            raise stored.StoredError(f"{path}: {held} bytes, {max_bytes} are allowed")
    kind = StructType.fromDDL(ddl)
    lines = spark.read.option("lineSep", "\n").text(path)
    # a byte that is no UTF-8 was read as U+FFFD
    line = F.regexp_replace("value", "\r$", "")
    told = lines.where(F.trim(F.regexp_replace(line, r"\s+", " ")) != "").select(line.alias("line")).withColumn("bytes", F.octet_length("line"))
    shaped = StructType([*kind.fields]).add("__corrupt", "string")
    parsed = told.withColumn("__d", F.when(F.col("bytes") <= max_line, F.from_json("line", shaped, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})))
    flat = parsed.select("line", "bytes", "__d", *[F.col(f"__d.{f.name}").alias(f.name) for f in kind.fields])
    form = F.when(F.col("bytes") > max_line, F.array(F.lit("line: too long"))).when(F.col("__d").isNull() | F.col("__d.__corrupt").isNotNull(), F.array(F.lit("line: no JSON of this schema"))).when(F.col("line").contains("�"), F.array(F.lit("line: no UTF-8")))
    checked = flat.withColumn("reasons", F.coalesce(form, reasons(rules or [])))
    # copies are found among all lines that have a key: a sound one is no better than its twin
    copies = F.count("*").over(Window.partitionBy(key))
    checked = checked.withColumn("reasons", F.when(F.col(key).isNotNull() & form.isNull() & (copies > 1), F.array_append("reasons", F.lit(f"{key}: repeated"))).otherwise(F.col("reasons")))
    return checked.where(F.size("reasons") == 0).select(*[f.name for f in kind.fields]), checked.where(F.size("reasons") > 0).select("line", "bytes", "reasons")


def contract(documents: DataFrame, quarantined: DataFrame) -> dict[str, int]:
    """Documents, refused lines, and refused lines by reason: one aggregate over each."""
    told = {"documents": documents.count()}
    by = quarantined.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    told |= {r.reason: r.n for r in by.collect()}
    return told


def require(documents: DataFrame, quarantined: DataFrame) -> DataFrame:
    """``documents``, or an error that names what is wrong: any refused line, or no document at all."""
    bad = quarantined.limit(3).collect()
    if bad:
        raise ValueError("refused lines: " + "; ".join(f"{r.line[:60]!r} ({', '.join(r.reasons)})" for r in bad))
    if documents.isEmpty():
        raise ValueError("no authoritative documents")
    return documents
