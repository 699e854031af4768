"""Readers of acquired workspaces: payload files and stored documents become normalised documents.

A document that can't be read is a row with a fault, not an error of the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import html
from lodestack.sources import acquire

RESULT = "canonical_id string, title string, text string, headings array<string>, fault string"
_RESULT = pa.schema([("canonical_id", pa.string()), ("title", pa.string()), ("text", pa.string()), ("headings", pa.list_(pa.string())), ("fault", pa.string())])


def _normalised(source: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                title = text = None
                heads: list[str] = []
                fault = row["fault"]
                if fault is None:
                    try:
                        page = bytes(row["content"]).decode("utf-8")
                        _, text, title = html.cleaned(page, source)
                        heads = html.headings(html.parse(page))
                        fault = None if text.strip() else "no text"
                    except (UnicodeDecodeError, ValueError) as e:
                        fault = f"{type(e).__name__}: {e}"
                out.append({"canonical_id": row["canonical_id"], "title": title, "text": text, "headings": heads, "fault": fault})
            yield pa.RecordBatch.from_pylist(out, schema=_RESULT)

    return run


def payload_documents(inventory: DataFrame, files: DataFrame, source: str = "ato") -> DataFrame:
    """Normalised documents of an inventory (canonical_id, path, size, sha256) and its files (path, content).

    A file that is missing, or whose size or digest is not the recorded one, is
    a fault. Markup is read in Arrow batches, each file once.
    """
    joined = inventory.select("canonical_id", "path", "size", "sha256").join(files.select("path", "content"), "path", "left")
    fault = F.when(F.col("content").isNull(), "payload is missing").when(~acquire.payload_intact(F.col("size"), F.col("sha256"), F.col("content")), "payload differs from its record")
    return joined.select("canonical_id", "content", fault.alias("fault")).mapInArrow(_normalised(source), RESULT)


def read_payloads(spark: SparkSession, root: str, inventory: DataFrame, source: str = "ato") -> DataFrame:
    """:func:`payload_documents` over the files below a folder; paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.split(":", 1)[-1].strip("/"))
    below = F.element_at(F.split("path", F.concat(F.lit("\\Q"), base, F.lit("\\E/")), 2), 2)
    return payload_documents(inventory, files.select(below.alias("path"), "content"), source)


def stored_documents(inventory: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """Inventory rows (canonical_id, content_hash) with their stored documents (content_hash, ``fields``, html) and a fault, if any.

    The hash is made anew from the fields, so a stored document that was
    changed is told; one hash may serve several inventory rows.
    """
    held = stored.withColumn("__made", acquire.content_hash(*[F.col(c) for c in fields]))
    joined = inventory.select("canonical_id", "content_hash").join(held, "content_hash", "left")
    fault = F.when(F.col("__made").isNull(), "document is missing").when(F.col("__made") != F.col("content_hash"), "document differs from its hash")
    return joined.select("canonical_id", "content_hash", *fields, fault.alias("fault"))


def with_internal_links(documents: DataFrame, addresses: DataFrame, key: str = "canonical_id", text: str = "html") -> DataFrame:
    """``text`` with each href whose address (without its fragment) is a known one (url, target) turned into ``doc:TARGET``.

    Only documents that hold a known address are rewritten, and only addresses
    are joined: a text stays in its row until its own few links come back.
    """
    attr = r'href="([^"#]+)'
    links = documents.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(attr), F.lit(1)))).alias("url"))
    known = links.join(addresses.select("url", "target"), "url").groupBy(key).agg(F.sort_array(F.collect_set(F.struct("url", "target"))).alias("__links"))
    joined = documents.join(known, key, "left")
    # the closing quote or fragment belongs to the match, so one address is never taken for the head of another
    def put(whole, link):  # noqa: ANN001, ANN202
        for end in ('"', "#"):
            whole = F.replace(whole, F.concat(F.lit('href="'), link["url"], F.lit(end)), F.concat(F.lit('href="doc:'), link["target"], F.lit(end)))
        return whole

    done = F.aggregate("__links", F.col(text), put)
    return joined.withColumn(text, F.when(F.col("__links").isNull(), F.col(text)).otherwise(done)).drop("__links")
