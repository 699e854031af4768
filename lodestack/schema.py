"""Relational model of a corpus, and validators that quarantine rows instead of failing a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = "source_id string, display_name string"
CORPUS_META = "key string, value string"
SOURCE_META = "source_id string, key string, value string"
DOCUMENTS = """source_id string, native_id string, type string, title string, date string, canonical_url string, upstream_version string,
    downloaded_at string, content_hash string, html string, withdrawn_date string, superseded_by string, replaces string,
    has_in_doc_links boolean, has_related_docs boolean, has_history boolean, headings string"""
CHUNKS = "chunk_id bigint, source_id string, native_id string, ord bigint, anchor string, text string"
DEFINITIONS = "source_id string, definition_id string, term string, norm_term string, native_id string, source_title string, source_type string, scope string, anchor string, ord bigint, body string"
ASSETS = "source_id string, asset_id string, native_id string, media_type string, alt string, title string, sha256 string, data binary"
ANCHORS = "source_id string, native_id string, ord bigint, kind string, label string, target_source_id string, target_native_id string, target_chunk_id bigint, target_pit string"
CITATIONS = "source_chunk_id bigint, source_id string, source_native_id string, target_source_id string, target_native_id string"
EMBEDDING_CACHE = "model_id string, text_sha256 string, embedding array<tinyint>"
CHUNK_EMBEDDINGS = "chunk_id bigint, embedding array<tinyint>"
TABLES = {"sources": SOURCES, "corpus_meta": CORPUS_META, "source_meta": SOURCE_META, "documents": DOCUMENTS, "chunks": CHUNKS, "definitions": DEFINITIONS, "document_assets": ASSETS, "doc_anchors": ANCHORS, "citations": CITATIONS, "embedding_cache": EMBEDDING_CACHE, "chunk_embeddings": CHUNK_EMBEDDINGS}
KEYS = {"sources": ["source_id"], "documents": ["source_id", "native_id"], "chunks": ["chunk_id"], "definitions": ["source_id", "definition_id"], "document_assets": ["source_id", "asset_id"], "doc_anchors": ["source_id", "native_id", "ord"], "citations": ["source_chunk_id", "target_source_id", "target_native_id"], "embedding_cache": ["model_id", "text_sha256"], "chunk_embeddings": ["chunk_id"]}
#: (child, its columns, parent, its columns)
FOREIGN_KEYS = [
    ("documents", ["source_id"], "sources", ["source_id"]),
    ("chunks", ["source_id", "native_id"], "documents", ["source_id", "native_id"]),
    ("definitions", ["source_id", "native_id"], "documents", ["source_id", "native_id"]),
    ("document_assets", ["source_id", "native_id"], "documents", ["source_id", "native_id"]),
    ("doc_anchors", ["source_id", "native_id"], "documents", ["source_id", "native_id"]),
    ("citations", ["source_chunk_id"], "chunks", ["chunk_id"]),
    ("chunk_embeddings", ["chunk_id"], "chunks", ["chunk_id"]),
]
SOURCE_ID = "^[a-z0-9-]+$"
SHA256 = "^[0-9a-f]{64}$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def is_text(c: Column) -> Column:
    """Not blank and free of control characters."""
    return c.isNotNull() & (F.trim(c) != "") & ~c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def is_https(c: Column, hosts: list[str] | None = None) -> Column:
    """An https URL without credentials or port, on one of the exact hosts if given."""
    shape = c.rlike(r"^https://[A-Za-z0-9.-]+(/[^\s]*)?$")
    host = F.lower(F.regexp_extract(c, r"^https://([A-Za-z0-9.-]+)", 1))
    return shape & (host.isin([h.lower() for h in hosts]) if hosts else F.lit(True))


def is_date(c: Column) -> Column:
    return c.rlike(ISO_DATE) & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def inventory_rules() -> dict[str, Column]:
    """What each field of an inventory row must satisfy."""
    return {
        "source_id": F.col("source_id").rlike(SOURCE_ID),
        "native_id": is_text(F.col("native_id")) & (F.octet_length("native_id") <= 256),
        "title": is_text(F.col("title")),
        "canonical_url": is_https(F.col("canonical_url")),
        "content_hash": F.col("content_hash").rlike(SHA256),
        "date": F.col("date").isNull() | is_date(F.col("date")),
    }


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with the names of the broken rules in ``faults``; a null verdict counts as broken."""
    return df.withColumn("faults", F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull()))


def accepted(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(sound rows, quarantined rows with their faults)."""
    checked = validated(df, rules)
    return checked.where(F.size("faults") == 0).drop("faults"), checked.where(F.size("faults") > 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def orphans(child: DataFrame, child_keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Rows of ``child`` whose key isn't in ``parent``; a key with a null part refers to nothing and is sound."""
    keyed = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_keys, child_keys, strict=True)]).distinct()
    return child.where(" and ".join(f"{c} is not null" for c in child_keys)).join(keyed, child_keys, "left_anti")


def require_unique(df: DataFrame, keys: list[str], what: str = "rows") -> DataFrame:
    """``df``, after a job that raises if a key occurs twice."""
    bad = duplicate_keys(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"duplicate {what}: {[tuple(r)[:-1] for r in bad]}")
    return df
