"""Read-only tools over a corpus: chunks with context, assets, anchors, definitions, statistics, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import definition_term
from lodestack.ident import ChunkRef, DocUri, decode_cursor, encode_cursor
from lodestack.operators import corpus
from lodestack.sources import listings


def get_chunks(chunks: DataFrame, refs: list[ChunkRef], before: int = 0, after: int = 0, max_chars: int = corpus.CHARS, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """Chunks in the order asked for, with neighbours, within a budget of characters; and a cursor to go on from.

    A cursor belongs to the exact arguments that made it. It names the chunk
    where the page before ended and the character in it, so a page reads that
    chunk and later ones only.
    """
    if not 1 <= len(refs) <= corpus.CHUNK_IDS:
        raise ValueError(f"1 to {corpus.CHUNK_IDS} chunks")
    if not 0 <= before <= corpus.CONTEXT or not 0 <= after <= corpus.CONTEXT or not 1 <= max_chars <= corpus.CHARS_HARD:
        raise ValueError("context or budget out of bounds")
    args = {"refs": [str(r) for r in refs], "before": before, "after": after, "max_chars": max_chars}
    at = [0, -1, 0]
    if cursor:
        state = decode_cursor(cursor)
        at = state.pop("at", None) if isinstance(state, dict) else None
        if state != args or not (isinstance(at, list) and len(at) == 3 and all(isinstance(x, int) and x >= -1 for x in at)):
            raise ValueError("cursor of another request")
    spark = chunks.sparkSession
    # documents and places of at most 100 chunks; their ids go into the scan's filter
    sources, ids = sorted({r.source for r in refs}), sorted({r.chunk_id for r in refs})
    known = {(r.source_id, r.chunk_id): (r.native_id, r.ord) for r in chunks.where(F.col("source_id").isin(sources) & F.col("chunk_id").isin(ids)).select("source_id", "chunk_id", "native_id", "ord").collect()}
    lost = [str(r) for r in refs if (r.source, r.chunk_id) not in known]
    if lost:
        raise ValueError(f"unknown chunk {', '.join(lost)}")
    found = spark.createDataFrame([(i, r.source, *known[r.source, r.chunk_id]) for i, r in enumerate(refs)], "seq long, source_id string, native_id string, ord long").select("seq", F.struct("source_id", "native_id").alias("doc"), "ord")
    mine = chunks.where(F.col("source_id").isin(sources) & F.col("native_id").isin(sorted({n for n, _ in known.values()})))
    # at most 100 requests of 41 chunks
    near = corpus.neighbours(found, mine.withColumn("doc", F.struct("source_id", "native_id")), before, after, "doc", "ord", bounded=True)
    left = near.where((F.col("seq") > at[0]) | (F.col("seq") == at[0]) & (F.col("ord") >= at[1]))
    start = F.when((F.col("seq") == at[0]) & (F.col("ord") == at[1]), F.lit(at[2])).otherwise(F.lit(0)).cast("bigint")
    w = Window.orderBy("seq", "ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = left.withColumn("from", start).withColumn("length", F.length("text").cast("bigint")).withColumn("ahead", F.sum(F.col("length") - F.col("from")).over(w) - (F.col("length") - F.col("from")))
    end = F.least(F.col("length"), F.col("from") + F.lit(max_chars) - F.col("ahead"))
    told = placed.withColumn("to", end).select("seq", "source_id", "native_id", "chunk_id", "ord", "anchor", "from", "to", "length", "ahead", "text")
    page = told.where((F.col("to") > F.col("from")) | (F.col("length") == F.col("from")) & (F.col("ahead") < max_chars))
    # where the page after this one begins: the first chunk that isn't whole
    rest = told.where((F.col("to") < F.col("length")) | (F.col("ahead") >= max_chars) & (F.col("length") == F.col("from"))).select("seq", "ord", F.greatest("from", "to").alias("from")).orderBy("seq", "ord").first()
    more = encode_cursor({**args, "at": [rest.seq, rest.ord, rest["from"]]}) if rest else None
    out = page.withColumn("text", F.substring("text", F.col("from").cast("int") + 1, (F.col("to") - F.col("from")).cast("int")))
    return out.select("seq", "source_id", "native_id", "chunk_id", "ord", "anchor", "text", F.when(F.col("from") > 0, F.col("from")).alias("resumed_at"), F.when(F.col("to") < F.col("length"), F.col("to")).alias("cut_at")), more


def get_asset(assets: DataFrame, source: str, asset_id: str) -> DataFrame:
    """Caption (alt, else title), media type and the data in base64; no row if there is no such asset."""
    mine = assets.where((F.col("source_id") == source) & (F.col("asset_id") == asset_id))
    return mine.select("asset_id", "native_id", F.coalesce("alt", "title").alias("caption"), "media_type", "sha256", F.base64("data").alias("data"))


def links_within(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, native_id, ord, label, target_chunk_id) of links in stored HTML to a chunk of the same document.

    A link's fragment leads to the first chunk that bears it as its anchor; of
    links with one label to one chunk the first counts.
    """
    doc = ["source_id", "native_id"]
    each = documents.select(F.struct(*doc).alias("doc"), "html")
    links = listings.pieces(each, "doc", F.col("html"), listings.LINKS).withColumn("href", listings.attribute(F.col("piece"), "href")).where(F.col("href").startswith("#") & (F.length("href") > 1))
    named = links.select("doc.*", F.col("place").cast("long").alias("ord"), listings.text_of(F.col("piece")).alias("label"), F.expr("substring(href, 2)").alias("anchor"))
    first = chunks.where(F.col("anchor").isNotNull()).groupBy(*doc, "anchor").agg(F.min_by("chunk_id", "ord").alias("target_chunk_id"))
    told = named.join(first, [*doc, "anchor"])
    return told.groupBy(*doc, "label", "target_chunk_id").agg(F.min("ord").alias("ord")).select(*doc, "ord", "label", "target_chunk_id")


def get_doc_anchors(anchors: DataFrame, documents: DataFrame, citations: DataFrame, source: str, native_id: str, chunks: DataFrame | None = None) -> DataFrame:
    """One row: links within, related documents, other versions and citing documents, each as an array in order.

    The number of citing documents is given only if not all are listed. Where no
    link within is on record, those of the stored HTML are told, if ``chunks``
    are given. An unknown document is an error.
    """
    own = (F.col("source_id") == source) & (F.col("native_id") == native_id)
    if documents.where(own).limit(1).isEmpty():
        raise ValueError(f"unknown document {source}:{native_id}")
    mine = anchors.where(own)
    if chunks is not None and mine.where("kind = 'in_doc'").limit(1).isEmpty():
        within = links_within(documents.where(own), chunks.where(own))
        mine = mine.unionByName(within.withColumn("kind", F.lit("in_doc")), allowMissingColumns=True)
    names = documents.select(F.col("source_id").alias("target_source_id"), F.col("native_id").alias("target_native_id"), F.col("title").alias("target_title"))
    told = mine.join(names, ["target_source_id", "target_native_id"], "left")
    entry = F.struct("ord", "label", "target_source_id", "target_native_id", "target_chunk_id", "target_pit", "target_title")
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry)))
    lists = told.agg(pick("in_doc").alias("in_doc"), pick("sister").alias("related_docs"), pick("history").alias("historical_versions"))
    edges = citations.where((F.col("target_source_id") == source) & (F.col("target_native_id") == native_id))
    edges = edges.where(~((F.col("source_id") == source) & (F.col("source_native_id") == native_id)))
    citing = corpus.cited_by(edges.select(F.lit(native_id).alias("target"), "source_id", F.col("source_native_id").alias("native_id")), documents)
    by = citing.agg(F.array_sort(F.collect_list(F.struct("rank", "source_id", "native_id", "date"))).alias("cited_by"), F.max("total").alias("total"))
    return lists.crossJoin(by).withColumn("cited_by_total", F.when(F.col("total") > F.size("cited_by"), F.col("total"))).drop("total")


def get_definition(defs: DataFrame, documents: DataFrame, term: str, document: str | None = None, max_defs: int = corpus.LEAST_DEFINITIONS, dictionary: DataFrame | None = None) -> DataFrame:
    """Statutory definitions; the dictionary's ordinary meanings only if there are none."""
    spark = defs.sparkSession
    norm = spark.range(1).select(definition_term(F.lit(term)).alias("t")).first().t
    found = corpus.definitions(defs, documents, norm, document, most=max_defs).select("term", "native_id", "source_title", "scope", "body", F.lit("statutory").alias("kind"))
    if dictionary is None or not found.isEmpty():
        return found
    return dictionary.where(F.col("norm") == norm).limit(max_defs).select("term", F.lit(None).cast("string").alias("native_id"), F.lit(None).cast("string").alias("source_title"), F.lit(None).cast("string").alias("scope"), F.col("definition").alias("body"), F.lit("ordinary").alias("kind"))


def stats(documents: DataFrame, chunks: DataFrame, definitions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per source: documents, chunks, vectors, definitions, documents by type and by prefix."""
    n = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    vectors = embeddings.join(chunks.select("chunk_id", "source_id"), "chunk_id")
    kinds = documents.groupBy("source_id", "type").agg(F.count("*").alias("n")).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "type", "n"))).alias("k"))
    prefix = documents.groupBy("source_id", F.upper(F.element_at(F.split("native_id", "/", -1), 1)).alias("prefix")).agg(F.count("*").alias("n"), F.min_by("title", "native_id").alias("description"))
    prefix = prefix.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("prefix", "n", "description"))).alias("prefixes"))
    out = n(documents, "documents")
    for df in (n(chunks, "chunks"), n(vectors, "embeddings"), n(definitions, "definitions")):
        out = out.join(df, "source_id", "left")
    out = out.join(kinds, "source_id").join(prefix, "source_id")
    return out.select("source_id", "documents", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "embeddings", "definitions")], F.transform("k", lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("documents_by_type"), "prefixes")


def fetch(pages: DataFrame, uri: str, key: str = "url") -> DataFrame:
    """The page of a canonical URI, from a table of pages instead of the network."""
    parsed = DocUri.parse(uri)
    return pages.where(F.col(key) == official_url(parsed.native_id, parsed.pit, parsed.view))


def official_url(native_id: str, pit: str | None = None, view: str | None = None, base: str = "https://www.ato.gov.au/law/view/document") -> str:
    from urllib.parse import quote

    query = [("docid", native_id), *([("PiT", pit)] if pit else []), *([("db", view)] if view else [])]
    return base + "?" + "&".join(f"{k}={quote(v, safe='/')}" for k, v in query)


def marker_targets(text: Column) -> Column:
    """All (source, id) that a text's markers name."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[doc:([^\s\]@:]+:[^\s\]@]+)"), F.lit(1)), lambda x: F.struct(F.substring_index(x, ":", 1).alias("source_id"), F.regexp_replace(x, "^[^:]+:", "").alias("native_id")))


def marker_kinds(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_id, source_id, native_id, kind of each marker's target: ``doc`` in the corpus, else ``fetch``; its own document not at all."""
    named = chunks.select("chunk_id", F.struct("source_id", "native_id").alias("own"), F.explode(F.array_distinct(marker_targets(F.col("text")))).alias("t")).where("t <> own").select("chunk_id", "t.*")
    known = documents.select("source_id", "native_id", F.lit("doc").alias("kind"))
    return named.join(known, ["source_id", "native_id"], "left").withColumn("kind", F.coalesce("kind", F.lit("fetch")))
