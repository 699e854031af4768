"""The seven tools, as their callers use them, over a corpus that is derived from the given tables.

A document is a row of ``documents``, its chunks are the lines of its text, its
vectors those of ``embeddings`` (of its first line). ``Engine`` and
``retrieval`` do all the work; queries only flatten what they return.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import definition_term, simple_tokens
from lodestack.ident import ChunkRef, DocUri
from lodestack.operators import lexical, lexstore, plane, retrieval
from lodestack.operators.search import EmbeddingProvider, Engine, SearchOptions
from lodestack.plans import store
from lodestack.plans.registry import query, table

SOURCE, LINES = "lib", 1 << 20
QUERY = "the and"
SEED = 7 * LINES


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        F.lit(SOURCE).alias("source_id"),
        F.concat(F.upper(F.coalesce("lang", F.lit("xx"))), F.lit("/"), i.cast("string")).alias("native_id"),
        F.upper(F.coalesce("lang", F.lit("xx"))).alias("type"),
        F.concat(F.lit("Item "), i.cast("string"), F.lit(" of "), F.coalesce("source", F.lit("none"))).alias("title"),
        F.when(i % 10 != 0, F.concat((F.lit(1990) + i % 30).cast("string"), F.lit("-0"), (1 + i % 9).cast("string"), F.lit("-11"))).alias("date"),
        F.concat(F.lit("https://lib.example/"), i.cast("string")).alias("canonical_url"),
        F.when(i % 9 == 0, F.lit("2020-01-01")).alias("withdrawn_date"),
        F.when(i % 13 == 0, F.lit("EN/1")).alias("superseded_by"),
        F.coalesce("source", F.lit("none")).alias("headings"),
        F.concat(F.lit('<p><a href="#l0">First '), i.cast("string"), F.lit('</a> <a href="#l1"><b>Second</b></a> <a href="#l0">First '), i.cast("string"), F.lit('</a> <a href="#gone">x</a> <a href="/x">y</a></p>')).alias("html"),
        F.col("text"),
        i.alias("doc_id"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    each = d.select("source_id", "native_id", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ord", "text"))
    return each.select((F.col("doc_id") * LINES + F.col("ord")).alias("chunk_id"), "source_id", "native_id", F.col("ord").cast("long").alias("ord"), F.when(F.col("ord") < 2, F.concat(F.lit("l"), F.col("ord").cast("string"))).alias("anchor"), "text")


class StoredSeed(EmbeddingProvider):
    """Stands for a model: every query has the vector of one chunk."""

    model_id, dim = "stored", 64

    def __init__(self, held: plane.Plane) -> None:
        self.held = held

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.held.vector(SOURCE, SEED) for _ in texts]


def engine(spark: SparkSession, sf_dir: str, words: bool = True, vectors_: bool = True) -> Engine:
    """An engine over the stored index and plane of this corpus, built by the first query that asks.

    A caller whose mode reads no ``words`` or no ``vectors_`` opens (and so
    builds) no structure for them.
    """
    texts, vectors = [f"{sf_dir}/documents.parquet"], [f"{sf_dir}/embeddings.parquet"]

    def index(path: str) -> None:
        rows = chunks(spark, sf_dir).select("source_id", F.col("chunk_id").alias("row_id"), F.lit(0).alias("col"), simple_tokens(F.col("text")).alias("tokens"))
        lexstore.build(rows, path, buckets=32)

    def floats(path: str) -> None:
        # vectors without a document belong to no chunk
        held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")).distinct()
        rows = table(spark, sf_dir, "embeddings").join(held, "vec_id", "left_semi").select(F.lit(SOURCE).alias("source_id"), (F.col("vec_id") * LINES).alias("chunk_id"), "embedding")
        plane.build(rows, path)

    held = store.once(spark, "tools-index", texts, index, lambda p: lexstore.LexicalStore(spark, p, {SOURCE})) if words else None
    near = store.once(spark, "tools-plane", [*texts, *vectors], floats, lambda p: plane.Plane(spark, p)) if vectors_ else None
    docs = documents(spark, sf_dir)
    names = [docs.select("source_id", F.col("native_id").alias("row_id"), F.lit(i).alias("col"), simple_tokens(F.col(c)).alias("tokens")) for i, c in enumerate(("title", "headings"))]
    titles = lexical.build_index(reduce(DataFrame.unionByName, names))
    return Engine(docs, chunks(spark, sf_dir), held, titles, near, StoredSeed(near) if near else None, phrases=lambda q: [[t] for t in q.lower().split()], generation=store.fingerprint(spark, *texts, *vectors))


_DOCS = """dd as (select 'lib' as source_id, upper(coalesce(lang, 'xx')) || '/' || doc_id as native_id, upper(coalesce(lang, 'xx')) as type, 'Item ' || doc_id || ' of ' || coalesce(source, 'none') as title,
 case when doc_id % 10 <> 0 then (1990 + doc_id % 30) || '-0' || (1 + doc_id % 9) || '-11' end as date, doc_id % 9 = 0 as withdrawn, doc_id % 13 = 0 as superseded, coalesce(source, 'none') as headings, text, doc_id from documents),
cc as (select source_id, native_id, doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as ord, unnest(string_split(coalesce(text, ''), chr(10))) as text from dd),
ch as (select doc_id * 1048576 + ord as chunk_id, source_id, native_id, doc_id, ord, text from cc)"""
_BOTH = " and ".join(f"tf{i} > 0" for i in range(2))
_WEIGHT = "(case when ln((n - df{0} + 0.5) / (df{0} + 0.5)) <= 0 then 1e-6 else ln((n - df{0} + 0.5) / (df{0} + 0.5)) end) * tf{0} * 2.2 / (tf{0} + 1.2 * (0.25 + 0.75 * len / mean))"
_SCORED = f"""tk as (select chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from ch), tf as (select chunk_id, len(t) as len, len(list_filter(t, lambda x: x = 'the')) as tf0, len(list_filter(t, lambda x: x = 'and')) as tf1 from tk),
st as (select count(*) as n, avg(len) as mean, count(*) filter (tf0 > 0) as df0, count(*) filter (tf1 > 0) as df1 from tf),
sc as (select chunk_id, {_WEIGHT.format(0)} + {_WEIGHT.format(1)} as score from tf, st where {_BOTH}),
pool as (select chunk_id, native_id as document, date, ord = 0 and strlen(ch.text) < 100 as is_intro from ch join dd using (native_id) where {{where}}),
lx as (select chunk_id, score, row_number() over (order by score desc, chunk_id) as rank from sc join pool using (chunk_id) qualify rank <= {{limit}})"""
_NEAR = """em as (select vec_id * 1048576 as chunk_id, list_transform(embedding, lambda x: x::double) as v from embeddings where vec_id in (select doc_id from documents)),
en as (select chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from em), eq as (select chunk_id, list_transform(v, lambda x: case when norm <= 1e-12 then 0 else round(greatest(-1.0, least(1.0, x / norm)) * 127)::int end) as e from en),
ne as (select a.chunk_id, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::int as raw from eq a, (select e from eq where chunk_id = 7340032) b where a.chunk_id in (select chunk_id from pool)),
nr as (select chunk_id, raw / 16129.0 as score, row_number() over (order by raw desc, chunk_id) as rank from ne qualify rank <= {limit})"""
_DIVERSE = """fm as (select f.chunk_id, f.score, p.document, p.date, p.is_intro from {fused} f join pool p using (chunk_id)),
w as (select *, row_number() over (partition by document order by is_intro, score desc, chunk_id) as place from fm), x as (select *, max(score) over (partition by document) as doc_score from w where place <= 3),
y as (select *, row_number() over (order by doc_score desc, document, place) as rank from x where place <= {cap} qualify rank <= {k})"""
_TOLD = "select y.rank, y.chunk_id, y.document as native_id, round(y.score, 9) as score, d.title, d.type, d.date, case when d.withdrawn then true end as withdrawn, case when d.superseded then true end as superseded, 'get_chunks(' || y.chunk_id || ')' as next_call from y join dd d on d.native_id = y.document"
_CURRENT = "not dd.withdrawn and not dd.superseded"


def _hits(found: DataFrame) -> DataFrame:
    return found.select("rank", "chunk_id", "native_id", F.round("score", 9).alias("score"), "title", "type", "date", "withdrawn", "superseded", "next_call")


@query(f"with {_DOCS}, {_SCORED.format(where=_CURRENT, limit=100)}, {_DIVERSE.format(fused='lx', cap=2, k=20)} {_TOLD}")
def tool_search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search: the whole engine, current documents only."""
    return _hits(engine(spark, sf_dir, vectors_=False).search(QUERY, SearchOptions(SOURCE, k=20, mode="keyword", include_snippet=False)))


@query(f"with {_DOCS}, {_SCORED.format(where=_CURRENT, limit=50)}, {_NEAR.format(limit=50)}, rf as (select chunk_id, sum(p) as score from (select chunk_id, 1.0::double / (60 + rank) as p from nr union all select chunk_id, 1.0::double / (60 + rank) from lx) group by chunk_id), {_DIVERSE.format(fused='rf', cap=2, k=10)} {_TOLD}")
def tool_search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: both stages from their stored structures, fused."""
    return _hits(engine(spark, sf_dir).search(QUERY, SearchOptions(SOURCE, k=10, include_snippet=False)))


@query(f"with {_DOCS}, {_SCORED.format(where=f'type in ({chr(39)}EN{chr(39)}) and date >= {chr(39)}1995-01-01{chr(39)} and date <= {chr(39)}2015-12-31{chr(39)}', limit=50)}, {_DIVERSE.format(fused='lx', cap=1, k=50)}, z as (select *, row_number() over (order by date desc nulls last, document, chunk_id) as r from y) {_TOLD.replace('y.rank', 'y.r as rank').replace('from y ', 'from z y ')} where y.r <= 10")
def tool_search_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered by type and dates, withdrawn ones included, newest first, one hit of a document."""
    return _hits(engine(spark, sf_dir, vectors_=False).search(QUERY, SearchOptions(SOURCE, k=10, mode="keyword", types=("EN",), date_from="1995-01-01", date_to="2015-12-31", current_only=False, max_per_doc=1, sort_by="recency", include_snippet=False)))


@query(f"with {_DOCS}, pool as (select chunk_id, native_id as document, date, ord = 0 and strlen(ch.text) < 100 as is_intro from ch join dd using (native_id) where {_CURRENT}), {_NEAR.format(limit=50)}, sx as (select * from nr where chunk_id <> {SEED}), {_DIVERSE.format(fused='sx', cap=2, k=10)} {_TOLD}")
def tool_search_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of a stored chunk, itself left out."""
    return _hits(engine(spark, sf_dir, words=False).search("", SearchOptions(SOURCE, k=10, similar_to=SEED, include_snippet=False)))


@query(f"""with {_DOCS}, tt as (select native_id, title, type, date, regexp_extract_all(lower(title), '[a-z0-9]+') || regexp_extract_all(lower(headings), '[a-z0-9]+') as t from dd), tf as (select *, len(t) as len, len(list_filter(t, lambda x: x = 'item')) as tf0, len(list_filter(t, lambda x: x = '7')) as tf1 from tt),
st as (select count(*) as n, avg(len) as mean, count(*) filter (tf0 > 0) as df0, count(*) filter (tf1 > 0) as df1 from tf), sc as (select native_id, title, type, date, {_WEIGHT.format(0)} + {_WEIGHT.format(1)} as score from tf, st where {_BOTH})
select row_number() over (order by score desc, native_id) as rank, native_id, title, type, date, round(score, 9) as score from sc qualify rank <= 10""")
def tool_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and headings that hold every word of a query."""
    return engine(spark, sf_dir, words=False, vectors_=False).title_hits("item 7", SOURCE).select("rank", "native_id", "title", "type", "date", F.round("score", 9).alias("score"))


_REFS = [11, 3, 40, 12, 5]


@query(f"""with {_DOCS}, a as (select unnest(range(5)) as seq, unnest({_REFS}) as doc), s as (select seq, doc, o as ord, o - 1 as off from a, (select unnest(range(3)) as o)),
f as (select min(seq) as seq, doc, ord from s group by doc, ord), t as (select f.seq, ch.native_id, ch.ord::bigint as ord, ch.chunk_id, ch.text from f join ch on ch.doc_id = f.doc and ch.ord = f.ord) select * from t""")
def tool_get_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second lines of some documents with their neighbours, read in pages of 2,000 characters and put together again."""
    held = chunks(spark, sf_dir)
    lines = held.where(F.col("chunk_id").isin([d * LINES + 1 for d in _REFS])).select("chunk_id").collect()
    there = {r.chunk_id // LINES for r in lines}
    # a document of one line is asked for by its first
    refs = [ChunkRef("g", SOURCE, d * LINES + (1 if d in there else 0)) for d in _REFS]
    pages, cursor = [], None
    while True:
        page, cursor = retrieval.get_chunks(held, refs, 1, 1, 2000, cursor)
        pages.append(page.withColumn("page", F.lit(len(pages))))
        if cursor is None:
            break
    parts = reduce(DataFrame.unionByName, pages)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "")
    return parts.groupBy(F.col("seq").cast("long").alias("seq"), "native_id", "ord", "chunk_id").agg(whole.alias("text"))


@query("select page_id::varchar || '/0' as asset_id, url as caption, 'text/html' as media_type, sha256(html) as sha256, base64(encode(html)) as data from pages where page_id = 5")
def tool_get_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset by its id: caption (its title, for it has no other text), kind and data."""
    p = table(spark, sf_dir, "pages")
    assets = p.select(F.lit(SOURCE).alias("source_id"), F.concat(F.col("page_id").cast("string"), F.lit("/0")).alias("asset_id"), F.lit("EN/1").alias("native_id"), F.lit("text/html").alias("media_type"), F.lit(None).cast("string").alias("alt"), F.col("url").alias("title"), F.sha2("html", 256).alias("sha256"), F.col("html").cast("binary").alias("data"))
    got = retrieval.get_asset(assets, SOURCE, "5/0").drop("native_id")
    return got.withColumn("data", F.regexp_replace("data", "\\s", ""))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document cites the one whose number is a seventh of its own."""
    d = documents(spark, sf_dir).select("native_id", "doc_id")
    to = d.select(F.col("doc_id").alias("to"), F.col("native_id").alias("target_native_id"))
    cited = d.withColumn("to", F.expr("doc_id div 7")).join(to, "to")
    return cited.select((F.col("doc_id") * LINES).alias("source_chunk_id"), F.lit(SOURCE).alias("source_id"), F.col("native_id").alias("source_native_id"), F.lit(SOURCE).alias("target_source_id"), "target_native_id")


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents have recorded links to other documents, none within."""
    d = documents(spark, sf_dir).where("doc_id % 2 = 0").select("native_id", "doc_id")
    to = d.select((F.col("doc_id") - 2).alias("doc_id"), F.col("native_id").alias("target_native_id"))
    return d.join(to, "doc_id").select(F.lit(SOURCE).alias("source_id"), "native_id", F.lit(0).cast("long").alias("ord"), F.lit("sister").alias("kind"), F.lit("next").alias("label"), F.lit(SOURCE).alias("target_source_id"), "target_native_id", F.lit(None).cast("long").alias("target_chunk_id"), F.lit(None).cast("string").alias("target_pit"))


_ASKED = 20


@query(f"""with {_DOCS}, o as (select native_id from dd where doc_id = {_ASKED}), c as (select d.native_id, d.date, row_number() over (order by d.date desc nulls last, d.native_id) as n from dd d where d.doc_id // 7 = {_ASKED} and d.doc_id <> {_ASKED})
select 'in_doc' as kind, 0::bigint as n, 'First {_ASKED}' as label, null as target from o where exists (select 1 from ch where doc_id = {_ASKED} and ord = 0) union all select 'in_doc', 1, 'Second', null from o where exists (select 1 from ch where doc_id = {_ASKED} and ord = 1)
union all select 'related', 0, 'next', d.title from dd d where d.doc_id = {_ASKED + 2} union all select 'cited_by', n - 1, native_id, date from c""")
def tool_doc_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a document: within (from its stored HTML, for none are on record), to others, and from those that cite it."""
    docs = documents(spark, sf_dir)
    asked = docs.where(f"doc_id = {_ASKED}").first().native_id
    row = retrieval.get_doc_anchors(_anchors(spark, sf_dir), docs, _edges(spark, sf_dir), SOURCE, asked, chunks(spark, sf_dir))
    part = lambda kind, c, label, target: row.select(F.lit(kind).alias("kind"), F.posexplode(c).alias("n", "x")).select("kind", F.col("n").cast("long").alias("n"), F.col(f"x.{label}").alias("label"), target.alias("target"))
    none = F.lit(None).cast("string")
    return part("in_doc", "in_doc", "label", none).unionByName(part("related", "related_docs", "label", F.col("x.target_title"))).unionByName(part("cited_by", "cited_by", "native_id", F.col("x.date")))


def _definitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as definitions: a brand is defined by each of its parts, in documents of two kinds."""
    p = table(spark, sf_dir, "part").withColumn("native_id", F.concat(F.when(F.col("p_partkey") % 3 == 0, "EV/").otherwise("PAC/"), F.col("p_size").cast("string")))
    defs = p.select(F.lit(SOURCE).alias("source_id"), F.col("p_partkey").cast("string").alias("definition_id"), F.col("p_brand").alias("term"), definition_term(F.col("p_brand")).alias("norm_term"), "native_id", F.lit("sizes").alias("source_title"), F.substring_index("native_id", "/", 1).alias("source_type"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("anchor"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("body"))
    docs = p.select(F.lit(SOURCE).alias("source_id"), "native_id", F.substring_index("native_id", "/", 1).alias("type")).distinct()
    return defs, docs


@query("""with w as (select min(p_brand) as b from part), p as (select p_partkey, p_brand, p_type, case when p_partkey % 3 = 0 then 'EV/' else 'PAC/' end || p_size as native_id from part, w where p_brand = b),
f as (select * from p where native_id like 'PAC/%' order by native_id, p_partkey limit 100), s as (select *, row_number() over (order by native_id, p_partkey) as seq from f),
o as (select *, row_number() over (partition by native_id, p_type order by seq) as c from s), n as (select *, case when native_id = 'PAC/7' then 0 when native_id like 'PAC/7/%' then 1 else 2 end as near from o where c = 1)
select p_brand as term, native_id, p_type as body, 'statutory' as kind, row_number() over (order by near, seq) as place from n qualify place <= 12""")
def tool_get_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of a term in legislation: those of the asking document first."""
    defs, docs = _definitions(spark, sf_dir)
    term = defs.agg(F.min("term")).first()[0]
    found = retrieval.get_definition(defs, docs, f" *{term}*: ", "PAC/7", max_defs=12)
    rows = [(i + 1, r.term, r.native_id, r.body, r.kind) for i, r in enumerate(found.collect())]
    return spark.createDataFrame(rows, "place long, term string, native_id string, body string, kind string")


@query("select min(c_name) as term, min(c_mktsegment) as body, 'ordinary' as kind from customer where c_custkey = 12")
def tool_ordinary_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term that no legislation defines: what the dictionary says."""
    defs, docs = _definitions(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    words = c.select(definition_term(F.col("c_name")).alias("norm"), F.col("c_name").alias("term"), F.col("c_mktsegment").alias("definition"))
    asked = c.where("c_custkey = 12").first().c_name
    return retrieval.get_definition(defs, docs, asked.upper(), dictionary=words).select("term", "body", "kind")


@query(f"""with {_DOCS}, t as (select type, count(*) as n from dd group by type) select 'documents' as what, '' as name, count(*) as n from dd union all select 'chunks', '', count(*) from ch
union all select 'embeddings', '', count(*) from embeddings where vec_id in (select doc_id from documents) union all select 'definitions', '', 0 union all select 'type', type, n from t union all select 'prefix', type, n from t""")
def tool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the source: tables, types and prefixes."""
    docs, held = documents(spark, sf_dir), chunks(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * LINES).alias("chunk_id"))
    row = retrieval.stats(docs, held, spark.createDataFrame([], "source_id string"), vectors)
    counts = reduce(DataFrame.unionByName, [row.select(F.lit(c).alias("what"), F.lit("").alias("name"), F.col(c).alias("n")) for c in ("documents", "chunks", "embeddings", "definitions")])
    kinds = row.select(F.lit("type").alias("what"), F.explode("documents_by_type").alias("x")).select("what", F.col("x.type").alias("name"), F.col("x.n").alias("n"))
    prefixes = row.select(F.lit("prefix").alias("what"), F.explode("prefixes").alias("x")).select("what", F.col("x.prefix").alias("name"), F.col("x.n").alias("n"))
    return counts.unionByName(kinds).unionByName(prefixes)


@query("select page_id, html from pages where page_id = 9")
def tool_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a canonical URI, among pages under their official addresses."""
    pages = table(spark, sf_dir, "pages").withColumn("url", F.concat(F.lit(retrieval.official_url("P/")), F.col("page_id").cast("string"), F.lit("&PiT=20200101")))
    return retrieval.fetch(pages, str(DocUri("ato", "P/9", "20200101"))).select("page_id", "html")
