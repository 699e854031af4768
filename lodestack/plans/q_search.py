"""Search queries: keyword, vector, hybrid, filters and ranking, over the generic tables.

``documents`` stands in for chunks (doc_id as chunk, source as source),
``embeddings`` for chunk vectors (label as document), ``orders`` for dated
documents and ``part`` for titles with headings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.snippet import snippet_col
from lodestack.functions.text import simple_tokens
from lodestack.operators import filters, lexical, lexstore, plane, ranking, stored, vector
from lodestack.plans import store
from lodestack.plans.registry import query, table

TERMS = ["the", "and"]
PHRASE = ["of", "the"]
K = 50

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_BM25 = """
hit as (select *, {tf} from t),
stats as (select count(*) as n, avg(len) as mean, {df} from hit),
scored as (select hit.*, {score} as score from hit, stats where {all})
"""


def _oracle_bm25(terms: list[str], source: str, ident: str = "doc_id") -> str:
    """WITH parts that score rows t(ident, toks, len)."""
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(terms)))
    weigh = lambda i: f"case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 then 1e-6 else ln((n - df{i} + 0.5) / (df{i} + 0.5)) end"
    score = " + ".join(f"({weigh(i)}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms)))
    return source + ", " + _BM25.format(tf=tf, df=df, score=score, all=" and ".join(f"tf{i} > 0" for i in range(len(terms))))


_TEXT = "coalesce(text, '')"
_DOC_TOKENS = f"with t as (select doc_id, {_TOKENS.format(_TEXT)} as toks, len({_TOKENS.format(_TEXT)}) as len from documents)"
#: The whole table is one source here.
SOURCE = "documents"
#: Folders of terms in a source; each is at least one small file.
BUCKETS = 64


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", simple_tokens(F.coalesce("text", F.lit(""))).alias("toks"))


def _index_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select(F.lit(SOURCE).alias("source_id"), F.col("doc_id").alias("row_id"), F.lit(0).alias("col"), F.col("toks").alias("tokens"))


def text_index(spark: SparkSession, sf_dir: str) -> lexstore.LexicalStore:
    """The stored index of all documents: built by the first query that asks for it."""
    return store.once(spark, "text", [f"{sf_dir}/documents.parquet"], lambda p: lexstore.build(_index_input(spark, sf_dir), p, buckets=BUCKETS), lambda p: lexstore.LexicalStore(spark, p, {SOURCE}))


@query(_oracle_bm25(TERMS, _DOC_TOKENS) + f", best as (select doc_id, round(score, 9) as score, row_number() over (order by score desc, doc_id) as rank from scored) select * from best where rank <= {K}")
def bm25_strict_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hold every term, by BM25 over the whole source."""
    scored = lexical.scan_bm25(_tokens(spark, sf_dir).drop("text"), F.col("toks"), TERMS)
    return lexical.top(scored, K, "doc_id").select("doc_id", F.round("score", 9).alias("score"), "rank")


@query(_oracle_bm25(TERMS, _DOC_TOKENS) + f", best as (select doc_id, round(score, 9) as score, row_number() over (order by score desc, doc_id) as rank from scored) select * from best where rank <= {K}")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the stored index: the terms' blocks only."""
    best = text_index(spark, sf_dir).search(SOURCE, [[x] for x in TERMS], K)
    return best.select(F.col("row_id").alias("doc_id"), F.round("score", 9).alias("score"), "rank")


@query(f"with t as (select doc_id, unnest({_TOKENS.format(_TEXT)}) as term from documents) select term, count(distinct doc_id) as df, count(*) as occurrences from t group by term")
def lexical_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds the index anew each time and reads back its whole vocabulary with the occurrences that the postings hold."""
    path = f"{stored.shared_folder(spark)}/text-{uuid.uuid4().hex}"
    lexstore.build(_index_input(spark, sf_dir), path, buckets=BUCKETS)
    found = lexstore.LexicalStore(spark, path, {SOURCE})
    held = found.postings.groupBy("term").agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)).alias("occurrences"))
    return found.terms.select("term", "df").join(held, "term").select("term", "df", "occurrences")


_PHRASE_SQL = f"""
with t as (select doc_id, {_TOKENS.format(_TEXT)} as toks from documents),
c as (select doc_id, len(toks) as len, len(list_filter(range(1, len(toks)), lambda i: toks[i] = '{PHRASE[0]}' and toks[i + 1] = '{PHRASE[1]}')) as tf from t),
s as (select count(*) as n, avg(len) as mean, count(*) filter (tf > 0) as df from c),
sc as (select doc_id, tf, (case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) as score from c, s where tf > 0),
b as (select doc_id, tf::bigint as tf, round(score, 9) as score, row_number() over (order by score desc, doc_id) as rank from sc)
select * from b where rank <= {K}"""


@query(_PHRASE_SQL)
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hyphenated term is a phrase: its words one after another, by the places that the stored index keeps."""
    index = text_index(spark, sf_dir)
    best = index.search(SOURCE, [PHRASE], K)
    tf = lexical.phrase_hits(index.positional(SOURCE, PHRASE), PHRASE).select(F.col("row_id").alias("row_no"), "tf")
    numbers = index.rows.where(F.col("source_id") == SOURCE).select("row_no", "row_id").join(F.broadcast(best), "row_id")
    return tf.join(F.broadcast(numbers), "row_no").select(F.col("row_id").alias("doc_id"), "tf", F.round("score", 9).alias("score"), "rank")


@query()
def bm25_porter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search with the full index tokeniser: marks folded, Porter stems."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("row_id"), F.lit(0).alias("col"), "text")
    # tokenised once; the plan reads the tokens for statistics, lengths and hits
    postings, rows = lexical.build_index(stored.scratch(lexical.tokenised(docs, "text"), "tokens"))
    scored = lexical.bm25(postings, rows, lexical.query_phrases("tion ing the"))
    return lexical.top(scored, K, "row_id").select("source_id", F.col("row_id").alias("doc_id"), F.round("score", 9).alias("score"), "rank")


_TITLE_TOKENS = f"with t as (select p_partkey, {_TOKENS.format('p_name')} || {_TOKENS.format('p_type')} as toks, len({_TOKENS.format('p_name')}) + len({_TOKENS.format('p_type')}) as len from part)"


@query(
    "with w as (select min(tok) as tok from (select unnest(" + _TOKENS.format("p_type") + ") as tok from part where p_partkey = 1)), "
    + _TITLE_TOKENS.removeprefix("with ")
    + """, h as (select p_partkey, any_value(len) as len, count(*) filter (tok = (select tok from w)) as tf from (select p_partkey, len, unnest(toks) as tok from t) group by p_partkey),
    s as (select count(*) as n, avg(len) as mean, count(*) filter (tf > 0) as df from h),
    sc as (select p_partkey, (case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) as score from h, s where tf > 0),
    b as (select p_partkey, round(score, 9) as score, row_number() over (order by score desc, p_partkey) as rank from sc) select * from b where rank <= 10"""
)
def title_bm25_two_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title search: terms may match in title or headings, length counts both."""
    part = table(spark, sf_dir, "part")
    first = part.where("p_partkey = 1").select(F.array_min(simple_tokens(F.col("p_type"))).alias("tok")).first().tok
    cols = [part.select(F.lit("part").alias("source_id"), F.col("p_partkey").alias("row_id"), F.lit(i).alias("col"), simple_tokens(F.col(c)).alias("tokens")) for i, c in enumerate(("p_name", "p_type"))]
    postings, rows = lexical.build_index(cols[0].unionByName(cols[1]))
    return lexical.top(lexical.bm25(postings, rows, [[first]]), 10, "row_id").select(F.col("row_id").alias("p_partkey"), F.round("score", 9).alias("score"), "rank")


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as dated documents of one policy source."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "PAC").when(F.col("o_orderpriority").startswith("2"), "EV").otherwise("TXR")
    return o.select(
        F.lit("ato").alias("source_id"),
        F.concat(kind, F.lit("/"), F.col("o_orderkey").cast("string")).alias("native_id"),
        kind.alias("type"),
        F.when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.lit("2026-01-01")).alias("withdrawn_date"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("TXR/1")).alias("superseded_by"),
        F.col("o_orderkey").alias("chunk_id"),
    )


_POLICY = """with d as (select 'ato' as source_id, (case when o_orderpriority like '1%' then 'PAC' when o_orderpriority like '2%' then 'EV' else 'TXR' end) as type, o_orderkey as chunk_id,
 case when o_orderkey % 11 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as date, case when o_orderstatus = 'F' then '2026-01-01' end as withdrawn_date, case when o_orderkey % 7 = 0 then 'TXR/1' end as superseded_by from orders),
 e as (select *, type || '/' || chunk_id as native_id from d) select chunk_id, native_id, type, date from e where """
_OLD = "(date is null or date >= '2000-01-01' or type in ('PAC', 'REG', 'RPC', 'RRG'))"
_CURRENT = "withdrawn_date is null and superseded_by is null"


def _policy(spark: SparkSession, sf_dir: str, **spec: object) -> DataFrame:
    docs = policy_documents(spark, sf_dir)
    return docs.where(filters.document_filter(filters.FilterSpec("ato", **spec))).select("chunk_id", "native_id", "type", "date")


@query(_POLICY + f"type not in ('EV') and {_OLD} and {_CURRENT}")
def filter_policy_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir)


@query(_POLICY + f"type in ('EV') and {_OLD} and {_CURRENT}")
def filter_policy_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, types=("EV",))


@query(_POLICY + f"(type in ('EV') or lower(type) like 't%') and {_CURRENT}")
def filter_policy_type_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, types=("EV", "t*"), include_old=True)


@query(_POLICY + f"type not in ('EV') and date >= '1995-06-01' and date <= '2001-12-31' and {_OLD}")
def filter_policy_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, date_from="1995-06-01", date_to="2001-12-31", current_only=False)


@query(_POLICY + f"type not in ('EV') and lower(native_id) like 'txr/1%' and {_CURRENT}")
def filter_policy_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, scope="txr/1*", include_old=True)


@query("with d as (select case when o_orderpriority like '1%' then 'PAC' when o_orderpriority like '2%' then 'EV' else 'TXR' end as type from orders) select t.type from (values ('PAC'), ('XYZ'), ('EV'), ('QQQ')) as t(type) where t.type not in (select type from d)")
def unknown_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that a request names and the source lacks."""
    bad = filters.unknown_types(policy_documents(spark, sf_dir), "ato", ["PAC", "XYZ", "EV", "QQQ", "any*"])
    return spark.createDataFrame([(t,) for t in bad], "type string")


def _floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("embeddings").alias("source_id"), F.col("vec_id").alias("chunk_id"), F.col("label").alias("document"), "embedding")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _floats(spark, sf_dir).select("chunk_id", "document", vector.quantized(F.col("embedding")).alias("embedding"))


def vector_plane(spark: SparkSession, sf_dir: str) -> plane.Plane:
    """The stored plane of all vectors: built by the first query that asks for it."""
    return store.once(spark, "plane", [f"{sf_dir}/embeddings.parquet"], lambda p: plane.build(_floats(spark, sf_dir).drop("document"), p), lambda p: plane.Plane(spark, p))


_Q = """with n as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
m as (select vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from n),
q as (select vec_id as chunk_id, label as document, list_transform(v, lambda x: case when norm <= 1e-12 then 0 else round(greatest(-1.0, least(1.0, x / norm)) * 127)::int end) as e from m)"""


@query(_Q + " select chunk_id, e[1] as e1, e[64] as e64, list_sum(e)::bigint as total, list_sum(list_transform(e, lambda x: x * x))::bigint as squares from q")
def quantize_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors as signed bytes."""
    e = F.col("embedding")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return _vectors(spark, sf_dir).select("chunk_id", e[0].cast("int").alias("e1"), e[63].cast("int").alias("e64"), total(e).alias("total"), total(F.transform(e, lambda x: x.cast("int") * x.cast("int"))).alias("squares"))


_DOT = "list_sum(list_transform(list_zip({}, {}), lambda p: p[1] * p[2]))::int"
_TOP = _Q + f", s as (select a.chunk_id, a.document, {_DOT.format('a.e', 'b.e')} as raw from q a, (select e from q where chunk_id = 7) b)"


@query(_TOP + ", r as (select chunk_id, raw, row_number() over (order by raw desc, chunk_id) as rank from s) select chunk_id, raw, round(raw / 16129.0, 9) as score, rank from r where rank <= 50")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors by integer inner product, from the stored plane."""
    held = vector_plane(spark, sf_dir)
    return held.nearest("embeddings", held.vector("embeddings", 7), 50).select("chunk_id", "raw", F.round("score", 9).alias("score"), "rank")


@query(_TOP + ", r as (select chunk_id, raw, row_number() over (order by raw desc, chunk_id) as rank from s where document % 2 = 0) select chunk_id, raw, rank from r where rank <= 50")
def vector_topk_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among eligible rows only: bitmaps of the blocks of the stored plane."""
    held = vector_plane(spark, sf_dir)
    eligible = table(spark, sf_dir, "embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("chunk_id"))
    return held.nearest("embeddings", held.vector("embeddings", 7), 50, eligible).select("chunk_id", "raw", "rank")


@query(_TOP + ", r as (select chunk_id, raw, row_number() over (order by raw desc, chunk_id) as rank from s) select chunk_id, raw, rank from r where rank <= 50")
def vector_topk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a plane: vectors are quantised and multiplied in whole-stage generated code."""
    v = _vectors(spark, sf_dir)
    seed = list(v.where("chunk_id = 7").first().embedding)
    return vector.nearest(v, seed, 50, numpy=False).select("chunk_id", "raw", "rank")


@query(_TOP + ", r as (select chunk_id, raw, row_number() over (order by raw desc, chunk_id) as rank from s where chunk_id between 100 and 299) select chunk_id, raw, rank from r where rank <= 20")
def vector_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope that is one document: a range of chunk ids, so blocks outside it are not read."""
    held = vector_plane(spark, sf_dir)
    return held.nearest("embeddings", held.vector("embeddings", 7), 20, between=(100, 299)).select("chunk_id", "raw", "rank")


@query("select 'embeddings' as source_id, count(*) as n, min(vec_id) as first_id, max(vec_id) as last_id, any_value(len(embedding)) as dim, 0::bigint as faults from embeddings")
def plane_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored plane against the vectors of the table: bounds, and blocks that differ (none)."""
    held = vector_plane(spark, sf_dir)
    faults = held.binding_faults(_floats(spark, sf_dir)).groupBy("source_id").agg(F.count("*").alias("faults"))
    told = spark.read.parquet(f"{held.path}/sources")
    return told.join(faults, "source_id", "left").select("source_id", "n", "first_id", "last_id", "dim", F.coalesce("faults", F.lit(0)).alias("faults"))


@query(_TOP + ", r as (select chunk_id, raw, row_number() over (order by raw desc, chunk_id) as rank from s) select chunk_id, raw, rank from r where rank <= 20 and chunk_id <> 7")
def similar_to_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.similar_to(_vectors(spark, sf_dir), 7, 20).select("chunk_id", "raw", "rank")


_RRF = """, l as (select doc_id as chunk_id, row_number() over (order by score desc, doc_id) as rank from scored),
f as (select chunk_id, sum(part) as score from (select chunk_id, 1.0::double / (60 + rank) as part from r where rank <= 50 union all select chunk_id, 1.0::double / (60 + rank) from l where rank <= 50) group by chunk_id)"""
_HYBRID = _oracle_bm25(TERMS, _TOP.replace("with n as", _DOC_TOKENS + ", n as") + ", r as (select chunk_id, raw, row_number() over (order by raw desc, chunk_id) as rank from s)") + _RRF


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held, limit = vector_plane(spark, sf_dir), ranking.frontier(10)
    near = held.nearest("embeddings", held.vector("embeddings", 7), limit).select("chunk_id", "rank")
    words = text_index(spark, sf_dir).search(SOURCE, [[x] for x in TERMS], limit)
    return near, words.select(F.col("row_id").alias("chunk_id"), "rank")


@query(_HYBRID + " select chunk_id, round(score, 12) as score, row_number() over (order by round(score, 12) desc, chunk_id) as rank from f")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the vector and the keyword list."""
    fused = ranking.rrf(*_two_lists(spark, sf_dir)).withColumn("score", F.round("score", 12))
    return ranking.ranked(fused, "chunk_id")


_DIVERSE = """, w as (select *, row_number() over (partition by document order by is_intro, score desc, chunk_id) as place from {}),
x as (select *, max(score) over (partition by document) as doc_score from w where place <= 3),
y as (select chunk_id, document, row_number() over (order by doc_score desc, document, place) as rank from x where place <= {})
select chunk_id, document, rank from y where rank <= {}"""
_META = ", g as (select f.chunk_id, round(f.score, 12) as score, d.source as document, (length(d.text) < 400) as is_intro from f join documents d on d.doc_id = f.chunk_id)"


@query(_HYBRID + _META + _DIVERSE.format("g", 2, 10))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole hybrid search: two lists, fusion, metadata of the candidates only, diversity, cut."""
    fused = ranking.rrf(*_two_lists(spark, sf_dir)).withColumn("score", F.round("score", 12))
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document"), (F.length("text") < 400).alias("is_intro"))
    # the table has vectors without a document, which are no candidates here; the engine, whose pool is checked, calls this an error
    known = meta.select("chunk_id").join(F.broadcast(fused.select("chunk_id")), "chunk_id")
    found = ranking.with_metadata(fused.join(known, "chunk_id", "left_semi"), meta)
    return ranking.diverse(found, 10).select("chunk_id", "document", "rank")


@query(_TOP + ", g as (select chunk_id, document, raw as score, chunk_id % 5 = 0 as is_intro from s)" + _DIVERSE.format("g", 3, 20))
def diversity_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    seed = list(v.where("chunk_id = 7").first().embedding)
    scored = v.select("chunk_id", "document", vector.dot(F.col("embedding"), F.array(*[F.lit(int(x)) for x in seed])).alias("score"), (F.col("chunk_id") % 5 == 0).alias("is_intro"))
    return ranking.diverse(scored, 20, 3).select("chunk_id", "document", "rank")


@query("with e as (select event_id, user_id, case when event_id % 4 <> 0 then strftime(ts, '%Y-%m-%d') end as date from events), r as (select event_id, user_id, date, row_number() over (order by date desc nulls last, user_id, event_id) as rank from e) select * from r where rank <= 50")
def recency_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first, undated last."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"))
    return ranking.by_recency(e, 50, doc="user_id", ident="event_id")


def is_intro(ord_: Column, text: Column) -> Column:
    """A short first chunk."""
    return (ord_ == 0) & (F.octet_length(text) < 100)


@query("select conv_id, turn, (turn = 0 and strlen(text) < 100) as is_intro from conversations")
def intro_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", is_intro(F.col("turn"), F.col("text")).alias("is_intro"))


@query()
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best window of each document for a query, for the winners only."""
    best = text_index(spark, sf_dir).search(SOURCE, [[x] for x in TERMS], 10).withColumnRenamed("row_id", "doc_id")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(best), "doc_id")
    return texts.select("doc_id", "rank", snippet_col(F.col("text"), " ".join(TERMS)).alias("snippet"))


@query("with r as (select o_orderkey, o_custkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as rank from orders) select r.rank, r.o_orderkey, c.c_name, round(r.o_totalprice, 2) as price from r join customer c on c.c_custkey = r.o_custkey where r.rank <= 20")
def late_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank narrow rows, then join the winners' wide columns."""
    best = lexical.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 20, "o_orderkey", score="o_totalprice")
    wide = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return wide.join(F.broadcast(best), "o_custkey").select("rank", "o_orderkey", "c_name", F.round("o_totalprice", 2).alias("price"))


@query("select chunk_id, case when is_intro then true end as is_intro, 'get_chunks(' || chunk_id || ')' as next_call from (select doc_id as chunk_id, length(text) < 400 as is_intro from documents)")
def hit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits carry a flag only where it holds; rendered as JSON without nulls and read back."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), (F.length("text") < 400).alias("is_intro"))
    row = F.struct("chunk_id", F.when(F.col("is_intro"), True).alias("is_intro"), F.concat(F.lit("get_chunks("), F.col("chunk_id"), F.lit(")")).alias("next_call"))
    text = d.select(F.to_json(row, {"ignoreNullFields": "true"}).alias("hit"))
    return text.select(F.from_json("hit", "chunk_id long, is_intro boolean, next_call string").alias("h")).select("h.*")

