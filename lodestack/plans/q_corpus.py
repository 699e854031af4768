"""Queries on statistics, retrieval, links and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack import schema
from lodestack.functions import text as T
from lodestack.operators import corpus
from lodestack.plans.registry import query, table


@query("select source, lang, count(*) as n, sum(n_chars)::bigint as chars, min(doc_id) as first_id, max(doc_id) as last_id from documents group by source, lang")
def stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("select p_brand as type, count(*) as n, row_number() over (order by count(*) desc, p_brand) as rank from part group by p_brand")
def documents_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = corpus.counts_by(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "type"), "type")
    return grouped.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "type")))


_PAGES = "with p as (select page_id, url, regexp_extract(url, '^https?://[^/]+/(.*)$', 1) as path from pages), q as (select *, upper(string_split(path, '/')[1]) as prefix from p)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1).alias("path"))


@query(_PAGES + " select prefix, count(*) as n, min_by(url, path || '/#' || page_id) as first_title from q group by prefix")
def prefix_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix, documents and title of the first one."""
    p = _paths(spark, sf_dir).withColumn("ident", F.concat("path", F.lit("/#"), F.col("page_id").cast("string")))
    return corpus.prefix_breakdown(p, "ident", "url")


@query("""with t as (select p_partkey, upper(string_split(p_type, ' ')[1]) as prefix, p_type || ' — ' || p_name as title, p_type as ident from part),
w as (select *, count(*) over (partition by prefix) as n, row_number() over (partition by prefix order by case when title like prefix || ' %' then 1 else 0 end, ident, p_partkey) as rn from t)
select prefix, n, string_split(title, ' — ')[1] as description from w where rn = 1""")
def prefix_breakdown_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COUNT and ROW_NUMBER over the prefix, composed titles preferred."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.substring_index("p_type", " ", 1)).alias("prefix"), F.concat("p_type", F.lit(" — "), "p_name").alias("title"), F.col("p_type").alias("ident"))
    w = Window.partitionBy("prefix")
    plain = F.when(F.col("title").startswith(F.concat("prefix", F.lit(" "))), 1).otherwise(0)
    placed = t.withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(plain, "ident", "p_partkey")))
    return placed.where("rn = 1").select("prefix", "n", T.description_of(F.col("title")).alias("description"))


@query("select o_orderkey, min(l_linenumber) as first_chunk_id, max(l_linenumber) as last_chunk_id, count(l_linenumber) as n_chunks, coalesce(max(l_linenumber) - min(l_linenumber) + 1 = count(l_linenumber), true) as contiguous from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents LEFT JOIN the bounds of their chunks, with the contiguity check."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return corpus.chunk_bounds(o, chunks, ["o_orderkey"], "l_linenumber")


_HREFS = r"""with e as (select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


@query(_HREFS + " select distinct page_id, target from e where target <> url")
def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of each page, without those to itself."""
    return _links(spark, sf_dir).where("target <> url").select("page_id", "target").distinct()


@query(r"""with m as (select doc_id, unnest(regexp_extract_all('[doc:' || source || ':' || (doc_id % 17) || ' @x] and [doc:' || source || ':' || (doc_id % 5) || ']', '\[doc:([^\s\]@]+)', 1)) as target, source || ':' || doc_id as own from documents)
select distinct doc_id, target from m where target <> own""")
def derive_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed markers in a text become edges: distinct in a chunk, none to its own document."""
    d = table(spark, sf_dir, "documents")
    marked = F.concat(F.lit("[doc:"), "source", F.lit(":"), (F.col("doc_id") % 17).cast("string"), F.lit(" @x] and [doc:"), "source", F.lit(":"), (F.col("doc_id") % 5).cast("string"), F.lit("]"))
    own = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    found = d.select("doc_id", own.alias("own"), F.explode(F.regexp_extract_all(marked, F.lit(r"\[doc:([^\s\]@]+)"), F.lit(1))).alias("target"))
    return found.where("target <> own").select("doc_id", "target").distinct()


@query("""with c as (select distinct l_partkey as target, l_orderkey as citer from lineitem), j as (select c.target, c.citer, case when o.o_orderkey % 13 <> 0 then strftime(o.o_orderdate, '%Y-%m-%d') end as date from c join orders o on o.o_orderkey = c.citer),
r as (select *, count(*) over (partition by target) as total, row_number() over (partition by target order by date desc nulls last, citer) as rank from j) select target, citer, total, rank from r where rank <= 5""")
def cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse citations: distinct citers, newest first, a limit and the total."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("target"), F.lit("o").alias("source_id"), F.col("l_orderkey").alias("native_id"))
    docs = table(spark, sf_dir, "orders").select(F.lit("o").alias("source_id"), F.col("o_orderkey").alias("native_id"), F.when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return corpus.cited_by(edges, docs, 5).select("target", F.col("native_id").alias("citer"), "total", "rank")


@query("select l_partkey, count(distinct l_orderkey) as citers from lineitem group by l_partkey")
def distinct_citers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("citers"))


@query("""with r as (select conv_id, turn, row_number() over (order by conv_id, turn) as seq from conversations where turn = 2),
s as (select r.conv_id, r.seq, r.turn as center, unnest(range(greatest(r.turn - 1, 0), r.turn + 2)) as turn from r), f as (select conv_id, turn, min(seq) as seq from s group by conv_id, turn)
select c.conv_id, c.turn, f.seq, c.role, length(c.text) as chars from f join conversations c on c.conv_id = f.conv_id and c.turn = f.turn""")
def neighbor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested chunks with their neighbours: a range by ordinal within the document."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("turn = 2").select("conv_id", "turn", F.row_number().over(Window.orderBy("conv_id", "turn")).alias("seq"))
    rows = c.select("conv_id", "turn", "role", F.length("text").alias("chars"))
    return corpus.neighbours(asked, rows, 1, 1, "conv_id", "turn").select("conv_id", "turn", "seq", "role", "chars")


@query("""with w as (select conv_id, turn, length(text) as length, sum(length(text)) over (partition by conv_id order by turn) - length(text) as start from conversations),
t as (select *, greatest(0, least(length, 1000 - start)) as take from w) select conv_id, turn, start::bigint as start, take::bigint as take, (case when take < length then take end)::bigint as resume from t where take > 0 or (length = 0 and start <= 1000)""")
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running budget of characters over ordered chunks, with the offset to resume at."""
    c = table(spark, sf_dir, "conversations")
    return corpus.budgeted(c, "text", ["turn"], 1000, by=["conv_id"]).select("conv_id", "turn", "start", "take", "resume")


@query("select l.l_orderkey, l.l_linenumber, p.p_name, case when p.p_partkey is null then 'fetch' else 'doc' end as kind from lineitem l left join (select * from part where p_partkey % 3 <> 0) p on p.p_partkey = l.l_partkey")
def anchor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors LEFT JOIN their targets; a target outside the corpus becomes a fetch."""
    anchors = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    targets = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select("p_partkey", "p_name", F.lit(True).alias("known"))
    return anchors.join(targets, "p_partkey", "left").select("l_orderkey", "l_linenumber", "p_name", F.when(F.col("known").isNull(), "fetch").otherwise("doc").alias("kind"))


@query("""with a as (select distinct doc_id, 'anchor' || (doc_id % 4) as name from documents), c as (select conv_id as doc_id, turn, case when turn % 2 = 0 then 'anchor' || (turn % 4) end as anchor, text || case when turn = 1 then ' [anchor:anchor3]' else '' end as text from conversations)
select a.doc_id, a.name, min(c.turn) as first_ord from a join c on c.doc_id = a.doc_id and (c.anchor = a.name or contains(c.text, '[anchor:' || a.name || ']')) group by a.doc_id, a.name""")
def anchor_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First chunk of the document that is the anchor or holds its marker."""
    a = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("anchor"), (F.col("doc_id") % 4).cast("string")).alias("name")).distinct()
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("anchor"), (F.col("turn") % 4).cast("string"))).alias("anchor"), F.concat("text", F.when(F.col("turn") == 1, F.lit(" [anchor:anchor3]")).otherwise(F.lit(""))).alias("text"))
    hit = (F.col("anchor") == F.col("name")) | F.contains("text", F.concat(F.lit("[anchor:"), "name", F.lit("]")))
    return a.join(c, "doc_id").where(hit).groupBy("doc_id", "name").agg(F.min("turn").alias("first_ord"))


@query("""with d as (select p_partkey, lower(p_brand) as norm_term, p_type || '/' || p_partkey as native_id, p_size as ord, p_brand as term, p_name as body from part where lower(p_brand) = (select lower(min(p_brand)) from part)),
f as (select *, row_number() over (order by native_id, ord, term) as seq from d qualify seq <= 100), u as (select *, row_number() over (partition by native_id, body order by seq) as copy from f)
select native_id, ord, term, body from (select *, row_number() over (order by seq) as r from u where copy = 1) where r <= 5""")
def definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of a term: bounded, deduplicated by document and body, ranked."""
    p = table(spark, sf_dir, "part").withColumn("source_id", F.lit("part")).withColumn("native_id", F.concat_ws("/", "p_type", F.col("p_partkey").cast("string")))
    term = p.agg(F.lower(F.min("p_brand")).alias("t")).first().t
    defs = p.select("source_id", "native_id", F.lower("p_brand").alias("norm_term"), F.col("p_size").alias("ord"), F.col("p_brand").alias("term"), F.col("p_name").alias("body"))
    docs = p.select("source_id", "native_id", F.lit("PAC").alias("type"))
    return corpus.definitions(defs, docs, term, None).select("native_id", "ord", "term", "body")


@query("""with d as (select n_name as native_id, n_regionkey as g, n_nationkey from nation), x as (select g, native_id, row_number() over (partition by g order by n_nationkey) as r from d) select g, native_id from x where r <= 3""")
def dictionary_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most so many meanings of each dictionary entry."""
    n = table(spark, sf_dir, "nation")
    placed = n.withColumn("r", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    return placed.where("r <= 3").select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("native_id"))


@query("""with recursive n as (select 'r' || r_regionkey as id, null as parent, 0 as weight from region union all select 'n' || n_nationkey, 'r' || n_regionkey, 0 from nation union all select 's' || s_suppkey, 'n' || s_nationkey, case when s_suppkey % 3 = 0 then 1 else 0 end from supplier),
t as (select id as ancestor, id as node from n union all select t.ancestor, n.id from t join n on n.parent = t.node)
select t.ancestor as folder, bool_or(n.weight = 1) as owns, not bool_or(n.weight = 1) as redundant from t join n on n.id = t.node where t.ancestor not like 's%' group by t.ancestor""")
def redundant_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder is redundant if neither it nor any descendant owns a document."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("weight"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(0))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0))
    nodes = r.union(n).union(s)
    below = corpus.descendants(nodes, "id", "parent").join(nodes.select(F.col("id").alias("node"), "weight"), "node")
    return below.where("ancestor not like 's%'").groupBy(F.col("ancestor").alias("folder")).agg(F.bool_or(F.col("weight") == 1).alias("owns")).withColumn("redundant", ~F.col("owns"))


@query("""with p as (select page_id, regexp_replace(url, '[?#].*$', '') as canonical, string_split(url, '/') as path from pages), b as (select canonical, count(*) as occurrences, count(distinct path) as folders, min(len(path)) as shortest from p group by canonical)
select p.canonical, b.occurrences, b.folders, min(array_to_string(p.path, '/')) as best_path from p join b using (canonical) where len(p.path) = b.shortest group by p.canonical, b.occurrences, b.folders""")
def dedup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per canonical link: occurrences, distinct folders, best path (shortest, then first)."""
    p = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("canonical"), F.split("url", "/", -1).alias("path"))
    best = F.min(F.struct(F.size("path").alias("n"), F.array_join("path", "/").alias("path")))
    return p.groupBy("canonical").agg(F.count("*").alias("occurrences"), F.countDistinct("path").alias("folders"), best.alias("best")).select("canonical", "occurrences", "folders", F.col("best.path").alias("best_path"))


@query("select coalesce(nullif(trim(lang), ''), '(untitled)') as title, count(*) as n, coalesce(lang, '') in ('de', 'fr') as excluded from documents group by 1, 3")
def excluded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("(untitled)")).alias("title")
    return table(spark, sf_dir, "documents").groupBy(title, F.coalesce(F.col("lang").isin("de", "fr"), F.lit(False)).alias("excluded")).agg(F.count("*").alias("n"))


@query("select p_type as category, count(*) as n, row_number() over (order by count(*) desc, p_type) as rank from part group by p_type qualify rank <= 10")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "category").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "category")))


@query("select 'lineitem' as child, count(*) as orphans from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 100 <> 7) union all select 'orders', count(*) from orders where o_custkey not in (select c_custkey from customer)")
def fk_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that refer to nothing, by anti-join."""
    o, li, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    one = schema.orphans(li, ["l_orderkey"], o.where("o_orderkey % 100 <> 7"), ["o_orderkey"]).agg(F.count("*").alias("orphans")).select(F.lit("lineitem").alias("child"), "orphans")
    return one.union(schema.orphans(o, ["o_custkey"], c, ["c_custkey"]).agg(F.count("*")).select(F.lit("orders"), "count(1)"))


@query("with b as (select p_partkey, p_name, case when p_partkey % 10 = 0 then p_size + 1 else p_size end as p_size from part where p_partkey % 7 <> 0) select coalesce(a.p_partkey, b.p_partkey) as p_partkey, case when a.p_partkey is null then 'only_right' when b.p_partkey is null then 'only_left' else 'differs' end as verdict from part a full join b on a.p_partkey = b.p_partkey where a.p_partkey is null or b.p_partkey is null or a.p_size is distinct from b.p_size or a.p_name is distinct from b.p_name")
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of a table compared row for row."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    other = p.where("p_partkey % 7 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return corpus.full_outer_compare(p, other, ["p_partkey"], ["p_name", "p_size"])


@query("""with r as (select source, hash_field.h from (select source, sha256(length(doc_id::varchar) || ':' || doc_id || '|' || length(lang) || ':' || lang || '|' || length(n_chars::varchar) || ':' || n_chars) as h from documents) as hash_field)
select source, count(*) as n, (sum(('0x' || substr(h, 1, 15))::bigint::hugeint) % 2305843009213693951)::bigint as digest from r group by source""")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free digest of a table's logical rows."""
    return corpus.table_digest(table(spark, sf_dir, "documents"), ["doc_id", "lang", "n_chars"], ["source"])


@query("select source, count(*) as documents, count(e.vec_id) as embedded, count(*) = count(e.vec_id) as complete from documents d left join embeddings e on e.vec_id = d.doc_id group by source")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    return d.join(e, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.count("has").alias("embedded")).withColumn("complete", F.col("documents") == F.col("embedded"))


@query("select p.page_id, p.url, (regexp_matches(p.url, '^https://[A-Za-z0-9.-]+(/[^\\s]*)?$')) as allowed, lower(regexp_extract(p.url, '^https?://([A-Za-z0-9.-]+)', 1)) as host from pages p")
def url_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", schema.is_https(F.col("url")).alias("allowed"), F.lower(F.regexp_extract("url", "^https?://([A-Za-z0-9.-]+)", 1)).alias("host"))


@query("""select doc_id, list_filter([case when not coalesce(length(text) >= 200, false) then 'short' end, case when not coalesce(lang in ('en', 'de', 'fr'), false) then 'language' end, case when not coalesce(not regexp_matches(text, '[A-Z]{3,}!!'), false) then 'shouting' end], lambda x: x is not null) as faults from documents""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the names of the rules it breaks; rows with one are quarantined."""
    rules = {"short": F.length("text") >= 200, "language": F.col("lang").isin("en", "de", "fr"), "shouting": ~F.col("text").rlike("[A-Z]{3,}!!")}
    return schema.validated(table(spark, sf_dir, "documents"), rules).select("doc_id", "faults")


@query("select o.o_orderkey, o.lines as declared, coalesce(l.n, 0) as listed, o.lines = coalesce(l.n, 0) as complete from (select o_orderkey, (o_orderkey % 7) + 1 as lines from orders) o left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey")
def declared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows found against the total that the first page declared."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("declared"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("listed"))
    return o.join(n, "o_orderkey", "left").select("o_orderkey", "declared", F.coalesce("listed", F.lit(0)).alias("listed")).withColumn("complete", F.col("declared") == F.col("listed"))


@query("""with r as (select p_brand as title, p_partkey, lower(p_name) as name, p_size, (p_partkey % 3) as fmt, p_partkey % 2 = 0 as authorised from part where lower(p_type) like '%e%')
select title, p_partkey, fmt from (select *, row_number() over (partition by title order by fmt, authorised desc, p_size desc, name, p_partkey) as rn from r) where rn = 1""")
def rendition_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred rendition of each title: kind, then authorised, then rectified."""
    p = table(spark, sf_dir, "part").where(F.lower("p_type").contains("e")).select(F.col("p_brand").alias("title"), "p_partkey", F.lower("p_name").alias("name"), "p_size", (F.col("p_partkey") % 3).alias("fmt"), (F.col("p_partkey") % 2 == 0).alias("authorised"))
    return corpus.newest(p, ["title"], F.col("fmt").asc(), F.col("authorised").desc(), F.col("p_size").desc(), F.col("name").asc(), F.col("p_partkey").asc()).select("title", "p_partkey", "fmt")


@query("""with r as (select p_brand, p_name, p_partkey, split_part(p_name, ' ', 1) as stem, first_value(split_part(p_name, ' ', 1)) over (partition by p_brand order by p_partkey % 2 <> 0, p_partkey) as best from part) select p_brand, p_partkey, stem from r where stem = best""")
def rendition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All renditions that share the stem of the preferred one."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.substring_index("p_name", " ", 1).alias("stem"))
    best = F.first("stem").over(Window.partitionBy("p_brand").orderBy(F.col("p_partkey") % 2 != 0, "p_partkey"))
    return p.withColumn("best", best).where("stem = best").drop("best")
