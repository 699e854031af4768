"""Queries on what acquisition computes: filters, keys, hashes, listings and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import wordpiece
from lodestack.operators import corpus
from lodestack.plans.registry import query, table
from lodestack.sources import acquire


_IN_USE_TITLE = "concat(o_orderpriority, case when o_totalprice > 300000 then ' Decision  Number NOT in use' when o_totalprice < 20000 then ' Decision restricted' else concat(' v ', o_custkey) end)"


@query("select o_orderkey from orders where o_orderstatus <> 'P' and o_totalprice between 20000 and 300000")
def decisions_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that say so, and restricted decisions, are left out."""
    o = table(spark, sf_dir, "orders").selectExpr("*", f"{_IN_USE_TITLE} as title")
    return o.where(acquire.in_use(F.col("title"), F.col("o_orderstatus") == "P")).select("o_orderkey")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def not_repealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("o_orderstatus") == "F", "N").when(F.col("o_orderstatus") == "P", "Y")
    return table(spark, sf_dir, "orders").where(acquire.not_repealed(flag)).select("o_orderkey", "o_orderstatus")


@query("select p_partkey, case when p_retailprice < 1100 then 0 when p_retailprice < 1400 then 1 else 2 end as rank from part where p_size >= 10 and p_retailprice < 1700")
def readable_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of primary renditions by their form; attachments and other forms have none."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "case when p_size < 10 then 'Attachment' when p_size < 30 then 'Primary' else 'PRIMARY' end as kind", "case when p_retailprice < 1100 then 'Epub' when p_retailprice < 1400 then 'WORD' when p_retailprice < 1700 then 'Pdf' else 'Html' end as form")
    return p.select("p_partkey", acquire.rendition_rank(F.col("kind"), F.col("form")).alias("rank")).where("rank is not null")


@query("select o_orderkey from orders where o_custkey % 3 <> 0 and o_orderstatus = 'O' and o_totalprice > 1000")
def titles_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("state", F.when(F.col("o_orderstatus") == "O", "InForce").when(F.col("o_orderstatus") == "F", "Repealed").otherwise("NeverEffective"))
    return o.where(acquire.in_force(F.col("o_custkey") % 3 != 0, F.col("state"), F.col("o_totalprice") > 1000)).select("o_orderkey")


@query(r"select page_id, length(regexp_replace(html, '[^\p{L}\p{N}]', '', 'g')) < 2000 and page_id % 2 > 0 as low from pages")
def low_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", acquire.low_text(F.col("html"), F.col("page_id") % 2, 2000).alias("low"))


@query(r"""select page_id, case when regexp_matches(html, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>]*))') then regexp_extract(html, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>]*))', 1) || regexp_extract(html, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>]*))', 2) || regexp_extract(html, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>]*))', 3) end as href from pages""")
def first_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", acquire.attribute(F.col("html"), "href").alias("href"))


@query(r"""select page_id, sha256(regexp_replace(html, '(?is)\s+(?:style|width|height|align|valign|bgcolor|name|data-icon|cite|on[a-zA-Z]+)\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>]*)', '', 'g')) as digest from pages""")
def stripped_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(acquire.without_attributes(F.col("html")), 256).alias("digest"))


@query("""select o_orderkey, case when o_orderstatus = 'F' then '/law/view/document?docid=' || upper(o_orderpriority) || '/TR' || o_orderkey || '/nat' when o_orderstatus = 'O' then '/law/view/document?docid=PAC/' || o_custkey || '/955-5' else '/browse/' || o_custkey || '?page=' || o_orderkey end as canonical from orders""")
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that name a document in any case and quotes become its canonical one; others lose host and fragment."""
    href = "case when o_orderstatus = 'F' then concat('https://h.example/law/view/document?x=1&DocID=', lower(o_orderpriority), '/tr', o_orderkey, '/nat#p', o_custkey) when o_orderstatus = 'O' then concat('/law/view/document?docid=\\'pac/', o_custkey, '/955-5\\'&PiT=20200101000000') else concat('http://h.example/browse/', o_custkey, '?page=', o_orderkey, '#part') end"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{href} as href").select("o_orderkey", acquire.document_href(F.col("href")).alias("canonical"))


@query("""select o_orderkey, case when o_totalprice > 250000 then '/h' || o_custkey when o_orderstatus = 'F' then '02:' || o_orderpriority || ':' || o_custkey when o_orderstatus = 'O' then 'node/' || o_custkey else '/api?y=' || o_custkey end as id from orders""")
def crawl_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's id: its link, else the TOC parameter of its address, decoded, else the address."""
    address = "case when o_orderstatus = 'F' then concat('/api?a=1&TOC=02%3A', replace(o_orderpriority, ' ', '%20'), '%3A', o_custkey, '&x=1') when o_orderstatus = 'O' then concat('TOC=node%2F', o_custkey) else concat('/api?y=', o_custkey) end"
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "case when o_totalprice > 250000 then concat('/h', o_custkey) end as href", f"{address} as address")
    return o.select("o_orderkey", acquire.node_id(F.col("href"), F.col("address")).alias("id"))


#: Prefixes of ids and the folders that they stand for.
_FOLDERS = {"CRP%2F": "Cases", "TR/TR": "Public_rulings", "PSR/": "Practice_statements", "PBR": "Edited_private_advice", "mt": "Public_rulings", "PAL/": "Legislation_and_supporting_material", "SCD/": "Cases", "zz": "Other", "atoid/": "Public_rulings"}


def _by_index(key: str, values: list[str]) -> str:
    return f"case {key} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


@query(f"""with f as (select o_orderkey, o_orderpriority as h, o_orderstatus as s, 'Order ' || o_custkey as t, {_by_index('o_custkey % 9', list(_FOLDERS.values()))} as top from orders)
select o_orderkey, case when top = 'Other' then 'Other' when s = 'F' then top || ' > ' || t else top || ' > ' || h || ' > ' || t end as path from f""")
def representative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder, heading and title of documents that have no place in the tree."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"concat('docid=', {_by_index('o_custkey % 9', list(_FOLDERS))}, o_custkey) as id", "case when o_orderstatus = 'F' then '' else o_orderpriority end as heading", "concat('Order ', o_custkey) as title")
    return o.select("o_orderkey", F.array_join(acquire.representative_path(F.col("id"), F.col("heading"), F.col("title")), " > ").alias("path"))


_SLUG = r"substr(case when regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' then '{1}' else regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') end, 1, 80)"


@query(f"select p_partkey, 'payloads/' || {_SLUG.format('lower(p_type)', 'node')} || '/' || {_SLUG.format('lower(p_brand)', 'node')} || '/' || {_SLUG.format('lower(p_name)', 'link')} || '-' || substr(sha256(p_name || p_partkey), 1, 16) || '.html' as path from part")
def payload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", acquire.payload_path(F.array(F.lower("p_type"), F.lower("p_brand")), F.lower("p_name"), F.sha2(F.concat("p_name", F.col("p_partkey").cast("string")), 256)).alias("path"))


@query("select doc_id, doc_id % 4 <> 0 as intact from documents")
def payload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads against their records; every fourth record tells another size."""
    d = table(spark, sf_dir, "documents").withColumn("data", F.coalesce("text", F.lit("")).cast("binary"))
    size = F.octet_length("data") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)
    return d.select("doc_id", acquire.payload_intact(size, F.sha2("data", 256), F.col("data")).alias("intact"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'v' || o_orderkey when 1 then '20200101' when 2 then '1999' end as version from orders")
def upstream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    field, href, ident = F.when(k % 4 == 0, F.concat(F.lit(" v"), k.cast("string"))).otherwise(" "), F.when(k % 4 == 1, "/d?a=1&PiT=20200101"), F.when(k % 4 == 2, "X?pit=1999").otherwise("X")
    return table(spark, sf_dir, "orders").select("o_orderkey", acquire.upstream_version(F.lit(None).cast("string"), field, href=href, canonical_id=ident).alias("version"))


@query("select l_orderkey, l_linenumber, l_orderkey || '/' || l_linenumber as asset_id, nullif(trim(l_returnflag), 'A') as alt from lineitem")
def asset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt = acquire.plain_or_null(F.when(F.col("l_returnflag") == "A", " \n ").otherwise(F.concat(F.lit(" "), "l_returnflag", F.lit(" "))))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", acquire.asset_id(F.col("l_orderkey").cast("string"), F.col("l_linenumber")).alias("asset_id"), alt.alias("alt"))


def _sql_prefixed(x: str) -> str:
    h = f"lpad(printf('%X', strlen({x})), 16, '0')"
    return "unhex(" + " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2)) + f") || encode({x})"


@query(f"select doc_id, sha256({' || '.join(_sql_prefixed(x) for x in ('doc_id::varchar', 'coalesce(lang, chr(32) || chr(32))', 'coalesce(text, repeat(chr(32), 0))'))}) as digest from documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", acquire.content_hash(F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("  ")), F.col("text")).alias("digest"))


@query("""select p_partkey, sha256('{"version":1,"inventory":{"id":' || p_partkey || ',"title":"' || p_name || '"},"html":"<p>' || p_type || '</p>","assets":["' || least(p_brand, p_type) || '","' || greatest(p_brand, p_type) || '"]}') as digest from part""")
def normalised_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return table(spark, sf_dir, "part").select("p_partkey", acquire.normalised_hash(1, inventory, F.concat(F.lit("<p>"), "p_type", F.lit("</p>")), F.array("p_type", "p_brand")).alias("digest"))


@query("""select p_partkey, case when p_partkey % 2 = 0 then 'normalizer:r3|' else '' end || 'v' || p_size || '|' || sha256('{"id":' || p_partkey || ',"title":"' || p_name || '"}') as revision from part""")
def revision_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return table(spark, sf_dir, "part").select("p_partkey", acquire.revision_key(F.concat(F.lit("v"), F.col("p_size").cast("string")), entry, F.when(F.col("p_partkey") % 2 == 0, "r3")).alias("revision"))


@query("with h as (select source, sha256(doc_id || '|' || coalesce(lang, '')) as h from documents) select source, count(*) as records, (sum(('0x' || substr(h, 1, 15))::bigint::hugeint) % 2305843009213693951)::bigint as digest from h group by source")
def inventory_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("line", F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.coalesce("lang", F.lit(""))))
    return acquire.fingerprint(d, "line", ["source"])


@query("""select o_orderkey, case when o_orderstatus = 'P' then null else o_orderpriority end as name from orders""")
def enum_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names given by their number or by themselves; numbers and names beyond the list are none."""
    o = table(spark, sf_dir, "orders")
    names = [r[0] for r in o.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("o_orderpriority")) - 1
    value = F.when(F.col("o_orderstatus") == "F", number.cast("string")).when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).when(F.col("o_orderkey") % 2 == 0, (number + 100).cast("string")).otherwise(F.concat("o_orderpriority", F.lit("?")))
    return o.select("o_orderkey", acquire.enum_name(value, names).alias("name"))


@query("""select event_id, case when event_id % 5 = 4 then null else strftime(ts - to_hours(case when event_id % 5 = 2 then 10 else 0 end), '%Y-%m-%dT%H:%M:%S') || case when event_id % 5 = 1 then '.' || rtrim((1 + event_id % 999)::varchar, '0') else '' end end as at from events where event_id % 999 <> 998""")
def canonical_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with zones, offsets and fractions in one spelling; days that there are not are none."""
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 5
    shown = F.when(k == 0, base).when(k == 1, F.concat(base, F.lit("."), (1 + F.col("event_id") % 999).cast("string"), F.lit("000Z"))).when(k == 2, F.concat(base, F.lit("+10:00"))).when(k == 3, F.concat(base, F.lit("Z"))).otherwise(F.concat(F.regexp_replace(base, r"-\d\d-", "-13-"), F.lit("Z")))
    return table(spark, sf_dir, "events").where("event_id % 999 <> 998").select("event_id", acquire.canonical_time(shown).alias("at"))


@query("""select event_id, case event_id % 4 when 0 then epoch_us(ts) // 1000 when 1 then trunc(value)::bigint when 2 then epoch_ms(date_trunc('second', ts)) else user_id end as ms from events""")
def coerced_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds from numbers and ISO times; what is neither takes the fallback."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)").cast("string")).when(k == 1, F.format_string("%.4f", "value")).when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", acquire.epoch_millis(text, F.col("user_id").cast("string")).alias("ms"))


@query("""select event_id, case event_id % 7 when 0 then (1 + user_id % 3) || ' search hit(s); first: ' || event_type when 1 then (user_id % 4) || ' chunk(s) returned' when 2 then '1 definition(s) returned' when 3 then 'stats: ' || user_id || ' documents; ' || event_id || ' chunks'
 when 4 then 'JSON object: ' || event_type || ', b' when 5 then 'JSON array with ' || (user_id % 4) || ' item(s)' else event_type || ' ' || user_id end as summary from events""")
def result_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line on each result, told by its shape."""
    k, user = F.col("event_id") % 7, F.col("user_id")
    many = lambda n, x: F.array_repeat(x, n.cast("int"))
    told = (
        F.when(k == 0, F.to_json(F.struct(many(1 + user % 3, F.struct(F.col("event_type").alias("title"))).alias("hits"))))
        .when(k == 1, F.to_json(F.struct(many(user % 4, user).alias("chunks"))))
        .when(k == 2, F.to_json(F.struct(F.array(F.struct("user_id")).alias("definitions"))))
        .when(k == 3, F.to_json(F.struct(user.alias("documents"), F.col("event_id").alias("chunks"))))
        .when(k == 4, F.concat(F.lit('{"'), "event_type", F.lit('": 1, "b": 2}')))
        .when(k == 5, F.to_json(many(user % 4, user)))
        .otherwise(F.concat(F.lit("\n  "), "event_type", F.lit(" "), user.cast("string"), F.lit(" \nsecond line")))
    )
    return table(spark, sf_dir, "events").select("event_id", acquire.result_summary(told).alias("summary"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then sha256(o_orderpriority) else (o_orderdate::date + 1)::varchar end as version from orders")
def valid_from_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", acquire.valid_from(ended, F.col("o_orderpriority")).alias("version"))


@query("select o_orderkey, case when o_orderkey % 4 <> 0 then o_orderdate::date::varchar end as day from orders")
def publication_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.when(F.col("o_orderkey") % 4 == 0, "20201399").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    html = F.concat(F.lit('<a href="/view/html/inforce/'), digits, F.lit('/act">x</a>'))
    return table(spark, sf_dir, "orders").select("o_orderkey", acquire.published_on(html).alias("day"))


@query("select o_orderkey, case when o_orderkey % 3 <> 0 then 1 + o_orderkey * 20 end as first, case when o_orderkey % 3 <> 0 then 20 + o_orderkey * 20 end as last, case when o_orderkey % 3 <> 0 then 1234567 end::bigint as total from orders")
def listing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    told = F.when(k % 3 == 0, "Displaying all").otherwise(F.concat(F.lit("Displaying "), F.format_number(k * 20 + 1, 0), F.lit(" - "), F.format_number(k * 20 + 20, 0), F.lit(" of 1,234,567 results")))
    return table(spark, sf_dir, "orders").select("o_orderkey", acquire.displayed_range(told).alias("r")).select("o_orderkey", "r.first", "r.last", "r.total")


@query("select page_id, page_id % 3 = 0 as missing from pages")
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.when(F.col("page_id") % 3 == 0, "<html><body><p>Document could\nnot be found</p></body></html>").when(F.col("page_id") % 3 == 1, '<body><div class="a judgment_content">Document could not be found</div></body>').otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", acquire.is_missing_page(html).alias("missing"))


@query("select distinct upper(substr(n_name, 1 + n_nationkey % 3, 1)) as letter, '/index/' || (n_nationkey % 3) as href from nation where n_nationkey % 3 < 2")
def alphabet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("g", F.col("n_nationkey") % 3)
    label = F.when(F.col("g") < 2, F.substring(F.lower("n_name"), F.col("g") + 1, F.lit(1))).otherwise(F.col("n_name"))
    return acquire.alphabet(n.select(label.alias("label"), F.concat(F.lit("/index/"), F.col("g").cast("string")).alias("href")), "label", "href")


@query("select n_name as title, 'a' as kind from nation union select r_name, 'a' from region union select n_name, case when n_nationkey % 2 = 0 then 'a' else 'b' end from nation")
def united_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a = F.lit("a").alias("kind")
    return acquire.united(n.select(F.col("n_name").alias("title"), a), r.select(F.col("r_name").alias("title"), a), n.select(F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b").alias("kind"), F.col("n_name").alias("title")))


@query("select c_custkey, o_orderkey, 'version' as kind from customer join orders on o_custkey = c_custkey union all select c_custkey, null, 'none' from customer where c_custkey not in (select o_custkey from orders)")
def titles_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    both, none = acquire.titles_with_versions(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey")
    return both.withColumn("kind", F.lit("version")).unionByName(none.select("c_custkey", F.lit(None).cast("long").alias("o_orderkey"), F.lit("none").alias("kind")))


@query("select distinct l_orderkey, 'ftn' || l_partkey % 50 as target from lineitem where l_linenumber % 2 = 0 except select l_orderkey, 'ftn' || l_suppkey % 50 from lineitem")
def footnote_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("#ftn"), (F.col("l_partkey") % 50).cast("string"))).otherwise("#top")
    return acquire.footnote_faults(li.select("l_orderkey", name.alias("name")), li.select("l_orderkey", F.concat(F.lit("ftn"), (F.col("l_suppkey") % 50).cast("string"))), "l_orderkey", "name")


@query("with d as (select doc_id, n_chars as tokens, sha256(doc_id::varchar) as digest, floor(n_chars / 16)::bigint as bucket from documents) select doc_id, bucket, floor((row_number() over (partition by bucket order by tokens, digest) - 1) / 4)::bigint as batch from d")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("tokens"), F.sha2(F.col("doc_id").cast("string"), 256).alias("digest"))
    return acquire.length_batches(d, "tokens", "digest", 4).select("doc_id", "bucket", "batch")


@query("select source, count(*) as documents, row_number() over (order by count(*) desc, source) as turn from documents where source is not null group by source")
def largest_sources_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which sources are built; one row a source meets in the window."""
    n = corpus.counts_by(table(spark, sf_dir, "documents").where("source is not null"), "source")
    named = n.select("source", F.col(n.columns[-1]).alias("documents"))
    from pyspark.sql import Window

    return named.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("documents"), "source")))


@query("select source, 'supplied' as side from (select distinct source from documents) where source not in (select distinct 'src' || (n_nationkey + 3) from nation) union all select s, 'registered' from (select distinct 'src' || (n_nationkey + 3) as s from nation) where s not in (select source from documents where source is not null)")
def source_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("source is not null").select("source")
    return acquire.set_difference(d, table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), (F.col("n_nationkey") + 3).cast("string")).alias("source")), "source")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def retained_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows whose title is still authoritative."""
    live = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(live, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("select url from pages where page_id % 3 = 0 union select url from pages where contains(url, 'ref=')")
def skipped_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redundant and excluded addresses together."""
    p = table(spark, sf_dir, "pages")
    return acquire.united(p.where("page_id % 3 = 0").select("url"), p.where(F.contains("url", F.lit("ref="))).select("url"))


@query("select label, round(sum(embedding[1] * (vec_id % 3 <> 0)::int::double) / greatest(sum((vec_id % 3 <> 0)::int), 1e-6), 6) as first, max(len(embedding)) as dim from embeddings group by label")
def mean_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    pooled = acquire.mean_pooled(e, "label", "embedding", "mask")
    return pooled.select("label", F.round(F.element_at("pooled", 1), 6).alias("first"), F.size("pooled").cast("long").alias("dim"))


@query("select vec_id, list_filter([case when vec_id % 5 = 0 then 'length' end, case when vec_id % 7 = 0 then 'model' end], lambda x: x is not null) as faults from embeddings")
def embedding_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    dim = e.select(F.size("embedding").alias("n")).first().n
    v = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    return acquire.embedding_faults(e.select("vec_id", v.alias("v"), F.when(F.col("vec_id") % 7 != 0, "m").alias("model")), "v", dim, "model", "m").select("vec_id", "faults")


_PLAIN = "strip_accents(lower(coalesce(text, '')))"


@query(rf"with w as (select doc_id, regexp_extract_all({_PLAIN}, '[^\s\p{{P}}$+<=>^`|~]+') as ws, length(regexp_replace({_PLAIN}, '[^\p{{P}}$+<=>^`|~]', '', 'g')) as marks from documents), n as (select doc_id, (coalesce(list_sum(list_transform(ws, lambda x: case when length(x) > 100 then 1 else length(x) end)), 0) + marks + 2)::bigint as tokens from w) select doc_id, tokens, tokens <= 512 as fits from n")
def token_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WordPiece tokens of each document, by a vocabulary of all its characters, and whether they fit the model."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # as many as there are characters in use
    seen = [r.c for r in wordpiece.characters(d, "text").collect()]
    found = sorted({x for c in seen for w in wordpiece.words(c) for x in w})
    vocabulary = [wordpiece.UNKNOWN, wordpiece.FIRST, wordpiece.LAST, *found, *[f"##{x}" for x in found]]
    return wordpiece.tokenised(d, "text", vocabulary).select("doc_id", "tokens", "fits")


@query("select source, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from documents group by source")
def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, first and last id of each source: what a sidecar must agree with."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("(select doc_id, 'index' as missing_in from documents except select vec_id, 'index' from embeddings) union all (select vec_id, 'table' from embeddings except select doc_id, 'table' from documents)")
def rowid_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a table and of its index, compared both ways."""
    found = acquire.set_difference(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    return found.select("doc_id", F.when(F.col("side") == "supplied", "index").otherwise("table").alias("missing_in"))


@query("select sha256(coalesce(text, '')) as sha, 'text/plain' as media_type, min(doc_id) as first_id from documents group by 1")
def deduplicated_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed assets, each once."""
    d = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.lit("text/plain").alias("media_type"), "doc_id")
    return d.groupBy("sha", "media_type").agg(F.min("doc_id").alias("first_id"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'Acts' else 'Principal' end as type, case when o_orderkey % 2 = 0 then o_orderdate::date::varchar end as day, case when o_orderkey % 5 = 0 then 'v ' || o_orderkey else o_orderpriority end as title from orders")
def coalesced_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-collection else collection, making date, title else the version's name; blanks count as none."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, F.when(k % 3 == 0, " ").otherwise("Principal").alias("sub"), F.lit("Acts").alias("collection"), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(" ").alias("made"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("name"), F.concat(F.lit("v "), k.cast("string")).alias("version"))
    told = lambda *cs: F.coalesce(*[acquire.plain_or_null(F.col(c)) for c in cs])
    return o.select("o_orderkey", told("sub", "collection").alias("type"), told("made").alias("day"), told("name", "version").alias("title"))
