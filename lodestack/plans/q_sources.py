"""Queries on crawls, keyset scans, versions, payloads, snapshots, listings and quarantine, over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import crawl, digests, payloads, snapshots, stored
from lodestack.plans import store
from lodestack.plans.registry import query, table
from lodestack.sources import keyset, listings, quarantine, register
from lodestack.streaming import authoritative

PAGE, CEILING = 500, ("1998-06-30", 1 << 40)
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{stored.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# crawls
@query("""with recursive l as (
 select 'root' as parent, r_regionkey::bigint as seq, r_name as title, 'r' || r_regionkey as folder, 0 as back from region
 union all select 'r' || n_regionkey, n_nationkey, n_name, 'n' || n_nationkey, 0 from nation
 union all select 'n' || n_nationkey, 0, 'up', 'r' || n_regionkey, 1 from nation
 union all select 'n' || s_nationkey, s_suppkey + 1, s_name, 's' || s_suppkey, 0 from supplier
 union all select 's' || s_suppkey, o_orderkey, case when o_orderkey % 5 = 0 then 'Withdrawn' else 'order ' || o_orderkey end, null, 0 from orders join supplier on s_suppkey = o_custkey),
t as (select title, folder, 0 as level, title as path, back from l where parent = 'root'
 union all select l.title, l.folder, t.level + 1, t.path || '/' || l.title, l.back from t join l on l.parent = t.folder and t.back = 0 and t.title not in ('NATION_3') where l.title <> 'Withdrawn')
select level, title, folder, path from t where title not in ('NATION_3')""")
def tree_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and orders as a tree with links back up: opened once, a nation pruned by its title, withdrawn entries left out."""
    none = F.lit(None).cast("string")
    entry = lambda df, parent, seq, title, folder: df.select(parent.alias("parent"), seq.cast("long").alias("seq"), title.alias("title"), folder.alias("folder"), none.alias("href"))
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    orders = table(spark, sf_dir, "orders").join(s.select(F.col("s_suppkey").alias("o_custkey")), "o_custkey")
    key = lambda letter, c: F.concat(F.lit(letter), _text(c))
    rows = entry(table(spark, sf_dir, "region"), F.lit("root"), F.col("r_regionkey"), F.col("r_name"), key("r", "r_regionkey"))
    rows = rows.union(entry(n, key("r", "n_regionkey"), F.col("n_nationkey"), F.col("n_name"), key("n", "n_nationkey")))
    rows = rows.union(entry(n, key("n", "n_nationkey"), F.lit(0), F.lit("up"), key("r", "n_regionkey")))
    rows = rows.union(entry(s, key("n", "s_nationkey"), F.col("s_suppkey") + 1, F.col("s_name"), key("s", "s_suppkey")))
    rows = rows.union(entry(orders, key("s", "o_custkey"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, "Withdrawn").otherwise(F.concat(F.lit("order "), _text("o_orderkey"))), none))
    found = crawl.crawl(rows, "root", F.col("title").isin("NATION_3", "Withdrawn"))
    return found.select("level", "title", "folder", F.array_join("path", "/").alias("path"))


@query("""with recursive n as (select event_id, lag(event_id) over (partition by user_id order by ts, event_id) as before from events),
k as (select event_id, before from n where event_id % 97 < 3), p as (select event_id, case when before in (select event_id from k) then before end as parent from k),
t as (select event_id as ancestor, event_id as node, 0::bigint as distance from p union all select t.ancestor, p.event_id, t.distance + 1 from t join p on p.parent = t.node)
select ancestor, node, distance from t""")
def forest_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of each node of a forest (events that follow one another), with their distances."""
    e = table(spark, sf_dir, "events").withColumn("before", F.expr("lag(event_id) over (partition by user_id order by ts, event_id)")).select("event_id", "before").where("event_id % 97 < 3")
    held = e.select(F.col("event_id").alias("before"), F.col("event_id").alias("parent"))
    return crawl.closure(e.join(held, "before", "left").select("event_id", "parent"), "event_id", "parent")


# keyset scans
def _recorded(spark: SparkSession, sf_dir: str) -> str:
    def build(path: str) -> None:
        rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_totalprice")
        keyset.record(rows, ["day", "o_orderkey"], PAGE, f"{path}/pages")
        stored.close(spark, path, {"format": "pages"})

    return f"{store.once(spark, 'orders-pages', [f'{sf_dir}/orders.parquet'], build, lambda p: p)}/pages"


def _options(path: str) -> dict[str, str]:
    return {"path": path, "keys": "day,o_orderkey", "page_size": str(PAGE), "ceiling": f'["{CEILING[0]}", {CEILING[1]}]', "pages_per_task": "8"}


@query(f"select {_DAY} as day, o_orderkey, floor((row_number() over (order by {_DAY}, o_orderkey) - 1) / {PAGE})::bigint as page from orders")
def keyset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that each row comes on in a keyset scan of the whole table."""
    return spark.read.schema("day string, o_orderkey long, page long").json(_recorded(spark, sf_dir))


_KEYED = "day string, o_orderkey long, o_totalprice double"
_SCANNED = f"select {_DAY} as day, o_orderkey, o_totalprice from orders where {_DAY} <= '{CEILING[0]}'"


@query(_SCANNED)
def keyset_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded pages up to a fixed ceiling, through the data source: order and page sizes are checked as they are read."""
    spark.dataSource.register(keyset.KeysetSource)
    return spark.read.format("keyset").schema(_KEYED).options(**_options(_recorded(spark, sf_dir))).load()


@query(_SCANNED)
def keyset_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream that takes a few pages a batch and goes on from its checkpoint."""
    spark.dataSource.register(keyset.KeysetSource)
    at = _fresh(spark, "keyset-stream")
    stream = spark.readStream.format("keyset").schema(_KEYED).options(**_options(_recorded(spark, sf_dir))).load()
    for _ in range(2):  # the second run finds nothing new
        stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(_KEYED).parquet(f"{at}/rows")


# versions
_VERSIONS = """with v as (select 'c' || o_custkey as id, lpad(o_orderkey::varchar, 12, '0') as order_key, o_orderstatus = 'F' and o_orderkey % 7 = 0 as is_current, o_orderstatus = 'O' as is_latest, 'p' || o_orderkey as payload from orders),
b as (select id, order_key, is_current, payload, row_number() over (partition by id order by is_current desc, is_latest desc, order_key desc) as n from v),
f as (select 'c' || c_custkey as id, 'register' as order_key, 'f' || c_custkey as payload from customer where c_custkey % 2 = 0)
select b.id, case when b.is_current then b.order_key else f.order_key end as order_key, case when b.is_current then b.payload else f.payload end as payload,
 case when b.is_current then 'version' when f.id is not null then 'fallback' else 'missing' end as origin from b left join f using (id) where n = 1"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.concat(F.lit("c"), _text("o_custkey")).alias("id"),
        F.lpad(_text("o_orderkey"), 12, "0").alias("order_key"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0)).alias("is_current"),
        (F.col("o_orderstatus") == "O").alias("is_latest"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
        F.concat(F.lit("p"), _text("o_orderkey")).alias("payload"),
    )
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    return rows, c.select(F.concat(F.lit("c"), _text("c_custkey")).alias("id"), F.lit("register").alias("order_key"), F.concat(F.lit("f"), _text("c_custkey")).alias("payload"))


@query(_VERSIONS)
def authoritative_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current version of each key, else what the register held, else told as missing."""
    return authoritative.resolved_batch(*_versions(spark, sf_dir))


@query(_VERSIONS)
def authoritative_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the stateful operator: rows come in two batches, timers tell the fallback once event time has moved on."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    authoritative.configure(spark)
    try:
        rows, back = _versions(spark, sf_dir)
        at = _fresh(spark, "versions")
        rows.where("cast(substring(payload, 2) as long) % 2 = 1").write.parquet(f"{at}/in")
        rows.where("cast(substring(payload, 2) as long) % 2 = 0").write.mode("append").parquet(f"{at}/in")
        # a row of no key of the table, far ahead in time
        ahead = spark.range(1).select(F.lit("").alias("id"), F.lit("").alias("order_key"), F.lit(True).alias("is_current"), F.lit(True).alias("is_latest"), F.lit("2200-01-01").cast("timestamp").alias("at"), F.lit("").alias("payload"))
        ahead.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(authoritative.VERSION).parquet(f"{at}/in")

        def keep(df: DataFrame, batch: int) -> None:
            df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{at}/out")

        told = authoritative.resolved(stream, back, "100 years").writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
        told.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    changes = spark.read.schema(f"{authoritative.RESULT}, batch int").parquet(f"{at}/out").where("id <> ''")
    return authoritative.last_told(changes, F.col("batch")).drop("batch")


# payloads
@query("""with a as (select page_id::varchar as canonical_id, url, page_id % 7 = 0 as failed1, page_id % 3 = 0 as failed2, page_id % 5 = 0 as changed, html from pages)
select canonical_id, case when failed1 and failed2 then 'failed' else 'success' end as status,
 case when failed1 and failed2 then null when failed2 and not failed1 or not failed1 and not changed then sha256(html) when changed then sha256(html || 'x') else sha256(html) end as sha256,
 case when not failed1 and failed2 then 'failed' end as refresh_status,
 case when failed1 and failed2 or failed1 or changed and not failed2 then 2 else 1 end as day from a""")
def payload_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of downloads of all pages: failures keep the last good payload, unchanged ones change nothing."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    held = payloads.Payloads(spark, _fresh(spark, "payloads"), buckets=16)

    def answers(failed: Column, body: Column, day: int) -> DataFrame:
        when = F.lit(f"2024-01-0{day}").cast("timestamp")
        return p.select(_text("page_id").alias("canonical_id"), F.col("url").alias("href"), F.when(failed, "failed").otherwise("success").alias("status"), F.when(failed, 503).otherwise(200).alias("http_status"), F.when(failed, "busy").alias("error"), F.when(~failed, body.cast("binary")).alias("content"), when.alias("attempted_at"))

    held.update(answers(F.col("page_id") % 7 == 0, F.col("html"), 1))
    held.update(answers(F.col("page_id") % 3 == 0, F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 2))
    return held.read().select("canonical_id", "status", "sha256", "refresh_status", F.dayofmonth("downloaded_at").alias("day"))


@query()
def digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest tree of a generation made of the tables, before and after one table grows: what each check reads and tells."""
    root, names = _fresh(spark, "generation"), ("nation", "orders", "documents")
    for name in names:
        table(spark, sf_dir, name).write.parquet(f"{root}/{name}")
    tree = digests.DigestTree.build(spark, root, _fresh(spark, "tree"))
    told = [("start", tree.at_start(root)), ("full", tree.full(root))]
    table(spark, sf_dir, "nation").write.mode("append").parquet(f"{root}/nation")
    after, updated = tree.after_update(root, _fresh(spark, "tree"))
    told += [("stale", tree.at_start(root)), ("update", updated), ("start again", after.at_start(root)), ("full again", after.full(root))]
    return spark.createDataFrame([(name, v.files, v.files_read, int(v.bytes_read), len(v.faults)) for name, v in told], "check string, files long, files_read long, bytes_read long, faults int")


# snapshots
@query("select o_orderkey, o_custkey, 4 as scans from orders")
def stable_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read while they move: two scans differ from the next, then two agree."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows, _, scans = snapshots.stable(lambda i: o if i >= 2 else o.where(F.col("o_orderkey") % (5 - i) != 0), "o_orderkey")
    return rows.withColumn("scans", F.lit(scans))


_RANGES = "select l_orderkey as k, (l_linenumber * 10 - 9)::bigint as a, (l_linenumber * 10 + case when l_suppkey % 4 = 0 then 3 else 0 end)::bigint as b, (max(l_linenumber) over (partition by l_orderkey) * 10 - case when l_orderkey % 6 = 0 then 2 else 0 end)::bigint as n, l_partkey from lineitem"


@query(f"""with r as (select k, a, b, n from ({_RANGES}) where l_partkey % 3 <> 0), w as (select *, coalesce(max(b) over (partition by k order by a, b rows between unbounded preceding and 1 preceding), 0) as e from r), x as (select k, max(b) as b, max(n) as n from r group by k)
select k, 'gap' as fault, e + 1 as "from", a - 1 as "to" from w where a > e + 1 union all select k, 'overlap', a, least(b, e) from w where a <= e
union all select k, 'short', b + 1, n from x where b < n union all select k, 'beyond', n + 1, b from x where b > n""")
def coverage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared ranges of pages with holes, overlaps and ends that miss the total."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10 - 9).cast("long").alias("a"), (F.col("l_linenumber") * 10 + F.when(F.col("l_suppkey") % 4 == 0, 3).otherwise(0)).cast("long").alias("b"), "l_linenumber", "l_partkey")
    # in the order that the faults are looked for in, so rows are sorted once
    most = F.expr("max(l_linenumber) over (partition by k order by a, b rows between unbounded preceding and unbounded following)")
    r = r.select("k", "a", "b", (most * 10 - F.when(F.col("k") % 6 == 0, 2).otherwise(0)).cast("long").alias("n"), "l_partkey")
    return snapshots.coverage_faults(r.where("l_partkey % 3 <> 0").drop("l_partkey"), ["k"], "a", "b", "n")


@query("with r as (select o_orderkey as chunk_id, o_totalprice as score, row_number() over (order by o_totalprice desc, o_orderkey) as rank from orders) select chunk_id, score, rank from r where rank <= 250")
def seek_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages of an immutable ranking, each found by the cursor of the one before."""
    scored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("score"))
    ranking = snapshots.Ranking.store(scored, _fresh(spark, "ranking"), "orders by price")
    out, cursor = None, None
    for i in range(5):
        page, cursor = ranking.page(50, cursor)
        page = page.withColumn("rank", F.expr("row_number() over (order by score desc, chunk_id)") + 50 * i)
        out = page if out is None else out.unionByName(page)
        if cursor is None:
            break
    return out


# listings
@query("""with p as (select page_id, regexp_extract(html, '(?s)<nav>.*?</nav>') as nav from pages),
l as (select page_id, regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 1) as h, regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 2) as t from p),
e as (select page_id, unnest(range(len(h)))::int as place, unnest(h) as h, unnest(t) as t from l),
f as (select *, row_number() over (partition by page_id, h order by place) as n from e)
select page_id, place, 'https://example.org' || h as href, trim(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '\\s+', ' ', 'g')) as title from f where n = 1""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page's menu, made absolute: each target once, where it first stands."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<article>"), listings.part(F.col("html"), "nav"), F.lit("</article>")).alias("html"))
    return listings.feed(p, "page_id", "html", "https://example.org", lambda c: c).drop("heading")


@query("""with m as (select n_regionkey, n_nationkey, n_name, r_name from nation join region on r_regionkey = n_regionkey)
select n_regionkey as page, '/law/view/document?docid=N/' || n_nationkey as href, case when n_nationkey % 4 = 0 then '/law/view/document?docid=N/' || n_nationkey else n_name || ' & co' end as title, case when n_nationkey % 2 = 0 then r_name end as heading from m""")
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed's links under the last heading before them: repeated, foreign and empty ones too."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    link = F.concat(F.lit('<p><a class="x" href="'), F.when(F.col("n_nationkey") % 3 == 0, "https://www.ato.gov.au").otherwise(""), F.lit("/law/view/document?docid=N/"), _text("n_nationkey"), F.lit('">'), F.when(F.col("n_nationkey") % 4 == 0, " ").otherwise(F.concat(F.lit("<b>"), "n_name", F.lit("</b>\n &amp; co"))), F.lit("</a></p>"))
    # even ones under the region's name, odd ones after an empty heading; then all again, and a link elsewhere
    lists = n.groupBy("n_regionkey").agg(F.max("r_name").alias("r"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, link))), "").alias("even"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 2 == 1, link))), "").alias("odd"))
    html = F.concat(F.lit('<nav><a href="/law/view/document?docid=Z">z</a></nav><article><h1>x</h1><h2 id="a">'), "r", F.lit("</h2>"), "even", F.lit("<h3> </h3>"), "odd", F.lit("<h2>again</h2>"), "even", F.lit('<a href="/other">o</a><a name="n">none</a></article>'))
    canonical = lambda c: F.regexp_replace(c, r"^https?://(?:www\.)?ato\.gov\.au", "")
    return listings.feed(lists.select(F.col("n_regionkey").alias("page"), html.alias("html")), "page", "html", "https://www.ato.gov.au", canonical, "/law/view/document").drop("place")


@query("""select 'https://court.example' || '/judgments/' || case when o_orderkey % 5 = 0 then 'unreported-judgments/u' || o_orderkey else o_orderkey::varchar end as url,
 case when o_orderkey % 11 <> 0 then o_orderpriority || ' & "Co" v ' || o_custkey end as title, case when o_orderkey % 7 <> 0 then '[1999] X ' || o_orderkey end as citation, cast(o_orderdate as date) as date,
 case when o_orderkey % 5 = 0 then 'unreported/u' || o_orderkey when o_orderkey % 7 <> 0 then '[1999] X ' || o_orderkey end as native_id,
 case when o_orderkey % 11 = 0 then 'no title' when o_orderkey % 5 <> 0 and o_orderkey % 7 = 0 then 'no identity' end as fault from orders""")
def listing_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A court's listing, one page a customer: rows with their fields; rows without title or identity are told as faults."""
    o = table(spark, sf_dir, "orders")
    key = _text("o_orderkey")
    slug = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("unreported-judgments/u"), key)).otherwise(key)
    div = lambda name, body: F.concat(F.lit(f"<div class='field {name}'>"), body, F.lit("</div>"))
    title = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.concat("o_orderpriority", F.lit(" &amp;amp;\n <i>&amp;quot;Co&amp;quot;</i> v "), _text("o_custkey")))
    cited = F.when(F.col("o_orderkey") % 7 == 0, "Citation: ").otherwise(F.concat(F.lit("Citation: [1999] X "), key))
    row = F.concat(F.lit('<a class="views-row views-row-item-judgement" href="/judgments/'), slug, F.lit('">'), div("field--title", title), div("field--citation", cited), div("field--hca-date-issued", F.concat(F.lit("Date: "), F.date_format("o_orderdate", "d MMM yyyy"))), F.lit("</a>"))
    pages = o.groupBy("o_custkey").agg(F.concat(F.lit("<html><a class='other' href='/x'>x</a>"), F.array_join(F.collect_list(row), "\n"), F.lit("</html>")).alias("html"))
    return listings.decisions(pages, "o_custkey", "html", "https://court.example").select("url", "title", "citation", "date", "native_id", "fault")


# quarantine
_BAD = """case when o_orderkey % 13 = 0 then ['line: no JSON of this schema'] else list_filter([
 case when o_orderkey % 17 = 0 then 'title: missing' end, case when o_orderkey % 19 = 0 and o_orderkey % 17 <> 0 then 'title: white space around it' end, case when o_orderkey % 23 = 0 then 'date: no day' end,
 case when o_orderkey % 29 = 0 then 'canonical_url: not https' end, case when o_orderkey % 29 = 0 then 'canonical_url: another host' end, case when o_orderkey % 31 = 0 then 'renditions: none' end,
 case when o_orderkey % 37 = 0 then 'native_id: repeated' end], lambda x: x is not null) end"""


def _inventory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def build(path: str) -> None:
        k = F.col("o_orderkey")
        title = F.when(k % 17 == 0, None).when(k % 19 == 0, F.concat(F.lit(" order "), k.cast("string"))).otherwise(F.concat(F.lit("order "), k.cast("string")))
        url = F.concat(F.when(k % 29 == 0, "http:").otherwise("https:"), F.lit("//docs.example/"), k.cast("string"))
        one = F.array(F.struct(F.concat(F.lit("https://docs.example/r/"), k.cast("string")).alias("url"), F.lit("html").alias("kind")))
        record = F.struct(F.concat(F.lit("d"), k.cast("string")).alias("native_id"), F.lit("1").alias("upstream_version"), title.alias("title"), F.lit("order").alias("document_type"), F.when(k % 23 == 0, "1999-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), url.alias("canonical_url"), F.when(k % 31 != 0, one).otherwise(F.slice(one, 1, 0)).alias("renditions"))
        text = F.when(k % 13 == 0, F.substring(F.to_json(record), 1, 20)).otherwise(F.concat(F.to_json(record), F.when(k % 2 == 0, "\r").otherwise("")))
        lines = table(spark, sf_dir, "orders").select(F.explode(F.when(k % 37 == 0, F.array(text, text)).when(k % 41 == 0, F.array(text, F.lit("  "))).otherwise(F.array(text))).alias("value"))
        lines.write.text(f"{path}/lines")
        stored.close(spark, path, {"format": "lines"})

    path = store.once(spark, "inventory", [f"{sf_dir}/orders.parquet"], build, lambda p: p)
    return quarantine.read(spark, f"{path}/lines", rules=quarantine.discovery_rules(["docs.example"]), max_bytes=1 << 40)


@query(f"with o as (select o_orderkey, {_BAD} as reasons, strftime(o_orderdate, '%Y-%m-%d') as date from orders) select 'd' || o_orderkey as native_id, 'order ' || o_orderkey as title, date from o where len(reasons) = 0")
def accepted_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound documents of an inventory of JSON lines."""
    return _inventory(spark, sf_dir)[0].select("native_id", "title", "date")


@query(f"with o as (select {_BAD} as reasons, case when o_orderkey % 37 = 0 then 2 else 1 end as copies from orders), e as (select unnest(reasons) as reason, copies from o) select reason, sum(copies)::bigint as lines from e group by reason")
def quarantined_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused lines by reason: a line may have several."""
    return _inventory(spark, sf_dir)[1].select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("lines"))


_FAULTS = (
    "list_filter([case when page_id % 5 = 0 then 'payload: parts' end, case when page_id % 7 = 0 then 'payload: absolute' end, case when page_id % 3 = 0 then 'media_type: no media type' end, case when page_id % 4 = 0 then 'sha256: no sha256' end, "
    r"case when regexp_matches(html, '(?i)<\s*(?:script|iframe|object|embed|applet|form|base|meta|link)\b') then 'html: active element' end, case when page_id % 6 = 0 then 'html: event handler' end, case when page_id % 9 = 0 then 'html: script URL' end], lambda x: x is not null)"
)


@query(f"with p as (select page_id, case when page_id % 2 = 0 then html else regexp_extract(html, '(?s)<article>.*?</article>') end as html from pages), f as (select page_id, unnest({_FAULTS}) as fault from p) select page_id, fault from f")
def contract_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised documents against their contract: payload paths, media types, digests, and markup that can act."""
    k = F.col("page_id")
    body = F.when(k % 2 == 0, F.col("html")).otherwise(listings.part(F.col("html"), "article"))
    body = F.concat(body, F.when(k % 6 == 0, "<p onclick = 'x'>").otherwise(""), F.when(k % 9 == 0, '<a href=" javascript:x">').otherwise(""))
    path = F.concat(F.when(k % 7 == 0, "/").otherwise(""), F.lit("p/"), F.when(k % 5 == 0, "../").otherwise(""), k.cast("string"))
    media = F.when(k % 3 == 0, "text html").otherwise("text/html; charset=utf-8")
    digest = F.sha2("html", 256)
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("payload"), media.alias("media_type"), F.when(k % 4 == 0, F.concat(F.lit("x"), digest)).otherwise(digest).alias("sha256"), body.alias("html"))
    c = F.col
    rules = [*quarantine.path_faults(c("payload"), "payload"), *quarantine.media_type_faults(c("media_type"), "media_type"), *quarantine.digest_faults(c("sha256"), "sha256"), *quarantine.html_faults(c("html"), "html")]
    return rows.select("page_id", F.explode(quarantine.reasons(rules)).alias("fault"))


@query("""with c as (select c_custkey as k, 'https://reg.example/c/' || c_custkey as url from customer)
select k::varchar as native_id, case when k % 11 = 0 then 'document is missing' when k % 13 = 0 then 'document does not match its inventory row' when k % 17 = 0 then 'document differs from its hash' end as fault,
 case when k % 11 <> 0 and k % 13 <> 0 and k % 17 <> 0 then '<p><a href="' || case when k + 1 in (select k from c) then 'doc:' || (k + 1) || '#s' else 'https://reg.example/c/' || (k + 1) || '#s' end || '">next</a> <a href="https://else.example/">x</a></p>' end as html from c""")
def register_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a register's store against its inventory, with planted faults; links between them turned into references."""
    k = F.col("c_custkey")
    address = lambda n: F.concat(F.lit("https://reg.example/c/"), n.cast("string"))
    html = F.concat(F.lit('<p><a href="'), address(k + 1), F.lit('#s">next</a> <a href="https://else.example/">x</a></p>'))
    docs = table(spark, sf_dir, "customer").select(k.cast("string").alias("native_id"), address(k).alias("canonical_url"), F.col("c_name").alias("title"), html.alias("html"))
    whole, at = _fresh(spark, "register"), _fresh(spark, "register")
    register.write(docs, "reg", whole)
    # the same store with documents lost, moved and changed
    held, n = spark.read.json(f"{whole}/documents"), F.col("native_id").cast("long")
    changed = held.where(n % 11 != 0).withColumn("canonical_url", F.when(n % 13 == 0, "https://reg.example/other").otherwise(F.col("canonical_url"))).withColumn("title", F.when(n % 17 == 0, "changed").otherwise(F.col("title")))
    changed.write.partitionBy("prefix").json(f"{at}/documents")
    for part in ("inventory", "state"):
        spark.read.json(f"{whole}/{part}").write.json(f"{at}/{part}")
    return register.read(spark, at, "reg").select("native_id", "fault", "html")
