"""Queries on run control: manifest entries, evaluation of searches, stored documents and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.plans import runs
from lodestack.plans.registry import query, table
from lodestack.sources import normalise

_FORMATS = {"lexical": 3, "vector": 2}


@query("""with e as (select o_orderkey, case when o_orderkey % 2 = 0 then 'lexical' else 'vector' end as kind, (o_orderkey % 4)::int as format, case when o_orderkey % 5 = 0 then '../x' else 'plane/' || o_orderkey end as path, case when o_orderkey % 7 = 0 then 'none' else sha256(o_orderkey::varchar) end as sha, o_custkey as first_id, o_custkey + (o_orderkey % 3) as last_id, 2 as rows from orders),
f as (select o_orderkey as source_id, kind, list_filter([case when not ((kind = 'lexical' and format = 3) or (kind = 'vector' and format = 2)) then 'format' end, case when path = '../x' then 'path' end, case when sha = 'none' then 'digest' end, case when last_id - first_id + 1 <> rows then 'range' end], lambda x: x is not null) as faults from e)
select source_id, kind, array_to_string(faults, ',') as faults from f where len(faults) > 0""")
def manifest_entry_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a manifest that break a rule."""
    key = F.col("o_orderkey")
    entries = table(spark, sf_dir, "orders").select(
        key.alias("source_id"),
        F.when(key % 2 == 0, "lexical").otherwise("vector").alias("kind"),
        (key % 4).cast("int").alias("format"),
        F.when(key % 5 == 0, "../x").otherwise(F.concat(F.lit("plane/"), key.cast("string"))).alias("path"),
        F.when(key % 7 == 0, "none").otherwise(F.sha2(key.cast("string"), 256)).alias("sha256"),
        F.col("o_custkey").alias("first_id"),
        (F.col("o_custkey") + key % 3).alias("last_id"),
        F.lit(2).alias("rows"),
    )
    return runs.entry_faults(entries, _FORMATS).withColumn("faults", F.array_join("faults", ","))


@query("""with c as (select o_orderkey as case_id, o_totalprice / 1000 as ms from orders),
x as (select distinct l_orderkey as case_id, l_partkey as d from lineitem),
h as (select distinct l_orderkey as case_id, l_partkey as d from lineitem where l_linenumber <= 3),
n as (select x.case_id, count(*) as wanted, count(h.d) as got from x left join h on h.case_id = x.case_id and h.d = x.d group by x.case_id),
t as (select l_orderkey as case_id, bool_or(l_linenumber <= 3 and lower(l_returnflag) = 'r') as found from lineitem group by 1),
r as (select c.case_id, coalesce(round(got / wanted, 6), 1.0) as recall, c.case_id % 2 = 0 or coalesce(found, false) as evidence_found, ms <= 150 as fast from c left join n using (case_id) left join t using (case_id))
select case_id, recall, evidence_found, fast, recall = 1 and evidence_found and fast as passed from r""")
def search_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, evidence and latency of each case; an order's lines stand for its hits, in their order."""
    items = table(spark, sf_dir, "lineitem")
    wanted = items.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("expected"))
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 2 != 0, " R").alias("evidence"), (F.col("o_totalprice") / 1000).alias("latency_ms"))
    hits = items.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").cast("string").alias("document"), F.col("l_returnflag").alias("text"))
    return runs.evaluated(cases.join(wanted, "case_id", "left"), hits, 3, 150.0).withColumn("recall", F.round("recall", 6))


@query("""select page_id, case when page_id % 5 = 0 then 'document is missing' when page_id % 7 = 0 then 'document differs from its hash' end as fault from pages""")
def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents against the hashes of their inventory; some are left out and some changed."""
    from lodestack.sources import acquire

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("canonical_id"), "page_id", "url", "html")
    made = pages.withColumn("content_hash", acquire.content_hash(F.col("canonical_id"), F.col("url"), F.col("html")))
    stored = made.where("page_id % 5 <> 0").select("content_hash", F.col("canonical_id").alias("id"), F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("changed "), F.coalesce("url", F.lit("")))).otherwise(F.col("url")).alias("url"), "html")
    return normalise.stored_documents(made, stored, ["id", "url", "html"]).select(F.col("canonical_id").cast("long").alias("page_id"), "fault")


@query("""select o_orderkey, '<a href="' || case when o_custkey % 2 = 0 then 'doc:c' || o_custkey else '/c/' || o_custkey end || '#top">x</a><a href="/c/">y</a>' as html from orders""")
def internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to known addresses name their documents; the others stay."""
    pages = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit('<a href="/c/'), F.col("o_custkey").cast("string"), F.lit('#top">x</a><a href="/c/">y</a>')).alias("html"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("url"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("target"))
    return normalise.with_internal_links(pages, known, "o_orderkey")


@query()
def payload_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as payloads of an inventory; every fourth record tells another size."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("canonical_id"), F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    wrong = F.when(F.col("canonical_id").cast("long") % 4 == 0, 1).otherwise(0)
    inventory = pages.select("canonical_id", "path", (F.octet_length("content") + wrong).alias("size"), F.sha2("content", 256).alias("sha256"))
    return normalise.payload_documents(inventory, pages.select("path", "content"))
