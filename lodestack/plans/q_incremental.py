"""Queries on snapshots, cursors, versions and request logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.operators import incremental as inc
from lodestack.operators import order
from lodestack.plans.registry import query, table

_SNAP = """with o as (select doc_id, case when doc_id % 10 = 3 then md5(text || 'old') else md5(text) end as h from documents where doc_id % 7 <> 0), n as (select doc_id, md5(text) as h from documents where doc_id % 11 <> 0),
r as (select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.h is null then 'insert' when n.h is null then 'delete' when o.h = n.h then 'unchanged' else 'replace' end as action from o full join n on o.doc_id = n.doc_id)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 7 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("old"))).otherwise(F.col("text"))).alias("h"))
    return old, d.where("doc_id % 11 <> 0").select("doc_id", F.md5("text").alias("h"))


@query(_SNAP + " select * from r")
def snapshot_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change data capture between two snapshots by content hash."""
    return inc.reconcile(*_snapshots(spark, sf_dir), "doc_id", "h")


@query(_SNAP + " select action, count(*) as n from r group by action")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_reconcile(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query("""with t as (select user_id, event_id, event_type, value, case when event_type = 'error' then false else true end as ok, event_id % 97 = 0 as gone from events),
r as (select *, row_number() over (partition by user_id order by event_id desc) as n from t where ok or gone) select user_id, event_id, event_type from r where n = 1 and not gone""")
def log_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last successful record of each key unless a tombstone follows."""
    e = table(spark, sf_dir, "events")
    return inc.compact_log(e, "user_id", "event_id", F.col("event_type") != "error", F.col("event_id") % 97 == 0).select("user_id", "event_id", "event_type")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by (event_type = 'click') desc, value > 50 desc, ts desc, event_id desc) as n from events) where n = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authoritative version: current, then latest, then newest cursor."""
    e = table(spark, sf_dir, "events")
    best = F.max_by(F.struct("event_id", "event_type"), F.struct(F.col("event_type") == "click", F.col("value") > 50, "ts", "event_id"))
    return e.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", "b.event_type")


@query("""with m as (select max(ts) as top from events), w as (select e.* from events e, m where e.ts >= m.top - interval 8 days and e.ts <= m.top - interval 1 day),
r as (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from w) select user_id, event_type, event_id from r where n = 1""")
def overlap_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven days before the cursor are read again; of each key the newest row stays."""
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("ts").alias("top")).first().top
    cursor = F.lit(top) - F.expr("INTERVAL 1 DAY")
    again = inc.overlap(e, "ts", cursor, cursor)
    return inc.latest(again, ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_type", "event_id")


@query("select user_id, max(event_id) as high from events where event_type <> 'error' group by user_id")
def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.max("event_id").alias("high"))


@query("select p.page_id, p.url from pages p where p.page_id not in (select doc_id from documents where doc_id % 3 = 0)")
def scrape_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries that no finished record settles."""
    done = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 3 == 0, "ok").otherwise("retry").alias("status"))
    return inc.feed_diff(table(spark, sf_dir, "pages").select("page_id", "url"), done, "page_id", "status", ("ok",))


@query("with t as (select distinct sha256(text) as text_sha256 from documents), c as (select distinct sha256(text) as text_sha256 from documents where doc_id % 4 <> 1) select text_sha256 from t where text_sha256 not in (select text_sha256 from c)")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts that the content-addressed cache lacks."""
    d = table(spark, sf_dir, "documents")
    cache = d.where("doc_id % 4 <> 1").select(F.lit("m").alias("model_id"), F.sha2("text", 256).alias("text_sha256"))
    return inc.cache_misses(d, cache, "m").select("text_sha256")


@query("with t as (select sha256(text) as text_sha256, count(*) as copies, min(doc_id) as first_id from documents group by 1) select * from t")
def unique_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query("select c_custkey, c_mktsegment, c_acctbal from (select *, row_number() over (partition by c_custkey order by v desc) as n from (select c_custkey, c_mktsegment, round(c_acctbal, 2) as c_acctbal, 0 as v from customer union all select c_custkey, 'NEW', round(c_acctbal, 2), 1 from customer where c_custkey % 5 = 0)) where n = 1")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ON CONFLICT DO UPDATE as a table operation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    return inc.upsert(c, c.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("NEW")), ["c_custkey"])


@query("select o_custkey, o_orderkey, o_orderdate, before from (select o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as before from orders) where o_orderdate < before")
def version_scan_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose cursor runs backwards."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return inc.order_faults(rows, ["o_custkey"], "o_orderkey", "o_orderdate")


@query("""with r as (select o_custkey, o_orderkey as first, o_orderkey + (o_orderkey % 3) as last from orders), x as (select *, lag(last) over (partition by o_custkey order by first, last) + 1 as expected from r)
select o_custkey, first, last, expected, case when first > expected then 'gap' else 'overlap' end as fault from x where expected is not null and first <> expected""")
def range_partition_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result ranges must follow each other without gap or overlap."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("first"), (F.col("o_orderkey") + F.col("o_orderkey") % 3).alias("last"))
    return inc.range_faults(rows, ["o_custkey"], "first", "last")


@query("""with n as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(value) filter (r = ceil(0.5 * n)) as p50, max(value) filter (r = ceil(0.95 * n)) as p95, round(avg(value), 6) as mean, max(value) filter (r = round((n - 1) * 0.95) + 1) as p95_rounded from n group by event_type""")
def percentiles_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles in both readings: rank ceil(f·n), and round((n-1)·f) from 0."""
    e = table(spark, sf_dir, "events").where("value is not null")
    n = F.col("n")
    ranks = order.at_ranks(e, ["event_type"], "value", {"p50": F.ceil(n * 0.5), "p95": F.ceil(n * 0.95), "p95_rounded": F.round((n - 1) * 0.95) + 1})
    return ranks.join(e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")), "event_type").select("event_type", "p50", "p95", "mean", "p95_rounded")


_SESSION = """with c as (select user_id, event_id as call_id, ts as started from events where event_type = 'click'), r as (select user_id, event_id - 1 as call_id, ts as finished, event_type = 'error' as failed from events where event_type <> 'click'),
j as (select coalesce(c.call_id, r.call_id) as call_id, c.started, r.finished, (epoch_us(r.finished) - epoch_us(c.started)) as latency, r.failed from c full join r on c.call_id = r.call_id)"""


def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    calls = e.where("event_type = 'click'").select(F.col("event_id").alias("call_id"), F.col("ts").alias("started"))
    results = e.where("event_type <> 'click'").select((F.col("event_id") - 1).alias("call_id"), F.col("ts").alias("finished"), (F.col("event_type") == "error").alias("failed"))
    joined = calls.join(results, "call_id", "full_outer")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return joined.withColumn("latency", micros("finished") - micros("started"))


@query(_SESSION + " select call_id, latency, failed, started is null as orphan from j")
def session_latency_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls FULL OUTER JOIN results by id; results without a call stay."""
    return _session(spark, sf_dir).select("call_id", "latency", "failed", F.col("started").isNull().alias("orphan"))


@query(_SESSION + ", n as (select latency, row_number() over (order by latency) as r, count(*) over () as n from j where latency is not null) select (select max(latency) from n where r = ceil(0.5 * n.n)) as p50, (select max(latency) from n where r = ceil(0.95 * n.n)) as p95, round(avg(latency), 3) as mean, count(*) filter (failed) as errors, count(*) as n from j")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    s.createOrReplaceTempView("lodestack_session")
    return spark.sql("select percentile_disc(0.5) within group (order by latency) as p50, percentile_disc(0.95) within group (order by latency) as p95, round(avg(latency), 3) as mean, count_if(failed) as errors, count(*) as n from lodestack_session")


@query()
def aimd_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concurrency limit after each answer, folded over a user's log in order."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        state, out = (4, 0, 64, False), []
        for kind in group.sort_values(["ts", "event_id"])["event_type"]:
            state = inc.aimd_step(state, kind != "error")
            out.append(state[0])
        done = group.sort_values(["ts", "event_id"])
        return pd.DataFrame({"user_id": done["user_id"], "event_id": done["event_id"], "limit": out})

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return e.groupBy("user_id").applyInPandas(fold, "user_id long, event_id long, limit int")


@query("select lang, count(*) as now, count(*) filter (doc_id % 3 <> 0) as acquired, 100 * count(*) filter (doc_id % 3 <> 0) >= 99 * count(*) as enough, 100 * count(*) filter (doc_id % 3 = 0) < 50 * count(*) as shrunk from documents group by lang")
def snapshot_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrink guard and acquisition gate for each source."""
    d = table(spark, sf_dir, "documents")
    n = d.groupBy("lang").agg(F.count("*").alias("now"), F.count_if(F.col("doc_id") % 3 != 0).alias("acquired"))
    return n.withColumn("enough", 100 * F.col("acquired") >= inc.ACQUIRED_PERCENT * F.col("now")).withColumn("shrunk", 100 * (F.col("now") - F.col("acquired")) < inc.SHRINK_PERCENT * F.col("now"))


@query("""with n as (select page_id, url, md5(html) as revision from pages), h as (select page_id, url, case when page_id % 4 = 0 then 'x' else md5(html) end as revision, page_id % 5 <> 0 as valid from pages where page_id % 9 <> 0)
select n.page_id, coalesce(n.revision = h.revision and n.url = h.url and h.valid, false) as reuse from n left join h on h.page_id = n.page_id""")
def reuse_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("revision"))
    held = now.where("page_id % 9 <> 0").withColumn("revision", F.when(F.col("page_id") % 4 == 0, F.lit("x")).otherwise(F.col("revision"))).withColumn("valid", F.col("page_id") % 5 != 0)
    return inc.reusable(now, held, "page_id").select("page_id", "reuse")


@query("with t as (select doc_id, text, row_number() over (partition by md5(text) order by doc_id) as n from documents) select doc_id from t where n = 1")
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates go, the first of each in order stays."""
    return inc.latest(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h")), ["h"], F.col("doc_id").asc()).select("doc_id")


@query("select event_id, user_id, last_value(case when event_type = 'view' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as heading from events")
def carried_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heading seen so far."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(w).alias("heading"))

