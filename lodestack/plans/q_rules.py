"""Queries on heading shapes, templates, titles and dates: documents composed of each order's own numbers, names and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import headings, metadata
from lodestack.plans.registry import query, table

#: A heading of each shape, from a line's order (n), part (p), quantity (q) and year (y), in SQL that both engines read.
_HEADINGS = {
    "empty": "case when p % 2 = 0 then '' else '  ' end",
    "neutral": "concat('[', y, '] HCA ', n)",
    "decision": "concat('ATO ID ', y, '/', n)",
    "practice": "concat('PS LA ', y, '/', n, ' about ', p)",
    "bulletin": "concat('SMSFRB ', y, '/', n)",
    "ruling": "concat('TR ', y, '/D', n, ' (withdrawn)')",
    "numbered": "concat('IT  ', n % 10000, ' - residency')",
    "ruling_kind": "case when p % 2 = 0 then 'Taxation  Ruling' else 'GST ruling' end",
    "guideline_kind": "'Practical compliance guidelines'",
    "alert_kind": "'Taxpayer Alert'",
    "decision_kind": "'ATO Interpretative Decision'",
    "practice_kind": "'Law Administration Practice Statement'",
    "bulletin_kind": "'SMSF Regulators Bulletin'",
    "impact_kind": "'Decision impact statement'",
    "memorandum_kind": "'Explanatory Memorandum'",
    "act": "concat('Part ', p, ' Assessment Act ', y)",
    "bill": "concat('Laws Amendment (No. ', n, ') Bill ', y)",
    "matter": "concat('In the matter of Part ', p)",
    "case_number": "concat('Case ', n, '/', y % 100)",
    "versus": "concat('Part ', p, ' Pty Ltd v. The Commissioner ', n)",
    "subject": "concat('Summary of ', n, ', ', p, ' and ', q)",
}
_LINE = "l_orderkey as n, l_partkey as p, l_linenumber as q, year(l_shipdate) as y"


def _one_of(key: str, values: list[str]) -> str:
    return f"case {key} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


@query(f"select n, q, {_one_of('p % 21', [repr(s) for s in _HEADINGS])} as shape from (select {_LINE} from lineitem)")
def heading_shapes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 21 shapes, of headings made of each line's own values."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_LINE.split(", ")).selectExpr("n", "q", f"{_one_of('p % 21', list(_HEADINGS.values()))} as text")
    return rows.select("n", "q", headings.shape(headings.plain(F.col("text"))).alias("shape"))


@query("""with l as (select l_orderkey as n, l_linenumber as q, year(l_shipdate) as y, l_partkey % 5 as k from lineitem)
select n, q, case k when 0 then concat('TR ', y, '/', n) when 1 then concat('LCR ', y % 100, '/D', n, 'EC') when 2 then concat('[', y, '] FCA ', n) when 3 then concat('other ', n) else concat('PS LA ', y, '/', n) end as clean,
 case k when 0 then y when 1 then 1900 + y % 100 when 2 then y when 4 then y end::int as year from l""")
def clean_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in one spelling, without the remark that they were withdrawn, and the years that they name."""
    raw = "case l_partkey % 5 when 0 then concat('TR ', y, '/', n, ' (Withdrawn)') when 1 then concat(' LCR ', y % 100, '/D', n, 'EC ( withdrawn )') when 2 then concat('[', y, '] FCA ', n, ' at 3') when 3 then concat('other  ', n) else concat('PS LA ', y, '/', n, ' (WITHDRAWN)') end"
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as n", "l_linenumber as q", "year(l_shipdate) as y", "l_partkey").selectExpr("n", "q", f"{raw} as raw")
    clean = headings.clean_citation(F.col("raw"))
    return rows.select("n", "q", clean.alias("clean"), headings.cited_year(clean).alias("year"))


#: Of each template: id, headings, folder, body, published; then the template, title and date that follow. n: order, c: customer, p: priority, y: year, d: day in words, iso: day.
_COUNT = 14
_DOCUMENTS = [
    ("concat('TXR/TR', y, n, '/NAT')", "'Taxation Ruling', concat('TR ', y, '/', n), concat('About ', p)", "''", "''", "publication", "concat('TR ', y, '/', n, ' — About ', p)", "concat(y, '-01-01')"),
    ("concat('TXR/TR', y, n)", "concat('TR ', y, '/', n, ' (Withdrawn)'), concat('About ', p)", "''", "concat('Issued ', d, ' by us')", "publication", "concat('TR ', y, '/', n, ' (Withdrawn) — About ', p)", "iso"),
    ("concat('ITR/IT', n)", "concat('IT ', n % 9999, ' - residency'), concat('About ', c)", "''", "''", "publication", "concat('IT ', n % 9999, ' — About ', c)", "iso"),
    ("concat('JUD/', c)", "concat('Smith', c, ' v. Jones [', y, '] HCA ', n)", "''", "concat('(', y, ') 12 ATR text')", "case", "concat('Smith', c, ' v Jones')", "concat(y, '-01-01')"),
    ("concat('JUD/*', y, '*', n)", "concat('A heading ', p)", "''", "''", "old_case", "concat('A heading ', p)", "concat(y, '-01-01')"),
    ("concat('PAC/', y, lpad(cast(n % 10000 as varchar(9)), 4, '0'), '/', c)", "concat('Income Tax Act ', y)", "''", "''", "section", "concat('Income Tax Act ', y, ' s ', c)", "concat(y, '-01-01')"),
    ("concat('REG/', y, '0012/', c)", "concat('Part ', c)", "''", "''", "section", "concat('Regulations ', y, ' reg ', c)", "concat(y, '-01-01')"),
    ("concat('DIS/D', n)", "'Decision impact statement', concat('Smith', c, ' v Jones')", "''", "''", "impact", "concat('DIS: Smith', c, ' v Jones')", "iso"),
    ("concat('NEM/', n)", "concat('Tax Laws Bill ', y), 'Notes'", "''", "''", "bill", "concat('EM to Tax Laws Bill ', y)", "concat(y, '-01-01')"),
    ("concat('SRB/', n)", "'SMSF Regulator''s Bulletin', concat('SMSFRB ', y, '/', n), concat('About ', p)", "''", "''", "bulletin", "concat('SMSFRB ', y, '/', n, ' — About ', p)", "concat(y, '-01-01')"),
    ("concat('EV/', n)", "'Edited version'", "'Edited_private_advice'", "concat('Date of advice: ', d, '.')", "advice", "concat('EV ', n)", "iso"),
    ("concat('ACT/', n)", "concat('Fuel Act ', y)", "''", "concat('Made ', d)", "act", "concat('Fuel Act ', y)", "concat(y, '-01-01')"),
    ("concat('ZZ/Q', n)", "concat('Top ', p), concat('Sub ', c)", "''", "''", "other", "concat('Top ', p, ' — Sub ', c)", "iso"),
    ("concat('JUD/Z', n)", "concat('Front ', p), concat('Smith', c, ' v Jones')", "'Cases'", "concat('[', y, '] HCA ', n)", "case_below", "concat('Smith', c, ' v Jones')", "concat(y, '-01-01')"),
]


def _sql(i: int) -> str:
    return _one_of(f"n % {_COUNT}", [d[i] for d in _DOCUMENTS])


_ORDER = "select o_orderkey as n, o_custkey as c, o_orderpriority as p, year(o_orderdate) as y, strftime(o_orderdate, '%-d %B %Y') as d, strftime(o_orderdate, '%Y-%m-%d') as iso from orders"


@query(f"select n, {_one_of(f'n % {_COUNT}', [repr(d[4]) for d in _DOCUMENTS])} as template, {_sql(5)} as title, {_sql(6)} as date from ({_ORDER})")
def derived_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template, title and date of documents of all templates, whose parts are each order's own values."""
    return _derived(spark, sf_dir, "n")


def _derived(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as n", "o_custkey as c", "o_orderpriority as p", "year(o_orderdate) as y", "date_format(o_orderdate, 'd MMMM yyyy') as d", "date_format(o_orderdate, 'yyyy-MM-dd') as iso")
    # rows are few bytes and much work, so they are dealt to all tasks, not read where a file's few row groups lie
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    heads = _one_of(f"n % {_COUNT}", [f"array({x[1]})" for x in _DOCUMENTS])
    docs = o.selectExpr(*keep, f"{_sql(0)} as native_id", f"{heads.replace(chr(39) * 2, chr(92) + chr(39))} as headings", f"{_sql(2)} as category", f"{_sql(3)} as body", "iso as published")
    return metadata.derive(docs.withColumn("levels", F.transform("headings", lambda _, i: i + 1)), *keep)


@query(f"with o as ({_ORDER}), t as (select n as o_orderkey, y, {_one_of(f'n % {_COUNT}', [repr(d[4]) for d in _DOCUMENTS])} as template from o), g as (select template, count(*) as n, min(y)::int as first_year from t group by template) select o_orderkey, t.template, g.n, g.first_year from t join g on t.template = g.template")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template of every document, how many documents have it and the earliest year among them."""
    told = _derived(spark, sf_dir, "n", "y").select(F.col("n").alias("o_orderkey"), "template", "y")
    # a row for each of the eleven templates, counted before the shuffle
    of_template = told.groupBy("template").agg(F.count("*").alias("n"), F.min("y").alias("first_year"))
    return told.join(F.broadcast(of_template), "template").select("o_orderkey", "template", "n", "first_year")
