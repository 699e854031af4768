"""Queries on text functions, HTML and extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import chunking, extract, html
from lodestack.functions import text as T
from lodestack.operators import order
from lodestack.plans.registry import query, table

#: Bytes of a batch that are turned into Python objects at a time.
SLICE_BYTES = 4 << 20
_TITLE = r"trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g'))"


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE_BYTES."""
    step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def mapped(df: DataFrame, column: str, f: Callable[[str], list[dict]], schema: str, kinds: dict[str, pa.DataType]) -> DataFrame:
    """``df`` without ``column``, a row for each record that ``f`` finds in it; in Arrow batches, of which a slice at a time is in Python objects."""
    names = [c for c in df.columns if c != column]
    ddl = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names], schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in sliced(whole)):
            at, rows = [], []
            for i, x in enumerate(b.column(b.schema.get_field_index(column)).to_pylist()):
                found = f(x or "")
                at += [i] * len(found)
                rows += found
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)).take(index) for n in names], *[pa.array([r[k] for r in rows], t) for k, t in kinds.items()]], names=[*names, *kinds])

    return df.mapInArrow(run, ddl)


@query(r"select page_id, " + _TITLE + " as title from pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.collapse_ws(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query(r"""select page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as href from pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by the tree, against links by pattern."""
    return mapped(table(spark, sf_dir, "pages").select("page_id", "html"), "html", lambda h: [{"href": x} for x, _ in html.links(h)], "href string", {"href": pa.string()})


@query(r"select page_id, len(regexp_extract_all(html, '<h[1-6][ >]')) as n from pages")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapped(table(spark, sf_dir, "pages").select("page_id", "html"), "html", lambda h: [{"n": len([x for x in html.parse(h).walk() if x.tag in html.HEADINGS])}], "n long", {"n": pa.int64()})
    return found


@query()
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean HTML, its length, marker text and title of each page."""

    def one(h: str) -> list[dict]:
        clean, text, title = html.cleaned(h)
        return [{"clean": clean, "clean_chars": len(clean), "text": text, "title": title}]

    kinds = {"clean": pa.string(), "clean_chars": pa.int64(), "text": pa.string(), "title": pa.string()}
    return mapped(table(spark, sf_dir, "pages").select("page_id", "html"), "html", one, "clean string, clean_chars long, text string, title string", kinds)


@query()
def html_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each page within the token budget."""
    one = lambda h: [{"ord": o, "anchor": a, "text": t} for o, a, t in chunking.chunk_html(h)]
    return mapped(table(spark, sf_dir, "pages").select("page_id", "html"), "html", one, "ord long, anchor string, text string", {"ord": pa.int64(), "anchor": pa.string(), "text": pa.string()})


@query()
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain documents as paragraphs, packed into chunks of 512 tokens."""

    def one(t: str) -> list[dict]:
        packed = chunking.pack([chunking.Block("p", x) for x in t.split("\n") if x.strip()])
        return [{"ord": i, "tokens": chunking.approx_tokens(b.text), "text": b.text} for i, b in enumerate(packed)]

    return mapped(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", one, "ord long, tokens long, text string", {"ord": pa.int64(), "tokens": pa.int64(), "text": pa.string()})


_SPACES = "[" + "".join(["\\t\\n\\x0B\\f\\r ", "\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"]) + "]"


@query(r"""select doc_id, case when text is null then null else 1 + len(regexp_extract_all(regexp_replace(text, '([.!?])[\t\n\x0B\f\r ]+', '\1' || chr(1), 'g'), '[.!?]' || chr(1) || '[A-Z(]')) end as n_sentences from documents""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every text; a split is counted where a stop, white space and a capital or bracket meet."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.size(T.sentences(F.col("text")))).cast("bigint").alias("n_sentences"))


@query(f"select doc_id, case when text is not null then greatest(1, floor(len(list_filter(regexp_split_to_array(text, '{_SPACES}+'), lambda x: x <> '')) * 1.3)::int) end as tokens from documents")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), T.approx_tokens(F.col("text"))).alias("tokens"))


@query(r"select p_partkey, substr(case when regexp_replace(regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' then 'item' else regexp_replace(regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') end, 1, 80) as slug from part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_type", "p_name")).alias("slug"))


@query(r"select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)(bearer)\s+[A-Za-z0-9._~+/=-]{8,}', '\1 [REDACTED]', 'g'), 'AKIA[A-Z0-9]{12,}', '[REDACTED]', 'g'), '(?i)(api[_-]?key|password|secret|token)(\s*[:=]\s*)[^\s,;]+', '\1\2[REDACTED]', 'g') as text from documents")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redacted(F.col("text")).alias("text"))


@query("select o_orderkey, case when regexp_matches(pit, '^\\d{8,14}$') then try_strptime(substr(pit, 1, 8), '%Y%m%d')::date::varchar end as day from (select o_orderkey, case when o_orderkey % 5 = 0 then '2024' || (o_orderkey % 13) || '31' when o_orderkey % 5 = 1 then strftime(o_orderdate, '%Y%m%d') || '120000' else strftime(o_orderdate, '%Y%m%d') end as pit from orders)")
def pit_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of a point in time, null if there is no such day."""
    from lodestack.ident import pit_date_col

    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    pit = F.when(key % 5 == 0, F.concat(F.lit("2024"), (key % 13).cast("string"), F.lit("31"))).when(key % 5 == 1, F.concat(day, F.lit("120000"))).otherwise(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", pit.alias("pit"), F.col("o_orderkey").alias("k")).select("o_orderkey", pit_date_col(F.col("pit")).cast("string").alias("day"))


@query("select o_orderkey, coalesce(try_strptime(case when regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}$') then t end, '%Y-%m-%d'), try_strptime(case when regexp_matches(t, '^\\d{1,2}/\\d{1,2}/\\d{4}$') then t end, '%d/%m/%Y'), try_strptime(case when regexp_matches(t, '^\\d{1,2} [A-Za-z]+ \\d{4}$') then t end, '%d %B %Y'))::date::varchar as day from (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%-d/%-m/%Y') when 2 then strftime(o_orderdate, '%-d %B %Y') else '31/02/2020' end as t from orders)")
def normalised_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spellings, held against the calendar."""
    key, d = F.col("o_orderkey"), "o_orderdate"
    t = F.when(key % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(key % 4 == 1, F.date_format(d, "d/M/yyyy")).when(key % 4 == 2, F.date_format(d, "d MMMM yyyy")).otherwise(F.lit("31/02/2020"))
    return table(spark, sf_dir, "orders").select("o_orderkey", extract.real_date_col(t).alias("day"))


@query("select p_partkey, 'v' || p_size as label, row_number() over (order by list_transform(string_split((p_size % 10) || '.' || (p_size % 7) || '.' || (p_partkey % 4), '.'), lambda x: x::int), p_partkey) as rank from part")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted versions in order of their numbers."""
    p = table(spark, sf_dir, "part")
    v = F.concat_ws(".", (F.col("p_size") % 10).cast("string"), (F.col("p_size") % 7).cast("string"), (F.col("p_partkey") % 4).cast("string"))
    ranked = order.numbered(p.select("p_partkey", "p_size", T.version_parts(v).alias("parts")), [], ["parts", "p_partkey"])
    return ranked.select("p_partkey", F.concat(F.lit("v"), F.col("p_size")).alias("label"), (F.col("row_no") + 1).alias("rank"))


@query("select o_orderkey, list_max(list_transform(regexp_extract_all('1 of ' || (o_orderkey % 50) || ', 2 of ' || (o_custkey % 70), 'of (\\d+)', 1), lambda x: x::int)) as total from orders")
def result_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest of all "of N" numbers."""
    said = F.concat(F.lit("1 of "), (F.col("o_orderkey") % 50).cast("string"), F.lit(", 2 of "), (F.col("o_custkey") % 70).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_max(F.transform(F.regexp_extract_all(said, F.lit(r"of (\d+)"), F.lit(1)), lambda x: x.cast("int"))).alias("total"))


@query("select event_id, case when event_id % 2 = 0 then 1 else 2 end as n, coalesce(json_extract_string(props, '$.k'), '-') as k from events")
def one_or_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON value that is an object or an array of objects."""
    obj = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k")))
    value = F.when(F.col("event_id") % 2 == 0, obj).otherwise(F.concat(F.lit("["), obj, F.lit(","), obj, F.lit("]")))
    many = F.coalesce(F.from_json(F.when(value.startswith("["), value), "array<struct<k:string>>"), F.array(F.from_json(value, "struct<k:string>")))
    return table(spark, sf_dir, "events").select("event_id", many.alias("m")).select("event_id", F.size("m").alias("n"), F.coalesce(F.col("m")[0]["k"], F.lit("-")).alias("k"))


@query("select c_custkey, replace(replace(replace(replace(replace(c_name || ' <a href=\"x\">&''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as escaped, true as back from customer")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("c_name", F.lit(" <a href=\"x\">&'"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.escape_html(raw).alias("escaped"), (T.unescape_html(T.escape_html(raw)) == raw).alias("back"))


_ESCAPED = "replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(rf"with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as ps from documents) select doc_id, '<article>' || array_to_string(list_transform(ps, lambda x: '<p>' || {_ESCAPED} || '</p>'), '') || '</article>' as html from p")
def text_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain texts as paragraphs, escaped."""
    return table(spark, sf_dir, "documents").select("doc_id", T.text_to_html(F.col("text")).alias("html"))


@query("select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) = 1)) as singles from documents")
def single_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(F.filter(F.split("text", r"\s+", -1), lambda x: F.length(x) == 1)).cast("bigint").alias("singles"))


#: A tenth of the texts with their glyphs apart, an eleventh with traces of a wrong decoding, a thirteenth without letters.
_DAMAGED = "case when doc_id % 10 = 0 then {spaced} when doc_id % 11 = 0 then concat(text, ' itâ€™s') when doc_id % 13 = 0 then ' -- ' else text end"
_SPACED_SQL = _DAMAGED.format(spaced=r"regexp_replace(text, '(\p{L})', '\1 ', 'g')")
_MARKS = r"array_to_string(list_transform(list_filter(regexp_split_to_array(coalesce(t, ''), '\s+'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '^\p{L}$') then 'x' else '.' end), '')"
_RUNS = f"regexp_extract_all({_MARKS}, 'x{{8,}}')"
_GLYPHS = "coalesce(list_sum(list_transform(runs, lambda x: length(x))), 0)::bigint"


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("spaced", F.regexp_replace("text", r"(\p{L})", "$1 "))
    return d.selectExpr("doc_id", f"{_DAMAGED.format(spaced='spaced')} as t")


@query(f"with r as (select doc_id, {_RUNS} as runs from (select doc_id, {_SPACED_SQL} as t from documents)) select doc_id, len(runs) as runs, {_GLYPHS} as glyphs from r")
def glyph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of spaced-out glyphs that a quality gate looks for."""
    runs = T.glyph_runs(F.col("t"))
    return _damaged(spark, sf_dir).select("doc_id", F.size(runs).cast("long").alias("runs"), F.aggregate(runs, F.lit(0).cast("long"), lambda s, n: s + n).alias("glyphs"))


@query(
    f"with r as (select doc_id, t, {_RUNS} as runs from (select doc_id, {_SPACED_SQL} as t from documents)), "
    + rf"g as (select *, {_GLYPHS} as g, length(regexp_replace(coalesce(t, ''), '\P{{L}}', '', 'g')) as n from r) select doc_id, case when not regexp_matches(coalesce(t, ''), '[\p{{L}}\p{{N}}]') then 'empty' "
    + "when contains(t, chr(65533)) or contains(t, 'ï¿½') or contains(t, 'â€') or contains(t, 'Â ') then 'encoding' when (g >= 100 and g * 20 >= n) or (g >= 24 and g * 2 >= n) then 'glyphs' end as damage from g"
)
def text_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are no evidence, and why."""
    return _damaged(spark, sf_dir).select("doc_id", T.text_damage(F.col("t")).alias("damage"))


@query("""select event_id, '{"user":' || user_id || ',"headers":{"Authorization":"[REDACTED_CREDENTIAL]","note":"authorization: Bearer [REDACTED_TOKEN] of ' || event_type || '"},"calls":[{"API_KEY":"[REDACTED_CREDENTIAL]","id":' || event_id || '},"key [REDACTED_API_KEY] end"]}' as record from events""")
def redacted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with credentials at several depths: in fields, lists and texts."""
    key = F.concat(F.lit("k"), F.col("user_id").cast("string"), F.lit("."), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 43))
    secret = F.struct(F.lit("Bearer x").alias("a"), F.col("value").alias("b"))
    note = F.concat(F.lit("authorization: Bearer t"), F.col("event_id").cast("string"), F.lit(" of "), "event_type")
    record = F.struct(F.col("user_id").alias("user"), F.struct(secret.alias("Authorization"), note.alias("note")).alias("headers"))
    calls = F.concat(F.lit(',"calls":[{"API_KEY":["a"],"id":'), F.col("event_id").cast("string"), F.lit('},"key '), key, F.lit(' end"]}'))
    text = F.concat(F.regexp_replace(F.to_json(record), r"\}$", ""), calls)
    return table(spark, sf_dir, "events").select("event_id", T.redacted_json(text).alias("record"))


@query()
def definition_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions in documents whose second word is marked as a defined term."""
    marked = F.regexp_replace("text", r"^(\S+) (\S+) ", "***$1*** means $2 ")
    kinds = {"definition_id": pa.string(), "term": pa.string(), "norm_term": pa.string(), "ord": pa.int64(), "body": pa.string()}
    d = table(spark, sf_dir, "documents").select("doc_id", marked.alias("text"))
    return mapped(d, "text", lambda t: extract.definitions("docs", "d", t), "definition_id string, term string, norm_term string, ord long, body string", kinds)


@query()
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and date of each page from its headings."""

    def one(h: str) -> list[dict]:
        title, when = extract.metadata("PAGE/x", html.headings(html.parse(h))[:6])
        return [{"title": title, "date": when}]

    return mapped(table(spark, sf_dir, "pages").select("page_id", "html"), "html", one, "title string, date string", {"title": pa.string(), "date": pa.string()})


@query("select n_name, case when regexp_matches(n_name, '^[A-Z]{2,6} \\d{4}/D?\\d+[A-Z0-9]*$') then 'ruling' when regexp_matches(h, '^.+ (Act|Regulations?|Rules?|Ordinance) (\\([^)]*\\) )?\\d{4}( .*)?$') then 'act' when trim(h) = '' then 'empty' else 'text' end as shape from (select n_name, case when n_nationkey % 3 = 0 then n_name || ' Act 1997' when n_nationkey % 3 = 1 then ' ' else lower(n_name) end as h from nation)")
def heading_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    h = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit(" Act 1997"))).when(F.col("n_nationkey") % 3 == 1, F.lit(" ")).otherwise(F.lower("n_name"))
    return n.select("n_name", extract.shape_col(h).alias("shape"))
