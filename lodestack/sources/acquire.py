"""What acquisition computes on data already fetched: filters, keys, hashes, listings and scans as Columns and joins.

Nothing here touches a network; pages, listings and API rows come as tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T

#: Endings of titles that name decisions out of use, and the renditions that can be read.
UNUSED_MARKERS = ("decision number not in use", "decision restricted")
RENDITIONS = {"epub": 0, "word": 1, "pdf": 2}
MISSING_PAGE = "Document could not be found"
#: Parts of a document id and the folder that holds such documents; the first that fits counts.
FOLDERS = (
    (("cm", "tr"), "Public_rulings"),
    (("ps",), "Practice_statements"),
    (("pba", "pbr"), "Edited_private_advice"),
    (("cr",), "Cases"),
    (("mt", "md", "lct", "ind"), "Public_rulings"),
    (("pak", "pal"), "Legislation_and_supporting_material"),
    (("scd", "scr"), "Cases"),
    (("otr", "ato"), "Public_rulings"),
)
#: Attributes that say nothing of a text.
BARE = ("style", "width", "height", "align", "valign", "bgcolor", "name", "data-icon", "cite", "on[a-zA-Z]+")
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s>]*))"""
LOW_TEXT = 128


# filters


def in_use(title: Column, restricted: Column) -> Column:
    """Decisions that may be shown: not restricted, and not marked as out of use by their title."""
    told = F.lower(T.collapse_ws(title))
    marked = reduce(lambda a, b: a | b, [F.contains(told, F.lit(m)) for m in UNUSED_MARKERS])
    return ~F.coalesce(restricted, F.lit(False)) & ~F.coalesce(marked, F.lit(False))


def not_repealed(flag: Column) -> Column:
    return F.coalesce(flag == "N", F.lit(False))


def rendition_rank(kind: Column, form: Column) -> Column:
    """The order of a primary rendition by its form, null if it can't be read."""
    of_form = F.create_map(*[F.lit(x) for pair in RENDITIONS.items() for x in pair])
    return F.when(F.lower(kind) == "primary", F.try_element_at(of_form, F.lower(form)))


def in_force(flag: Column, status: Column, publishable: Column) -> Column:
    return F.coalesce(flag & (status == "InForce") & publishable, F.lit(False))


def low_text(text: Column, images: Column, least: int = LOW_TEXT) -> Column:
    """Whether a text has too few letters and digits beside its images to stand without recognition."""
    return (F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")) < least) & (images > 0)


# links and ids


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in a tag's text: quoted either way or bare; null if there is none."""
    pattern = rf"(?is)\b{name}\s*=\s*{_VALUE}"
    return F.when(tag.rlike(pattern), F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)]))


def without_attributes(html: Column) -> Column:
    return F.regexp_replace(html, rf"(?is)\s+(?:{'|'.join(BARE)})\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)", "")


def query_value(url: Column, name: str) -> Column:
    """The first value of a parameter that isn't blank; names in either case; null if there is none."""
    found = F.regexp_extract(url, rf"(?i)[?&]{name}=\s*([^&#\s][^&#]*)", 1)
    return F.when(found != "", found)


def document_href(href: Column) -> Column:
    """The canonical link of a document where a link names one by ``docid``, else its path and query."""
    named = F.btrim(F.coalesce(query_value(href, "docid"), F.lit("")), F.lit("'\" "))
    rest = F.regexp_replace(F.regexp_replace(href, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    rest = F.when(rest.startswith("/") | (rest == ""), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(named != "", F.concat(F.lit("/law/view/document?docid="), _upper_parts(named))).otherwise(rest)


def _upper_parts(native: Column) -> Column:
    """The first two parts of an id in capitals."""
    parts = F.split(native, "/", -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i < 2, F.upper(x)).otherwise(x)), "/")


def node_id(href: Column, data_url: Column) -> Column:
    """A crawled node's id: its link, else the TOC parameter of its data address, else that address."""
    toc = F.regexp_extract(data_url, r"(?:^|[?&])TOC=([^&]*)", 1)
    decoded = F.try_url_decode(F.replace(toc, F.lit("+"), F.lit("%2B")))
    return F.coalesce(href, F.when(data_url.rlike(r"(?:^|[?&])TOC="), decoded), data_url)


def folder(canonical_id: Column) -> Column:
    low, out = F.lower(canonical_id), F.lit("Other")
    for parts, name in reversed(FOLDERS):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(f"docid={p}")) for p in parts]), name).otherwise(out)
    return out


def representative_path(canonical_id: Column, heading: Column, title: Column) -> Column:
    """Folder, heading and title of a document without a place in the tree; ``Other`` alone if no folder fits."""
    top = folder(canonical_id)
    some = F.filter(F.array(top, heading, title), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.when(top == "Other", F.array(F.lit("Other"))).otherwise(some)


def payload_path(parts: Column, canonical_id: Column, digest: Column) -> Column:
    """Where a payload lies below its root: slugs of the path, then the id's with the content's digest, so that no payload takes another's place."""
    folders = F.transform(parts, lambda p: T.slug(p, "node"))
    name = F.concat(T.slug(canonical_id, "link"), F.lit("-"), F.substring(digest, 1, 16), F.lit(".html"))
    return F.concat_ws("/", F.lit("payloads"), F.array_join(folders, "/"), name)


def payload_intact(size: Column, digest: Column, data: Column) -> Column:
    """Whether a payload is the one that was recorded."""
    return F.coalesce((F.octet_length(data) == size) & (F.sha2(data, 256) == digest), F.lit(False))


def upstream_version(*fields: Column, href: Column, canonical_id: Column) -> Column:
    """The first field that isn't blank, else the point in time named by the link, else by the id."""
    told = [F.when(F.trim(f) != "", F.trim(f)) for f in fields]
    return F.coalesce(*told, query_value(href, "pit"), query_value(canonical_id, "pit"))


def asset_id(document: Column, ordinal: Column) -> Column:
    return F.concat_ws("/", document, ordinal.cast("string"))


def plain_or_null(text: Column) -> Column:
    told = T.collapse_ws(text)
    return F.when(told != "", told)


# hashes


def _prefixed(field: Column) -> Column:
    """The length in eight bytes, least first, then the bytes."""
    data = F.coalesce(field.cast("binary"), F.lit("").cast("binary"))
    h = F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")
    return F.concat(F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])), data)


def content_hash(*fields: Column) -> Column:
    """Digest of fields, each after its length, so that no two lists of fields meet in one; null counts as empty."""
    return F.sha2(F.concat(*[_prefixed(f) for f in fields]), 256)


def normalised_hash(version: int, inventory: Column, html: Column, assets: Column) -> Column:
    """Digest of the versioned JSON form of a document, its assets in order."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), inventory.alias("inventory"), html.alias("html"), F.array_sort(assets).alias("assets"))), 256)


def revision_key(upstream: Column, entry: Column, normaliser: Column) -> Column:
    """``normalizer:REVISION|UPSTREAM|DIGEST``; without a normaliser the last two."""
    tail = F.concat_ws("|", upstream, F.sha2(F.to_json(entry), 256))
    return F.when(normaliser.isNull(), tail).otherwise(F.concat(F.lit("normalizer:"), normaliser, F.lit("|"), tail))


def fingerprint(rows: DataFrame, line: str, by: list[str]) -> DataFrame:
    """Count and order-free digest of the lines of each inventory; adds up before any shuffle.

    The sum of digests stands for the digest of the sorted lines, which would
    have to meet in one task.
    """
    part = F.conv(F.substring(F.sha2(F.col(line), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count("*").alias("records"), (F.sum(part) % F.lit(2305843009213693951).cast("decimal(38,0)")).cast("long").alias("digest"))


# decoding


def enum_name(value: Column, names: list[str]) -> Column:
    """A name given by its number or itself; null if it is neither."""
    by_number = F.get(F.array(*[F.lit(n) for n in names]), value.try_cast("int"))
    return F.when(value.rlike(r"^\d{1,4}$"), by_number).when(value.isin(names), value)


def canonical_time(c: Column) -> Column:
    """An ISO time without trailing zeros of its fraction, in UTC; null if there is no such time."""
    at = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,7})?(Z|[+-]\d{2}:\d{2})?$"), c)
    zoned = F.when(at.rlike(r"(Z|[+-]\d{2}:\d{2})$"), at).otherwise(F.concat(at, F.lit("Z")))
    parsed = F.try_to_timestamp(F.regexp_replace(zoned, r"(\.\d{6})\d", "$1"))
    return F.regexp_replace(F.regexp_replace(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"0+$", ""), r"\.$", "")


def epoch_millis(value: Column, fallback: Column) -> Column:
    """A number as it is (towards zero), else an ISO time in milliseconds, else the fallback so read."""

    def read(c: Column) -> Column:
        number = F.when(c.rlike(r"^-?\d+(\.\d+)?$"), F.split(c, r"\.")[0].try_cast("long"))
        iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"), F.unix_millis(F.try_to_timestamp(c)))
        return F.coalesce(number, iso)

    return F.coalesce(read(value), read(fallback))


def result_summary(payload: Column) -> Column:
    """One line on a tool's result: by the shape of its JSON, else its first line."""
    clean = F.trim(payload)
    kind = F.when(F.json_array_length(clean).isNotNull(), "array").when(F.json_object_keys(clean).isNotNull(), "object")
    size = lambda path: F.json_array_length(F.get_json_object(clean, path))
    title = F.get_json_object(clean, "$.hits[0].title")
    hits = F.concat(size("$.hits").cast("string"), F.lit(" search hit(s)"), F.when(title != "", F.concat(F.lit("; first: "), title)).otherwise(F.lit("")))
    counted = F.concat(F.lit("stats: "), F.get_json_object(clean, "$.documents"), F.lit(" documents; "), F.get_json_object(clean, "$.chunks"), F.lit(" chunks"))
    keys = F.concat(F.lit("JSON object: "), F.array_join(F.slice(F.json_object_keys(clean), 1, 8), ", "))
    line = F.trim(F.get(F.filter(F.split(clean, r"\n"), lambda x: F.trim(x) != ""), 0))
    first = F.concat(F.substring(line, 1, 220), F.when(F.length(line) > 220, F.lit("…")).otherwise(F.lit("")))
    return (
        F.when(clean == "", "Empty result")
        .when(kind == "array", F.concat(F.lit("JSON array with "), F.json_array_length(clean).cast("string"), F.lit(" item(s)")))
        .when((kind == "object") & size("$.hits").isNotNull(), hits)
        .when((kind == "object") & size("$.chunks").isNotNull(), F.concat(size("$.chunks").cast("string"), F.lit(" chunk(s) returned")))
        .when((kind == "object") & size("$.definitions").isNotNull(), F.concat(size("$.definitions").cast("string"), F.lit(" definition(s) returned")))
        .when((kind == "object") & F.get_json_object(clean, "$.documents").isNotNull() & F.get_json_object(clean, "$.chunks").isNotNull(), counted)
        .when(kind == "object", keys)
        .otherwise(first)
    )


def valid_from(previous_end: Column, main_html: Column) -> Column:
    """The day after the earlier version's end, else the digest of the text as its version."""
    return F.coalesce(F.date_add(F.try_to_date(previous_end, "yyyy-MM-dd"), 1).cast("string"), F.sha2(main_html, 256))


def published_on(html: Column) -> Column:
    """The day of a status page's link ``…/asmade/yyyymmdd`` or ``…/inforce/yyyymmdd``; null if there is no such day."""
    digits = F.regexp_extract(html, r"/(?:asmade|inforce|publication)/(\d{8})", 1)
    return F.date_format(F.try_to_date(F.when(digits != "", digits), "yyyyMMdd"), "yyyy-MM-dd")


def displayed_range(text: Column) -> Column:
    """first, last and total of ``Displaying 1 - 20 of 1,234 results``; null if the text isn't that."""
    pattern = r"^Displaying\s+([\d,]+)\s*-\s*([\d,]+)\s+of\s+([\d,]+)\s+results$"
    number = lambda g: F.replace(F.regexp_extract(text, pattern, g), F.lit(","), F.lit("")).try_cast("long")
    return F.when(text.rlike(pattern), F.struct(number(1).alias("first"), number(2).alias("last"), number(3).alias("total")))


def is_missing_page(html: Column, content: str = "judgment_content") -> Column:
    """A page without content that says there is no such document."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)", 1)
    has = html.rlike(rf"""(?is)<div[^>]*\bclass\s*=\s*["'][^"']*\b{content}\b""")
    return ~has & F.contains(F.regexp_replace(body, r"\s+", " "), F.lit(MISSING_PAGE))


# scans and joins


def alphabet(links: DataFrame, label: str, href: str, most: int = 32) -> DataFrame:
    """Index pages: links of a single letter, once each, in order; more than ``most`` is an error."""
    found = links.where(F.col(label).rlike("^[A-Za-z]$")).select(F.upper(label).alias("letter"), F.col(href).alias("href")).distinct()
    # a row more than is allowed at most, counted where the plan runs
    some = found.limit(most + 1).withColumn("__n", F.count("*").over(Window.partitionBy()))
    allowed = F.when(F.col("__n") > most, F.raise_error(F.lit(f"more than {most} index pages")).cast("boolean")).otherwise(F.lit(True))
    return some.where(allowed).drop("__n")


def united(*tables: DataFrame) -> DataFrame:
    """Rows of several tables by column name, once each."""
    return reduce(lambda a, b: a.unionByName(b), tables).distinct()


def titles_with_versions(titles: DataFrame, versions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Titles with their versions, and the titles that have none."""
    return titles.join(versions, key), titles.join(versions.select(key).distinct(), key, "left_anti")


def footnote_faults(links: DataFrame, targets: DataFrame, doc: str, name: str) -> DataFrame:
    """Links to footnotes (``#ftn…``) that no target of their document bears."""
    asked = links.where(F.col(name).startswith("#ftn")).select(doc, F.substring(F.col(name), F.lit(2), F.length(name)).alias("target")).distinct()
    return asked.join(targets.toDF(doc, "target").distinct(), [doc, "target"], "left_anti")


def length_batches(rows: DataFrame, tokens: str, digest: str, size: int = 64, bucket: int = 16) -> DataFrame:
    """Texts in batches of like length: sorted by tokens, then digest, within buckets of lengths; each batch in one bucket."""
    of = F.floor(F.col(tokens) / bucket).cast("long")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(tokens, digest)) - 1
    return rows.withColumn("bucket", of).withColumn("batch", F.floor(place / size).cast("long"))


def set_difference(supplied: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and which."""
    a, b = supplied.select(key).distinct(), registered.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("supplied")).unionByName(b.exceptAll(a).withColumn("side", F.lit("registered")))


def mean_pooled(rows: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """The mean of each key's unmasked vectors, component by component; zeros if all are masked."""
    spread = rows.select(key, F.col(mask).cast("double").alias("m"), F.posexplode(vector).alias("i", "x"))
    mean = F.sum(F.col("x") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-6))
    parts = spread.groupBy(key, "i").agg(mean.alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("pooled"))


def embedding_faults(rows: DataFrame, vector: str, dim: int, model: str, expected: str) -> DataFrame:
    """Each row's faults: wrong length, wrong model, parts that aren't finite."""
    finite = F.forall(F.coalesce(vector, F.array().cast("array<float>")), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = F.array(F.when(F.coalesce(F.size(vector) != dim, F.lit(True)), "length"), F.when(~F.col(model).eqNullSafe(F.lit(expected)), "model"), F.when(~finite, "finite"))
    return rows.withColumn("faults", F.filter(named, lambda x: x.isNotNull()))
