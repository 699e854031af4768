"""Listing pages and feeds read by Spark SQL: a page becomes a sequence of pieces, and windows over it give what each piece stands under.

Nothing is parsed to a tree. A page's pieces (headings, links, elements of a
class) are matched in order and exploded with their places; a link's heading is
the last one before it, and of links with one canonical target the first holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADINGS = r"<h[1-5](?:\s[^>]*)?>.*?</h[1-5]\s*>"
LINKS = r"<a\s[^>]*>.*?</a\s*>"
#: Named character references that listings use; numeric ones are decoded by their numbers.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&amp;": "&"}


def text_of(markup: Column) -> Column:
    """Text without tags and comments, character references decoded, white space in single spaces."""
    out = F.regexp_replace(F.regexp_replace(markup, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[\s ]+", " "))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag, null if it has none."""
    found = F.regexp_extract_all(tag, F.lit(rf"""(?i)^<[^>]*?\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""), F.lit(0))
    value = F.regexp_replace(F.get(found, F.lit(0)), rf"""(?is)^<[^>]*?\s{name}\s*=\s*""", "")
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def absolute(href: Column, base: str) -> Column:
    stem = base.rstrip("/")
    return F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(F.lit(stem), href)).otherwise(F.concat(F.lit(stem + "/"), href))


def part(html: Column, tag: str) -> Column:
    """The first element of a kind, without those of its kind within; empty if there is none."""
    return F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", 0)


def pieces(pages: DataFrame, key: str, html: Column, *patterns: str) -> DataFrame:
    """(key, place, piece): what matches any pattern, in page order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)" + "|".join(patterns)), F.lit(0))
    return pages.select(key, F.posexplode(found).alias("place", "piece"))


def feed(pages: DataFrame, key: str, html: str, base: str, canonical, prefix: str = "") -> DataFrame:
    """(key, place, href, title, heading) of the links in a page's article: under the last heading before them, each target once.

    ``canonical`` makes the one form of a link; only those that begin with
    ``prefix`` count. A link without text is titled by its target; an empty
    heading is none.
    """
    each = pieces(pages, key, part(F.col(html), "article"), HEADINGS, LINKS)
    is_link = F.lower(F.substring("piece", 1, 2)) == "<a"
    # an empty heading ends the one before it, so the last piece that is a heading counts, not the last with a text
    head = F.when(~is_link, F.struct(F.nullif(text_of(F.col("piece")), F.lit("")).alias("text")))
    carried = F.last(head, ignorenulls=True).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    links = each.withColumn("heading", carried["text"]).where(is_link).withColumn("raw", attribute(F.col("piece"), "href")).where("raw is not null")
    told = links.withColumn("href", canonical(absolute(F.col("raw"), base))).where(F.col("href").startswith(prefix))
    first = told.withColumn("__n", F.row_number().over(Window.partitionBy(key, "href").orderBy("place"))).where("__n = 1")
    title = text_of(F.col("piece"))
    return first.select(key, "place", "href", F.when(title == "", F.col("href")).otherwise(title).alias("title"), "heading")


def field(row: Column, class_name: str) -> Column:
    """Text of the first element of a class within a row, null if there is none."""
    found = F.regexp_extract(row, rf"""(?is)<(\w+)\s[^>]*class\s*=\s*["'](?:[^"']*\s)?{class_name}(?:\s[^"']*)?["'][^>]*>(.*?)</\1\s*>""", 2)
    return F.nullif(text_of(found), F.lit(""))


def rows_of_class(pages: DataFrame, key: str, html: str, tag: str, class_name: str) -> DataFrame:
    """(key, place, piece): a listing's rows, elements of one tag and class that hold none of their tag."""
    pattern = rf"""<{tag}\s[^>]*class\s*=\s*["'](?:[^"']*\s)?{class_name}(?:\s[^"']*)?["'][^>]*>.*?</{tag}\s*>"""
    return pieces(pages, key, F.col(html), pattern)


def decisions(pages: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """Rows of a court's listing: url, title, citation, date, native_id, and the digest that tells a change.

    A row without link or title, or without citation where its path isn't that
    of an unreported decision, is a fault, not a document: see ``fault``.
    """
    rows = rows_of_class(pages, key, html, "a", "views-row-item-judgement")
    told = rows.select(
        key,
        "place",
        absolute(attribute(F.col("piece"), "href"), base).alias("url"),
        # titles are escaped twice
        F.nullif(text_of(field(F.col("piece"), "field--title")), F.lit("")).alias("title"),
        F.nullif(F.trim(F.regexp_extract(field(F.col("piece"), "field--citation"), r"^Citation:\s*(.*)$", 1)), F.lit("")).alias("citation"),
        F.try_to_date(F.trim(F.regexp_replace(field(F.col("piece"), "field--hca-date-issued"), "^Date:", "")), "d MMM yyyy").alias("date"),
    )
    slug = F.nullif(F.regexp_extract("url", r"/unreported-judgments/([^/?#]+)$", 1), F.lit(""))
    native = F.coalesce(F.concat(F.lit("unreported/"), slug), F.col("citation"))
    fault = F.when(F.col("url").isNull(), "no link").when(F.col("title").isNull(), "no title").when(native.isNull(), "no identity")
    version = F.sha2(F.concat_ws("\n", "url", F.coalesce("title", F.lit("")), F.coalesce("citation", F.lit("")), F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit(""))), 256)
    return told.select("*", native.alias("native_id"), version.alias("upstream_version"), fault.alias("fault"))
