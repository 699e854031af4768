"""Main text of web pages by consensus among the pages of a host.

1. Each page is scanned (Arrow batches, ``markup.scan``); each of its
   containers is scored by the characters outside links that it holds, those of
   deeper containers counting half a level. The page proposes its best one by
   its path: tags and generalised classes from the page's root.
2. Spark counts proposals by host and path. A path that a twentieth of a
   host's pages propose is one of its winners, so a host has twenty at most.
3. Each page is scanned again and the winning paths are tried on it. Of those
   that match, the most voted one wins and those with at least half its votes
   (other templates of the host) may beat it by their score here; all elements
   with that path are the article, and so are the headings right before them. A
   page that no winner matches, or whose host
   is unknown, keeps its own best container.

A long list of comments, or an advert longer than a short article, wins on its
own page, but not among the pages of its host.

The winners are broadcast if their counted characters are few; beyond that they
are joined by a shuffle, dealt out by host and a salt, so that a host with a
third of all pages is spread over ``SALTS`` tasks.

Null html counts as empty; a page without text gives an empty text. Null urls
and urls without a host have no consensus. Ids may be null or repeated, rows
may be equal: each gives a row. Ties between paths go to the first by code
point, between containers to the first on the page. Broken markup is read as
browsers do in the main: unclosed elements end with what holds them, a page cut
within a tag ends before it. Where names alone would leave nothing of a page,
only tags decide. Other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lodestack.llm.common import cut, require
from lodestack.llm.markup import Page, begins_comments, scan

#: A path with at least one in so many of a host's votes is a winner.
SHARE = 20
#: Of two winners that match a page, the less voted one is a rival if it has one in so many of the other's votes.
RIVAL = 2
#: Characters of all winners together that may be broadcast.
BROADCAST_CHARS = 4_000_000
#: Parts a host is dealt out in where the winners are too many for that.
SALTS = 32
#: Levels above a block's container that its characters count for, half as much with each.
LEVELS = 3


def host_of(url: Column) -> Column:
    """Lower-cased host of a url, without user and port and a leading ``www.``; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:\s]+)", 1)
    return F.when(found != "", found)


def read(source: str) -> Page:
    page = scan(source)
    return page if page.blocks else scan(source, by_name=False)


def _under(page: Page) -> list[float]:
    """Score of each container."""
    score = [0.0] * len(page.parent)
    for c, text, linked, heading in page.blocks:
        worth = float(len(text) - linked) if not heading else 0.0
        for _ in range(LEVELS + 1):
            if c < 0:
                break
            score[c] += worth
            c, worth = page.parent[c], worth / 2
    return score


def _article(page: Page, c: int) -> int:
    """The article element around a container, else the container."""
    up = c
    while up > 0 and page.tag[up] != "article":
        up = page.parent[up]
    return up if up > 0 else c


def best(page: Page, score: list[float]) -> int:
    """The container that the page itself would choose; the whole page where nothing is scored."""
    top = max(score)
    return _article(page, score.index(top)) if top > 0 else 0


def text_of(page: Page, roots: set[int]) -> str:
    """Blocks within ``roots``, and the headings right before each of them in what holds it; without a part that a heading calls reader comments."""
    root, ended = [-1] * len(page.parent), [False] * len(page.parent)
    for c in range(len(page.parent)):  # parents come before their children
        root[c] = c if c in roots and (c == 0 or root[page.parent[c]] < 0) else root[page.parent[c]] if c else -1
    found: list[str] = []
    before: list[tuple[int, str]] = []
    begun: set[int] = set()
    for c, text, _, heading in page.blocks:
        r = root[c]
        if r < 0:
            before = [*before, (c, text)] if heading else []
            continue
        if r not in begun:
            begun.add(r)
            found += [x for at, x in before if at == page.parent[r]]
        before = []
        if heading and c not in roots and begins_comments(text):
            ended[c] = True
        up = c
        while up > 0 and not ended[up]:
            up = page.parent[up]
        if not ended[up]:
            found.append(text)
    return "\n\n".join(found)


def extracted(page: Page, winners: list[tuple[str, int]]) -> tuple[str, str, bool]:
    """(text, path, whether the host's consensus decided)."""
    score = _under(page)
    votes, chosen = dict(winners), {}
    for c, path in enumerate(page.path):
        if path in votes:
            chosen.setdefault(path, []).append(c)
    if chosen:
        most = max(votes[p] for p in chosen)
        path = min((p for p in chosen if votes[p] * RIVAL >= most), key=lambda p: (-sum(score[c] for c in chosen[p]), -votes[p], p))
        text = text_of(page, set(chosen[path]))
        if text:
            return text, path, True
    c = best(page, score)
    return text_of(page, {c}), page.path[c], False


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths = []
        for source in b.column(1):
            page = read(source.as_py() or "")
            score = _under(page)
            paths.append(page.path[best(page, score)] if max(score) > 0 else None)
        yield pa.record_batch([b.column(0), pa.array(paths, pa.string())], names=["host", "path"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        told = []
        for source, winners in zip(b.column(b.schema.get_field_index("html")), b.column(b.schema.get_field_index("winners")), strict=True):
            text, path, by_host = extracted(read(source.as_py() or ""), [(w["path"], w["votes"]) for w in winners.as_py() or []])
            told.append((text, len(text), path, int(by_host)))
        columns = [pa.array([t[i] for t in told], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.int32()))]
        yield pa.record_batch([b.column(b.schema.get_field_index("page_id")), b.column(b.schema.get_field_index("url")), *columns], names=["page_id", "url", "text", "n_chars", "path", "by_host"])


def consensus(pages: DataFrame) -> DataFrame:
    """(host, winners): each host's paths with a twentieth of its votes or more, the most voted first."""
    votes = pages.where(F.col("host").isNotNull()).select("host", "html").mapInArrow(_propose, "host string, path string")
    counted = cut(votes.where(F.col("path").isNotNull()).groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes")), "votes")
    whole = counted.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    kept = counted.join(whole, "host").where(F.col("votes") * SHARE >= F.col("all_votes"))
    return kept.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path", "votes"))).alias("winners"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """page_id, url, text, n_chars, the path that was used and whether the host's consensus chose it (1) or the page (0)."""
    require(pages, page_id, url, html)
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    winners = cut(consensus(own), "winners")
    chars = winners.agg(F.sum(F.aggregate("winners", F.length("host").cast("long"), lambda a, w: a + F.length(w["path"]) + 16))).first()[0] or 0
    if chars <= broadcast_chars:
        joined = own.join(F.broadcast(winners), "host", "left")
    else:
        dealt = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"], "left")
    kind = StructType([StructField("page_id", own.schema["page_id"].dataType), StructField("url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType()), StructField("path", StringType()), StructField("by_host", IntegerType())])
    return joined.select("page_id", "url", "html", "winners").mapInArrow(_extract, kind)
