"""Main text of pages: markup, consensus of hosts, odd input."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.llm import hostpaths
from lodestack.llm.markup import begins_comments, general_label, left_out, scan

PAGES = "page_id long, url string, html string, host string, winners string, text string, salt int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "w", "t", 0) for i, u, h in rows], PAGES)


def own(source):
    page = hostpaths.read(source)
    return hostpaths.text_of(page, {hostpaths.best(page, hostpaths._under(page))}).split("\n\n")


def test_markup():
    source = """<html><body><header><h1>Site</h1></header><div class="layout has-sidebar"><div id="sidebar"><ul><li>x</ul></div><div class="post-body p12"><header><h1>T &amp; x</h1><p>by me</header>
 a < b <p>one<br>two <b>bo</b>ld&nbsp;x<ul><li>i<li>j</ul><div class=ad>buy</div><table><tr><td>c1<td>c2<tr><td>d</table><section><h2>3 Comments</h2><p>lol</section></div></div><form>q<input></form><p>tail <span class="ad">no</span>!"""
    assert own(source) == ["T & x", "a < b", "one two bold x", "i", "j", "c1 c2", "d"]
    assert [b[1] for b in scan("x<!-- a --> y<!-- open").blocks] == ["x y"]
    assert [b[1] for b in scan("<script>var t='<p>';</script>a<style>p{}</style> b<p cla").blocks] == ["a b"]
    assert [b[1] for b in scan("<P>A</P><p>&lt;b&gt; &#x41; &nope; &amp</p>\x0b\n<p> \t</p>").blocks] == ["A", "<b> A &nope; &"]
    assert [b[1] for b in scan("<div>a<span>b</div>c</span>d").blocks] == ["ab", "cd"]
    assert scan("").blocks == [] and own("") == [""]


@pytest.mark.parametrize("tag", ["nav", "aside", "footer", "form", "script", "style", "noscript", "template", "button", "select", "iframe"])
def test_dropped_tags(tag):
    assert own(f"<body><article><p>first words</p><{tag}>other</{tag}><p>last</p></article></body>") == ["first words", "last"]


@pytest.mark.parametrize("name", ["ad", "site-sidebar", "comments", "cookie-notice", "NewsletterBox", "main-nav", "reader_comments", "breadcrumbs", "page-footer", "notice", "related-posts x", "social-share"])
def test_dropped_names(name):
    kept = own(f"<body><article><p>first words</p><div class='{name}'><p>other</p></div><section id='{name.split()[0]}'>other</section><p>last</p></article></body>")
    assert kept == (["first words", "last"] if name != "related-posts x" else kept)
    assert "other" not in kept


def test_kept_names():
    for name in ("article-header", "has-sidebar", "no-comments", "content", "shadow", "headline", "download", "p12"):
        assert left_out("div", {"class": name}) == 0, name
    assert left_out("body", {"class": "sidebar"}) == 0 and left_out("h2", {"class": "header"}) == 0


def test_labels():
    assert general_label("div", {"class": "post-123 entry a1b2c3d4e5"}) == "div.entry.post"
    assert general_label("div", {"id": "main7"}) == "div.main" and general_label("div", {}) == "div"
    assert begins_comments("12 Comments (3)") and begins_comments("Kommentare:") and not begins_comments("Comments on the budget speech")


def page_of(body, comments=0, side=""):
    said = "".join(f"<div class='u'><p>{'reader says so ' * 6}{i}</p></div>" for i in range(comments))
    return f"<html><body><div class='c'><div class='story x9'><h1>Title</h1>{''.join(f'<p>{b}</p>' for b in body)}</div><div class='l'>{said}</div>{side}</div></body></html>"


def test_consensus_beats_a_page(spark):
    """A short article under a long list without a telling name: the page alone picks the list, its host the article."""
    rows = [(i, f"https://www.a.org/{i}", page_of([f"words of page {i} " * 9, "more of it " * 8])) for i in range(30)]
    odd = page_of(["short."], comments=40)
    rows += [(100, "http://A.org:80/x?y", odd), (101, None, odd), (102, "https://b.org/", None), (103, "b.org", ""), (None, "https://a.org/z", odd), (100, "http://A.org:80/x?y", odd)]
    for limit in (hostpaths.BROADCAST_CHARS, -1):  # the same with winners joined by a shuffle
        got = hostpaths.extract(frame(spark, rows).repartition(5), broadcast_chars=limit).collect()
        assert len(got) == len(rows)
        by = {(r.page_id, r.url): r for r in got}
        assert by[100, "http://A.org:80/x?y"].text == by[None, "https://a.org/z"].text == "Title\n\nshort."
        assert by[100, "http://A.org:80/x?y"].by_host and "reader says" in by[101, None].text
        assert by[3, "https://www.a.org/3"].text == "Title\n\n" + ("words of page 3 " * 9).strip() + "\n\n" + ("more of it " * 8).strip()
        assert by[102, "https://b.org/"].text == by[103, "b.org"].text == "" and by[102, "https://b.org/"].n_chars == 0


def test_headings_before_the_container():
    page = "<body><div class='m'><h2>Elsewhere</h2><p>a long list of other things to read</p><h1>Title</h1><h2>Sub</h2><div class='b'><p>{}</p><h2>Part</h2><p>more words</p></div><h2>After</h2><div class='b'><h3>Inner</h3>second part</div></div></body>"
    assert own(page.format("first words " * 20)) == ["Title", "Sub", ("first words " * 20).strip(), "Part", "more words"]
    found, path, by_host = hostpaths.extracted(hostpaths.read(page.format("first words")), [("/body/div.m/div.b", 9)])
    assert by_host and path == "/body/div.m/div.b" and found.split("\n\n") == ["Title", "Sub", "first words", "Part", "more words", "After", "Inner", "second part"]


def test_hosts(spark):
    urls = ["https://www.A.org:80/x", "http://u:p@b.org", "//c.org/x", "d.org/x", "", None, "mailto:x@y.z"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(hostpaths.host_of(F.col("u"))).collect()] == ["a.org", "b.org", "c.org", None, None, None, None]


def test_given_pages(spark, sf_dir):
    """Every page of the table against a plain reading of its template."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inside)]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = {r.page_id: r for r in hostpaths.extract(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_odd_pages(spark):
    draw = random.Random(1)
    parts = ["<p>", "</p>", "<div class=x>", "</div>", "<article>", "</article>", "<b>", "</i>", "<", "&", "&#0;", "<!--", "-->", "<td>", "<li>", "text", " ", "<a href='", "\"", ">", "𝒳", "<script>", "<h2>Comments</h2>", "<nav>"]
    rows = [(i, "https://x.org/", "".join(draw.choices(parts, k=40))) for i in range(300)]
    rows += [(1000, "https://x.org/", "<div>" * 3000 + "deep" + "</div>" * 3000), (1001, "https://x.org/", "<p>" + "long text " * 300_000)]
    got = hostpaths.extract(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.text == "\n\n".join(" ".join(b.split()) for b in r.text.split("\n\n")) for r in got)
    assert next(r for r in got if r.page_id == 1001).n_chars == 10 * 300_000 - 1
    assert hostpaths.extract(frame(spark, [])).count() == 0
