"""Inventories with quarantine, listings in SQL, registers, numbers in an order, damaged and secret text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import html
from lodestack.functions import text as T
from lodestack.ident import DocumentId
from lodestack.operators import order, stored
from lodestack.sources import listings, quarantine, register

GOOD = {"native_id": "a", "upstream_version": "1", "title": "T", "document_type": "act", "date": "2020-02-29", "canonical_url": "https://x.org/a", "renditions": [{"url": "https://x.org/r", "kind": "html"}]}


@pytest.fixture(scope="module")
def inventory(spark, tmp_path_factory):
    def run(lines, **options):
        path = tmp_path_factory.mktemp("inv")
        (path / "a.jsonl").write_bytes(b"\n".join(x if isinstance(x, bytes) else json.dumps(x).encode() for x in lines) + b"\n")
        sound, bad = quarantine.read(spark, str(path), rules=quarantine.discovery_rules(["x.org"]), **options)
        return sorted(r.native_id for r in sound.collect()), {r.line[:40]: r.reasons for r in bad.collect()}, (sound, bad)

    return run


def test_quarantine(inventory):
    but = lambda i, **x: {**GOOD, "native_id": i, **x}
    lines = [
        GOOD, b"", b"  \r", json.dumps(but("crlf")).encode() + b"\r", but("undated", date=None), b'{"native_id": "cut', b"[1]", b'{"native_id": "\xff"}',
        but("t1", title=" x"), but("t2", title=None), but("t3", title="a\u0000b"), but("d1", date="2021-02-29"), but("u1", canonical_url="http://x.org/a"), but("u2", canonical_url="https://u:p@x.org/a"),
        but("u3", canonical_url="https://x.org:8080/a"), but("u4", canonical_url="https://y.org/a"), but("r1", renditions=[]), but("r2", renditions=[{"url": "https://y.org/r", "kind": "html"}]), but("twice"), but("twice", title="U"), but("v" * 300),
    ]
    sound, bad, frames = inventory(lines)
    assert sound == ["a", "crlf", "undated"]
    reasons = [r for v in bad.values() for r in v]
    for want in ("line: no JSON of this schema", "line: no UTF-8", "title: white space around it", "title: missing", "title: control characters", "date: no day", "canonical_url: not https", "canonical_url: credentials", "canonical_url: port", "canonical_url: another host", "renditions: none", "renditions: a bad url", "native_id: repeated", "native_id: longer than 256 bytes"):
        assert want in reasons, want
    told = quarantine.contract(*frames)
    assert told["documents"] == 3 and told["native_id: repeated"] == 2 and told["line: no JSON of this schema"] == 2
    with pytest.raises(ValueError, match="refused lines"):
        quarantine.require(*frames)


def test_quarantine_bounds(inventory):
    with pytest.raises(stored.StoredError, match="allowed"):
        inventory([GOOD], max_bytes=10)
    assert list(inventory([GOOD], max_line=20)[1].values()) == [["line: too long"]]
    sound, bad, frames = inventory([b""])
    assert (sound, bad) == ([], {})
    with pytest.raises(ValueError, match="no authoritative"):
        quarantine.require(*frames)


def test_field_rules(spark):
    rules = lambda v: [*quarantine.path_faults(F.col("p"), "p"), *quarantine.media_type_faults(F.col("m"), "m"), *quarantine.digest_faults(F.col("d"), "d"), *quarantine.html_faults(F.col("h"), "h")]  # noqa: E731, ARG005
    sound = ("a/b.html", 'text/html; charset="utf-8"', "0" * 64, "<p>on the <b>one</b> = two</p>")
    cases = {
        ("/a",): "p: absolute", ("C:/a",): "p: absolute", ("a\\b",): "p: backslash", ("a/../b",): "p: parts", ("a//b",): "p: parts", ("a/.",): "p: parts",
        (None, "texthtml"): "m: no media type", (None, None, "A" * 64): "d: no sha256", (None, None, None, "<IFRAME src=x>"): "h: active element", (None, None, None, "<b onload=x>"): "h: event handler", (None, None, None, "<a href='JavaScript:x'>"): "h: script URL",
    }
    rows = [sound, *[tuple((c[i] if i < len(c) and c[i] is not None else sound[i]) for i in range(4)) for c in cases]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, p string, m string, d string, h string")
    got = [r.f for r in df.select("k", quarantine.reasons(rules(None)).alias("f")).orderBy("k").collect()]
    assert got[0] == [] and [g for g in got[1:]] == [[w] for w in cases.values()]


def test_listings(spark):
    page = """<nav><a href="/law/view/document?docid=0">no</a></nav><article><h1>x</h1><a href='/law/view/document?docid=1'>One &amp; <i>more</i></a><h2> News </h2>
    <A class=x HREF="https://www.ato.gov.au/law/view/document?docid=2"></A><a href=/law/view/document?docid=1>again</a><h3></h3><a href="other">o</a><a name=y>z</a><a href="/law/view/document?docid=3">T<!-- c --></a></article>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>no article</p>")], "k int, html string")
    strip = lambda c: F.regexp_replace(c, "^https://www.ato.gov.au", "")
    got = listings.feed(df, "k", "html", "https://www.ato.gov.au/", strip, "/law/view/document").orderBy("place").collect()
    assert [(r.href[-1], r.title, r.heading) for r in got] == [("1", "One & more", "x"), ("2", "/law/view/document?docid=2", "News"), ("3", "T", None)]


def test_register(spark, tmp_path):
    docs = spark.createDataFrame([("a", "https://r/a", "A", '<a href="https://r/b#x">b</a>'), ("b", "https://r/b", "B", None)], "native_id string, canonical_url string, title string, html string")
    register.write(docs, "reg", str(tmp_path / "r"))
    got = {r.native_id: (r.html, r.fault) for r in register.read(spark, str(tmp_path / "r"), "reg").collect()}
    assert got == {"a": ('<a href="doc:b#x">b</a>', None), "b": (None, None)}
    assert {r.fault for r in register.read(spark, str(tmp_path / "r"), "other").collect()} == {"document of another source"}
    with pytest.raises(stored.StoredError, match="committed"):
        register.read(spark, str(tmp_path / "none"), "reg")
    (tmp_path / "r/inventory/more.json").write_text('{"native_id":"c","payload_hash":"0","canonical_url":"u"}\n')
    with pytest.raises(stored.StoredError, match="3 of 2"):
        register.read(spark, str(tmp_path / "r"), "reg")


def test_numbers(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["a", "b", None]), draw.randint(0, 20), i) for i in range(300)]
    got = order.numbered(spark.createDataFrame(rows, "g string, v int, i int").repartition(7), ["g"], ["v", "i"]).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.row_no)
        assert [r.row_no for r in mine] == list(range(len(mine))) and [(r.v, r.i) for r in mine] == sorted((v, i) for x, v, i in rows if x == g)
    n = F.col("n")
    ranks = {r.g: (r.low, r.high) for r in order.at_ranks(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], "v", {"low": F.lit(1), "high": F.ceil(n * 0.9)}).collect()}
    for g in ("a", "b"):
        mine = sorted(v for x, v, _ in rows if x == g)
        assert ranks[g] == (mine[0], mine[-(-9 * len(mine) // 10) - 1])
    assert order.numbered(spark.createDataFrame([], "g string, v int"), [], ["v"]).count() == 0


def test_damage(spark):
    cases = [(None, "empty"), (" -- ", "empty"), ("fine text", None), ("it\u00e2\u20acs", "encoding"), ("x \ufffd", "encoding"), (" ".join("abcdefgh" * 4), "glyphs"), (" ".join("abcdefg") + " word", None), (" ".join("a" * 30) + " " + "longer " * 40, None), (" ".join("a" * 120) + " " + "longer " * 300, "glyphs"), ("1 2 3 4 5 6 7 8 9 " * 9, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r.d for r in df.select("i", T.text_damage(F.col("t")).alias("d")).orderBy("i").collect()] == [w for _, w in cases]


def test_redaction(spark):
    key = "k1." + "A" * 43
    cases = [(None, None), ("no json " + key, "no json [REDACTED_API_KEY]"), ('{"a":[{"X-Api-Key":{"b":1}},"Authorization: Bearer abc"],"n":1.5}', '{"a":[{"X-Api-Key":"[REDACTED_CREDENTIAL]"},"Authorization: Bearer [REDACTED_TOKEN]"],"n":1.5}'), ('"é"', '"é"')]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r.t for r in df.select("i", T.redacted_json(F.col("t")).alias("t")).orderBy("i").collect()] == [w for _, w in cases]


def test_anchors_of_rewritten_links():
    name = lambda n: str(DocumentId("ato", n))
    page = f'<a data-doc-id="{name("PAC/1/2")}">Sister</a><a data-doc-id="{name("PAC/1/2")}" data-pit="20200101000000">Then</a><a data-doc-id="{name("OWN/1")}">self</a><a data-doc-id="bad">x</a><a href="#s">in</a><p id="s">x</p>'
    assert [(a["kind"], a["target"], a["pit"]) for a in html.anchors(page, "OWN/1")] == [("sister", "PAC/1/2", None), ("history", "PAC/1/2", "20200101000000"), ("in_doc", "s", None)]
