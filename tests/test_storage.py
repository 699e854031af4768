"""Generations, streams, readers and chunks."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack import schema
from lodestack.functions import chunking, extract, html
from lodestack.operators import incremental as inc
from lodestack.plans.generation import Manifest, Store
from lodestack.sources import readers
from lodestack.streaming import streams


def tables(spark, title="T"):
    return {
        "sources": spark.createDataFrame([("ato", "Office")], schema.SOURCES),
        "documents": spark.createDataFrame([("ato", "PAC/1", "PAC", title, "2020-01-01", "https://x.org/1", None, None, None, None, None, None, None, False, False, False, "h")], schema.DOCUMENTS),
        "chunks": spark.createDataFrame([(1, "ato", "PAC/1", 0, None, "text")], schema.CHUNKS),
        "chunk_embeddings": spark.createDataFrame([(1, [1, 2])], schema.CHUNK_EMBEDDINGS),
    }


def test_generation_lifecycle(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/corpus")
    one = store.build(tables(spark))
    two = store.build(tables(spark, "Other"))
    assert one != two and store.build(tables(spark)) == one
    assert store.verify(one) == []
    store.activate(one)
    store.activate(two)
    assert store.active() == two and store.rollback() == one
    assert not store.deactivate(two)
    assert store.prune(0) == [two]
    with pytest.raises(ValueError):
        Manifest.loads('{"version": 12, "sources": [], "tables": {}, "odd": 1}')
    bad = tables(spark) | {"chunks": spark.createDataFrame([(1, "ato", "GONE", 0, None, "t")], schema.CHUNKS)}
    with pytest.raises(ValueError, match="without documents"):
        store.build(bad)


def test_streams(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    stream = streams.read_stream(spark, f"{tmp_path}/in", ddl).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.drained(streams.replayed(stream, "ts", ["event_id"], "3650 days"), f"{tmp_path}/c1", f"{tmp_path}/o1")
    assert spark.read.parquet(f"{tmp_path}/o1").count() == e.count()
    seen = []
    q = streams.upserting(streams.read_stream(spark, f"{tmp_path}/in", ddl), lambda df, n: seen.append(df.count()), f"{tmp_path}/c2")
    q.awaitTermination()
    assert sum(seen) == e.count()


def test_aimd():
    state = (4, 0, 64, False)
    for _ in range(4):
        state = inc.aimd_step(state, True)
    assert state[0] == 5
    state = inc.aimd_step(state, False)
    assert (state[0], state[2]) == (2, 4)
    assert inc.aimd_step(state, False)[2] == 4


def test_log_compaction(spark):
    log = spark.createDataFrame([("a", 1, 200), ("a", 2, 500), ("b", 1, 200), ("b", 2, 404), ("c", 1, 500)], "k string, line int, status int")
    got = inc.compact_log(log, "k", "line", F.col("status") == 200, F.col("status") == 404).collect()
    assert [(r.k, r.line) for r in got] == [("a", 1)]


def test_inventory(spark, tmp_path):
    path = tmp_path / "inv"
    rows = spark.createDataFrame([("ato", "b", "PAC", "B", None, "https://x.org/b", None, "0" * 64, None, None), ("ato", "a", "PAC", "A", None, "https://x.org/a", None, "0" * 64, None, None)], readers.INVENTORY)
    readers.write_inventory(rows, str(path))
    back = readers.read_inventory(spark, str(path))
    assert {r.native_id for r in back.collect()} == {"a", "b"}
    readers.write_inventory(rows.union(rows), str(path))
    with pytest.raises(ValueError, match="duplicate"):
        readers.read_inventory(spark, str(path))
    good, bad = schema.accepted(rows.union(spark.createDataFrame([("BAD", "x", "P", " ", "2020-02-31", "http://x", None, "z", None, None)], readers.INVENTORY)), schema.inventory_rules())
    assert good.count() == 2 and set(bad.first().faults) == {"source_id", "title", "canonical_url", "content_hash", "date"}


def test_dictionary_and_wordnet(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("Cat\tan animal\ncat\tanother\n")
    got = readers.read_dictionary(spark, str(tmp_path / "d.tsv"), most=1).collect()
    assert [(r.norm, r.definition) for r in got] == [("cat", "an animal")]
    line = "00001740 03 n 02 big_entity 0 thing 0 001 ~ 00001930 n 0000 | that which is"
    rows = readers.read_wordnet(spark.createDataFrame([(line,), ("  note",)], "value string"), "n").collect()
    assert {(r.norm, r.gloss) for r in rows} == {("big entity", "that which is"), ("thing", "that which is")}


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_epub_and_docx():
    epub = archive({
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
        "o/p.opf": '<package><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>',
        "o/a.xhtml": "<html><body><p>A</p></body></html>",
        "o/b.xhtml": '<html><body><p><a href="a.xhtml">B</a></p></body></html>',
    })
    assert readers.epub_html(epub) == '<article><section id="part-0"><p><a href="#part-1">B</a></p></section><section id="part-1"><p>A</p></section></article>'
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = archive({
        "word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>One</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r></w:p></w:body></w:document>',
        "word/footnotes.xml": f'<w:footnotes {w}><w:footnote w:id="2"><w:p><w:r><w:t>Note</w:t></w:r></w:p></w:footnote></w:footnotes>',
    })
    assert readers.docx_html(docx) == '<article><h1>Title</h1><p>1. One<sup><a href="#fn1">1</a></sup></p><p id="fn1">1. Note</p></article>'
    with pytest.raises(ValueError):
        readers.archive_entries(archive({"../x": "y"}))
    assert [readers.ordinal_label(n, s) for n, s in ((4, "lowerRoman"), (28, "upperLetter"), (22, "ordinal"), (7, "decimal"))] == ["iv", "BB", "22nd", "7"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc .", min_size=1, max_size=80), max_size=20), st.integers(2, 40))
def test_chunks_keep_all_words_within_the_budget(texts, budget):
    blocks = [chunking.Block("p", " ".join(t.split())) for t in texts if t.split()]
    packed = chunking.pack(blocks, budget)
    assert " ".join(b.text for b in packed).split() == " ".join(b.text for b in blocks).split()
    assert all(chunking.approx_tokens(b.text) <= max(budget, 2) for b in packed)


def test_html_and_metadata():
    page = '<body><nav>x</nav><h2 id="H1">Intro</h2><p><b><i>car</i></b> means <a href="/law/view/document?docid=pac/1997/995-1">x</a><p>two <a href="#H1">up</a></body>'
    _, text, _ = html.cleaned(page)
    assert text == "## [anchor:H1]Intro\n\n***car*** means x [doc:ato:PAC/1997/995-1]\n\ntwo up"
    assert [a["kind"] for a in html.anchors(page, "X")] == ["sister", "in_doc"]
    assert extract.metadata("TXR/TR20243/NAT/ATO/00001", ["Taxation Ruling", "TR 2024/3", "R&D tax incentive eligibility"]) == ("TR 2024/3 — R&D tax incentive eligibility", "2024-01-01")
    assert extract.metadata("PAC/19970038/995-1", ["Income Tax Assessment Act 1997"]) == ("Income Tax Assessment Act 1997 s 995-1", "1997-01-01")
    assert extract.metadata("XYZ/abc/def", []) == ("XYZ abc def", None)
    assert extract.currency("", "This Ruling was withdrawn on 3 May 2020.", "")[0] == "2020-05-03"
    assert extract.rewritten("[doc:ato:A pit=20200101] [doc:ato:B]", ("ato", "C"), {("ato", "B")}) == "[fetch:legal://ato/A?pit=20200101] [doc:ato:B]"
    assert extract.pit_to_date("20200230") is None and extract.precise_date("on 31 February 2020") == "2020-02-31"


def test_anchors_links_and_images():
    link = "/law/view/document?docid=TXR/TR20013/NAT"
    page = f"""<table><tr><td>Addendum</td><td><a href="{link}&PiT=20200102000000">changed</a></td></tr><tr><td><a href="{link}&PiT=99991231235958">now</a></td></tr></table><a href="#x">in</a><a href="#nowhere">out</a><p id="x">t</p>"""
    rows = [(r["kind"], r["label"], r["pit"]) for r in html.anchors(page, "A/B")]
    assert rows == [("history", "Addendum changed (2020-01-02)", "20200102000000"), ("sister", "now", None), ("in_doc", "in", None)]
    assert html.linked(f'<a class="k" href="{link}&PiT=20200102000000">x</a><a href="javascript:go()">y</a><a href="/z">z</a>').count("href") == 1
    out, assets = html.pictured('<p><img src="a.png" alt=" A  b "><img alt="Exclamation" src="w.gif"><img src=c.png></p>', "D/1")
    assert out == '<p><span data-asset-ref="D/1/0">A b</span><span data-asset-ref="D/1/1"></span></p>' and [a["src"] for a in assets] == ["a.png", "c.png"]
    front = '<div id="Lawfront"><div class="ref"><strong>Bill 2001</strong></div><p><strong>Explanatory Memorandum</strong></p></div>'
    assert html.front_matter(front) == (["Bill 2001"], "Explanatory Memorandum") and html.front_matter("<p>x</p>") == ([], None)
    assert html.law_contents("<main><article><p>a</p>b</article></main>") == '<div id="lawContents"><p>a</p>b</div>'
    rows = '<tr><td class="date">1 May 2001</td><td>Issued</td></tr><tr><td class="date">2 June 2003</td><td>Withdrawn</td></tr>'
    assert html.withdrawn_by_timeline(f'<table><tr><td><a name="LawTimeLine"></a></td></tr>{rows}</table>') == "2003-06-02"
