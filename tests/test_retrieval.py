"""Retrieval tools on a small corpus."""

import pytest
from pyspark.sql import functions as F

from lodestack import schema
from lodestack.ident import ChunkRef
from lodestack.operators import retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([("ato", f"PAC/{i}", "PAC", f"T{i}", f"200{i}-01-01" if i else None, "https://x.org", *[None] * 7, False, False, False, "") for i in range(4)], schema.DOCUMENTS)
    chunks = spark.createDataFrame([(10 * d + o, "ato", f"PAC/{d}", o, None, f"[doc:ato:PAC/0] text {d}.{o} [doc:ato:GONE/1]") for d in range(4) for o in range(4)], schema.CHUNKS)
    cites = spark.createDataFrame([(10 * d + o, "ato", f"PAC/{d}", "ato", "PAC/0") for d in range(4) for o in range(2)], schema.CITATIONS)
    anchors = spark.createDataFrame([("ato", "PAC/0", 1, "sister", "b", "ato", "PAC/1", None, None), ("ato", "PAC/0", 0, "in_doc", "a", None, None, 1, None), ("ato", "PAC/0", 2, "history", "c", "ato", "PAC/0", None, "20200101")], schema.ANCHORS)
    defs = spark.createDataFrame([("ato", f"d{i}", "Car", "car", f"PAC/{i}", "T", "PAC", None, None, i, "a thing") for i in range(3)], schema.DEFINITIONS)
    return docs, chunks, cites, anchors, defs


def test_get_chunks(corpus):
    refs = [ChunkRef("g", "ato", 11), ChunkRef("g", "ato", 12)]
    rows, more = retrieval.get_chunks(corpus[1], refs, before=1, after=1)
    assert [(r.seq, r.ord) for r in rows.orderBy("seq", "ord").collect()] == [(0, 0), (0, 1), (1, 2), (1, 3)] and more is None
    whole = "".join(r.text for r in rows.orderBy("seq", "ord").collect())
    parts, cursor = [], None
    while True:
        part, cursor = retrieval.get_chunks(corpus[1], refs, 1, 1, max_chars=25, cursor=cursor)
        parts += [r.text for r in part.orderBy("seq", "ord").collect()]
        if cursor is None:
            break
        last = cursor
    assert "".join(parts) == whole
    with pytest.raises(ValueError, match="cursor"):
        retrieval.get_chunks(corpus[1], refs, 1, 0, max_chars=25, cursor=last)
    with pytest.raises(ValueError, match="unknown"):
        retrieval.get_chunks(corpus[1], [ChunkRef("g", "ato", 999)])


def test_chunk_limits(corpus):
    """Bounds, unknown and repeated references, foreign and broken cursors, and a budget that ends where a chunk ends."""
    chunks, ref = corpus[1], lambda i: ChunkRef("g", "ato", i)
    for bad in ({"refs": []}, {"refs": [ref(0)] * 101}, {"refs": [ref(0)], "before": 21}, {"refs": [ref(0)], "after": -1}, {"refs": [ref(0)], "max_chars": 0}, {"refs": [ref(0)], "max_chars": 200_001}):
        with pytest.raises(ValueError):
            retrieval.get_chunks(chunks, **bad)
    for bad in ("zzz", "e30", "bnVsbA"):
        with pytest.raises(ValueError, match="cursor"):
            retrieval.get_chunks(chunks, [ref(0)], cursor=bad)
    with pytest.raises(ValueError, match="g:other:0"):
        retrieval.get_chunks(chunks, [ref(0), ChunkRef("g", "other", 0)])
    twice, more = retrieval.get_chunks(chunks, [ref(12), ref(12), ref(11)], before=1)
    assert [(r.seq, r.ord) for r in twice.orderBy("seq", "ord").collect()] == [(0, 2), (2, 0), (2, 1)] and more is None
    text = chunks.where("chunk_id = 0").first().text
    first, more = retrieval.get_chunks(chunks, [ref(0), ref(1)], max_chars=len(text))
    assert [(r.text, r.cut_at) for r in first.collect()] == [(text, None)] and more
    second, last = retrieval.get_chunks(chunks, [ref(0), ref(1)], max_chars=len(text), cursor=more)
    assert [(r.chunk_id, r.resumed_at) for r in second.collect()] == [(1, None)] and last is None
    part, more = retrieval.get_chunks(chunks, [ref(0)], max_chars=5)
    assert part.first().cut_at == 5
    part, more = retrieval.get_chunks(chunks, [ref(0)], max_chars=5, cursor=more)
    assert part.first().resumed_at == 5 and part.first().text == text[5:10]


def test_anchors_from_stored_html(spark, corpus):
    docs, chunks, cites, anchors, _ = corpus
    page = "<p><a href='#s1'>One &amp; more</a><a href='#s2'>Two</a><a href=\"#s1\">One &amp;\n more</a><a href='#none'>x</a><a href='/y'>y</a><a name='s1'>z</a></p>"
    own = docs.withColumn("html", F.when(F.col("native_id") == "PAC/1", page))
    held = chunks.withColumn("anchor", F.when(F.col("ord") == 2, "s1").when(F.col("ord") == 3, "s1").when(F.col("ord") == 1, "s2"))
    row = retrieval.get_doc_anchors(anchors, own, cites, "ato", "PAC/1", held).first()
    assert [(a.label, a.target_chunk_id) for a in row.in_doc] == [("One & more", 12), ("Two", 11)]
    # a link on record is told instead
    row = retrieval.get_doc_anchors(anchors, own, cites, "ato", "PAC/0", held).first()
    assert [a.label for a in row.in_doc] == ["a"]
    with pytest.raises(ValueError, match="unknown document"):
        retrieval.get_doc_anchors(anchors, docs, cites, "ato", "PAC/99")


def test_anchors_and_definitions(spark, corpus):
    docs, chunks, cites, anchors, defs = corpus
    row = retrieval.get_doc_anchors(anchors, docs, cites, "ato", "PAC/0").first()
    assert [a.label for a in row.in_doc] == ["a"] and row.related_docs[0].target_title == "T1" and row.historical_versions[0].target_pit == "20200101"
    assert [c.native_id for c in row.cited_by] == ["PAC/3", "PAC/2", "PAC/1"] and row.cited_by_total is None
    got = retrieval.get_definition(defs, docs, " *Car*: ", "PAC/2/5", max_defs=2).collect()
    assert [r.native_id for r in got] == ["PAC/2", "PAC/0"]
    words = spark.createDataFrame([("bus", "Bus", "a vehicle")], "norm string, term string, definition string")
    assert retrieval.get_definition(defs, docs, "bus", dictionary=words).first().kind == "ordinary"
    kinds = {(r.chunk_id, r.native_id): r.kind for r in retrieval.marker_kinds(chunks, docs).collect()}
    assert kinds[(10, "PAC/0")] == "doc" and kinds[(10, "GONE/1")] == "fetch" and (0, "PAC/0") not in kinds


def test_stats_and_fetch(spark, corpus):
    docs, chunks, _, _, defs = corpus
    vectors = spark.createDataFrame([(0, [1]), (1, [1])], schema.CHUNK_EMBEDDINGS)
    row = retrieval.stats(docs, chunks, defs, vectors).first()
    assert (row.documents, row.chunks, row.embeddings, row.definitions) == (4, 16, 2, 3)
    assert row.documents_by_type[0].n == 4 and row.prefixes[0].description == "T0"
    url = retrieval.official_url("PAC/1 2", "20200101")
    assert url.endswith("?docid=PAC/1%202&PiT=20200101")
    pages = spark.createDataFrame([(url, "<p>x</p>")], "url string, html string")
    assert retrieval.fetch(pages, "legal://ato/PAC/1%202?pit=20200101").count() == 1
    assets = spark.createDataFrame([("ato", "a/1", "a", "image/png", None, "cap", "0" * 64, bytearray(b"x"))], schema.ASSETS)
    assert retrieval.get_asset(assets, "ato", "a/1").select("caption", "data").first() == ("cap", "eA==")
    assert retrieval.get_asset(assets, "ato", "none").count() == 0
