"""Search semantics on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from lodestack import schema
from lodestack.functions.porter import stemmed
from lodestack.functions.snippet import snippet
from lodestack.functions.text import index_tokens, query_terms, strict_query
from lodestack.ident import ChunkRef, DocumentId, DocUri, decode_cursor, encode_cursor
from lodestack.operators import filters, ranking, vector
from lodestack.operators.search import Engine, SearchOptions

DOCS = [
    ("PAC/OLD", "PAC", "1990-01-01", None, None, "Rare Alpha"),
    ("EV/NEW", "EV", "2025-01-01", None, None, "Rare Alpha"),
    ("TXR/OLD", "TXR", "1990-01-01", None, None, "Common Beta"),
    ("TXR/WITHDRAWN", "TXR", "2025-01-01", "2026-01-01", None, "Common Gamma"),
    ("TXR/CURRENT", "TXR", "2025-02-01", None, None, "Common Delta"),
    ("META/ONLY", "TXR", None, None, None, "Metadata Only"),
]
TEXTS = ["rare alpha", "rare alpha", "common beta", "common gamma", "common delta"]


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame(
        [("ato", n, t, title, d, f"https://x.org/{n}", None, None, None, None, w, s, None, False, False, False, "Fixture heading") for n, t, d, w, s, title in DOCS], schema.DOCUMENTS
    )
    chunks = spark.createDataFrame([(i + 1, "ato", DOCS[i][0], 0, None, t) for i, t in enumerate(TEXTS)], schema.CHUNKS)
    vectors = spark.createDataFrame([(i + 1, [127 - 20 * i, 20 * i]) for i in range(5)], schema.CHUNK_EMBEDDINGS)
    return Engine.build(docs, chunks, vectors)


def test_bm25_by_the_formula(engine):
    rows = engine.keyword("rare", "ato", engine.chunks.select("chunk_id"), 50).collect()
    assert [r.chunk_id for r in rows] == [1, 2]
    assert rows[0].score == pytest.approx(math.log(3.5 / 2.5), abs=1e-12)


def test_titles(engine):
    rows = engine.title_hits("rare", "ato").collect()
    assert [r.native_id for r in rows] == ["EV/NEW", "PAC/OLD"]
    assert rows[0].score == pytest.approx(math.log(4.5 / 2.5), abs=1e-12)
    assert engine.title_hits("META/ONLY", "ato").first().native_id == "META/ONLY"


def test_search_modes(engine):
    got = engine.search("common", SearchOptions("ato", mode="keyword", include_old=True)).collect()
    assert {r.native_id for r in got} == {"TXR/OLD", "TXR/CURRENT"}
    near = engine.search("", SearchOptions("ato", similar_to=1, include_old=True, current_only=False, types=("PAC", "TXR"))).collect()
    assert [r.chunk_id for r in near] == [3, 4, 5]
    with pytest.raises(ValueError, match="unknown types"):
        engine.search("x", SearchOptions("ato", types=("NOPE",)))


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({}, {"PAC/OLD", "TXR/CURRENT", "META/ONLY"}),
        ({"types": ()}, {"PAC/OLD", "TXR/CURRENT", "META/ONLY"}),
        ({"date_from": "1990-01-01", "current_only": False}, {"PAC/OLD", "TXR/WITHDRAWN", "TXR/CURRENT"}),
        ({"include_old": True, "current_only": False}, {"PAC/OLD", "TXR/OLD", "TXR/WITHDRAWN", "TXR/CURRENT", "META/ONLY"}),
        ({"types": ("EV",)}, {"EV/NEW"}),
        ({"types": ("T%*",), "include_old": True}, set()),
        ({"scope": "txr/c*"}, {"TXR/CURRENT"}),
        ({"scope": "missing"}, set()),
    ],
)
def test_policy(engine, spec, want):
    got = engine.documents.where(filters.document_filter(filters.FilterSpec("ato", **spec))).collect()
    assert {r.native_id for r in got} == want


def test_query_terms():
    assert query_terms("the Tax tax " * 40) == ["Tax"]
    assert len(query_terms("develop development alpha")) == 3
    assert len(query_terms(" ".join(f"w{i}" for i in range(100)))) == 16
    assert strict_query("a Body research-development evidence") == '"Body" "research-development" "evidence"'
    assert index_tokens("Café 355-25") == ["cafe", "355", "25"]
    assert [stemmed(w) for w in ("ponies", "relational", "hopping", "sky")] == ["poni", "relat", "hop", "sky"]


def test_fusion_ties_and_diversity(spark):
    a = spark.createDataFrame([(2, 1), (1, 2)], "chunk_id long, rank int")
    b = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, rank int")
    assert [r.chunk_id for r in ranking.ranked(ranking.rrf(a, b), "chunk_id").orderBy("rank").collect()] == [1, 2]
    rows = [(i, "A", 1 - i / 100, False) for i in range(8)] + [(10, "B", 0.5, False), (11, "B", 0.49, False)]
    df = spark.createDataFrame(rows, "chunk_id long, document string, score double, is_intro boolean")
    assert [r.chunk_id for r in ranking.diverse(df, 10, 2).orderBy("rank").collect()] == [0, 1, 10, 11]
    intro = spark.createDataFrame([(1, "A", 0.9, True), (2, "A", 0.5, False), (3, "B", 0.8, False)], df.schema)
    assert [r.chunk_id for r in ranking.diverse(intro, 10, 1).orderBy("rank").collect()] == [2, 3]


def test_quantization(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "chunk_id long, v array<double>")
    assert [r.q for r in df.orderBy("chunk_id").select(vector.quantized(F.col("v")).alias("q")).collect()] == [[76, 102], [0, 0], [-127, 0]]


def test_plans_push_down(spark, sf_dir):
    """A library query reads the columns it needs, and its filter reaches the scan, whatever other tests have cached."""
    from lodestack.plans import catalog

    spark.catalog.clearCache()
    plan = catalog.queries()["late_hydration"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "PushedFilters" in plan
    df = catalog.queries()["excluded_titles"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_snippet():
    text = "filler " * 200 + "needle here " + "filler " * 200
    got = snippet(text, "needle")
    assert "needle" in got and got.startswith("...") and got.endswith("...") and len(got.encode()) <= 290
    assert snippet("short é", "x") == "short é"


def test_identifiers():
    for text in ("ato:PAC/1%3A2", "a-b:x"):
        assert str(DocumentId.parse(text)) == text
    assert str(ChunkRef.parse("g1:ato:7")) == "g1:ato:7"
    for bad in ("ato:", "ATO:x", "ato:%zz", "ato:a%2fb"):
        with pytest.raises(ValueError):
            DocumentId.parse(bad)
    uri = "legal://ato/PAC/1997%20a?pit=20240101"
    assert str(DocUri.parse(uri)) == uri
    for bad in ("legal://ato/a b", "legal://ato/x?pit=1", "legal://ato/x?other=1"):
        with pytest.raises(ValueError):
            DocUri.parse(bad)
    assert decode_cursor(encode_cursor({"a": [1, "ü"]})) == {"a": [1, "ü"]}
