"""Stored index and plane: same rows as without them, blocks skipped, faults told."""

import glob
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import lexical, lexstore, plane, ranking, stored, vector
from lodestack.plans import store


@pytest.fixture(scope="module")
def texts(spark):
    """Words of very different frequency; scores spread, so that blocks can be skipped."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for source, n in (("a", 700), ("b", 60)):
        for i in range(n):
            size = draw.choice((3, 8, 40, 90))
            rows.append((source, i * 3 + (source == "b"), 0, draw.choices(words, weights=[1 / (k + 1) for k in range(40)], k=size)))
            if i % 4 == 0:
                rows.append((source, i * 3 + (source == "b"), 1, ["w1", "w2"]))
    rows.append(("a", 99_999, 0, []))
    return spark.createDataFrame(rows, "source_id string, row_id long, col int, tokens array<string>").repartition(6)


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    lexstore.build(texts, path, block_rows=4, buckets=16)
    return lexstore.LexicalStore(spark, path, {"a", "b"}, verify=True)


def rounded(df):
    return [(r[0], round(r[1], 9), r[2]) for r in sorted(df.collect(), key=lambda r: r[2])]


@pytest.mark.parametrize("phrases", [[["w0"]], [["w1"], ["w2"]], [["w30"], ["w0"]], [["w1"], ["w1"]], [["w1", "w2"]], [["w1", "w2"], ["w0"]], [["absent"]], [["w0"], ["absent"]], []])
def test_same_as_without_store(texts, index, phrases):
    postings, rows = lexical.build_index(texts)
    for source, sizes in (("a", (7, 5000)), ("b", (1,))):
        mine = lexical.bm25(postings.where(F.col("source_id") == source), rows.where(F.col("source_id") == source), phrases)
        want = rounded(lexical.top(mine.select("row_id", "score"), 5000, "row_id"))
        for k in sizes:
            assert rounded(index.search(source, phrases, k)) == want[:k]


def test_filter_before_cut(texts, index):
    pool = texts.where("source_id = 'a' and row_id % 2 = 0").select("row_id").distinct()
    got = index.search("a", [["w0"]], 9, pool).collect()
    every = index.search("a", [["w0"]], 5000).orderBy("rank").collect()
    assert [r.row_id for r in sorted(got, key=lambda r: r.rank)] == [r.row_id for r in every if r.row_id % 2 == 0][:9]
    assert index.search("nowhere", [["w0"]], 5).count() == 0


def test_blocks_are_skipped(index, monkeypatch):
    """With many blocks only those are decoded whose bound reaches the k-th score."""
    monkeypatch.setattr(lexstore, "FIRST_BLOCKS", 8)
    seen = []
    scored = lexstore.LexicalStore._scored

    def counted(self, source, weights, blocks):
        if not isinstance(blocks, type(F.lit(1))):
            seen.append(blocks.count())
        return scored(self, source, weights, blocks)

    monkeypatch.setattr(lexstore.LexicalStore, "_scored", counted)
    want = rounded(index.search("a", [["w0"], ["w1"]], 3))
    held = index._mine(index.postings, "a", ["w0"]).count()
    assert seen and seen[0] + 8 < held
    monkeypatch.setattr(lexstore, "FIRST_BLOCKS", 10_000)
    assert rounded(index.search("a", [["w0"], ["w1"]], 3)) == want


def test_reads_own_buckets_only(index):
    files = [r.file for r in index.read_files("a", ["w3"]).collect()]
    assert files and all("source_id=a" in f for f in files) and len({re.search(r"bucket=(\d+)", f)[1] for f in files}) == 1


def test_faults_are_told(spark, texts, tmp_path):
    path = str(tmp_path / "i")
    lexstore.build(texts.where("source_id = 'b'"), path, block_rows=16, buckets=4)
    with pytest.raises(stored.StoredError, match="not of"):
        lexstore.LexicalStore(spark, path, {"a", "b"})
    file = sorted(glob.glob(f"{path}/postings/**/*.parquet", recursive=True))[0]
    held = open(file, "rb").read()
    with open(file, "wb") as f:  # a flipped byte: same length
        f.write(held[:100] + bytes([held[100] ^ 1]) + held[101:])
    crc = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
    os.remove(crc)
    lexstore.LexicalStore(spark, path)
    with pytest.raises(stored.StoredError, match="content"):
        lexstore.LexicalStore(spark, path, verify=True)
    os.remove(file)
    with pytest.raises(stored.StoredError, match="missing"):
        lexstore.LexicalStore(spark, path)
    with pytest.raises(stored.StoredError, match="no manifest"):
        lexstore.LexicalStore(spark, str(tmp_path / "none"))
    with pytest.raises(stored.StoredError, match="another kind"):
        plane.Plane(spark, path)


def test_empty_index(spark, texts, tmp_path):
    lexstore.build(texts.where("array_contains(tokens, 'none')"), str(tmp_path / "e"))
    assert lexstore.LexicalStore(spark, str(tmp_path / "e")).search("a", [["w0"]], 3).count() == 0


# planes
@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(s, i * 5 + (s == "y"), [float(x) for x in draw.standard_normal(16)]) for s, n in (("x", 300), ("y", 21)) for i in range(n)] + [("y", 9999, [0.0] * 16)]
    return spark.createDataFrame(rows, "source_id string, chunk_id long, embedding array<double>").repartition(5)


@pytest.fixture(scope="module")
def held(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plane") / "p")
    plane.build(vectors, path, block_rows=32)
    return plane.Plane(spark, path, verify=True)


def test_plane_is_exact(vectors, held):
    small = vectors.where("source_id = 'x'").select("chunk_id", vector.quantized(F.col("embedding")).alias("embedding"))
    seed = held.vector("x", 35)
    assert seed == list(small.where("chunk_id = 35").first().embedding)
    key = lambda df: [(r.chunk_id, r.raw, r["rank"]) for r in df.orderBy("rank").collect()]
    assert key(held.nearest("x", seed, 20)) == key(vector.nearest(small, seed, 20, numpy=False))
    some = small.where("chunk_id % 3 = 0").select("chunk_id")
    assert key(held.nearest("x", seed, 20, some)) == key(vector.nearest(small, seed, 20, some, numpy=False))
    inside = small.where("chunk_id between 100 and 160")
    assert key(held.nearest("x", seed, 99, between=(100, 160))) == key(vector.nearest(inside, seed, 99, numpy=False))
    assert held.nearest("x", seed, 5, some.where("chunk_id < 0")).count() == 0


def test_kept_bitmaps(vectors, held):
    """What a filter admits is made once for a key; another key is another set."""
    seed, ids = held.vector("x", 35), vectors.where("source_id = 'x'").select("chunk_id")
    some = held.nearest("x", seed, 9, ids.where("chunk_id % 3 = 0"), key="third").collect()
    assert held.nearest("x", seed, 9, ids.where("chunk_id < 0"), key="third").collect() == some
    assert held.nearest("x", seed, 9, ids.where("chunk_id < 0"), key="none").count() == 0


def test_eligible_without_vector(spark, held):
    asked = spark.createDataFrame([(35,), (36,)], "chunk_id long")
    assert held.nearest("x", held.vector("x", 35), 5, asked).count() == 1
    with pytest.raises(ValueError, match="36"):
        held.nearest("x", held.vector("x", 35), 5, asked, strict=True)
    with pytest.raises(ValueError, match="no unique"):
        held.vector("x", 36)


def test_binding(spark, vectors, held, tmp_path):
    assert held.binding_faults(vectors).count() == 0
    other = vectors.withColumn("embedding", F.when((F.col("source_id") == "x") & (F.col("chunk_id") == 170), F.reverse("embedding")).otherwise(F.col("embedding")))
    assert [tuple(r) for r in held.binding_faults(other).collect()] == [("x", 1, "vectors")]
    more = vectors.unionByName(vectors.limit(1).withColumn("chunk_id", F.lit(7).cast("long")))
    assert {r.fault for r in held.binding_faults(more).collect()} == {"vectors without a place"}
    # a byte of a block flipped: written anew, so that the file is sound and only the digest tells
    broken = held.blocks.withColumn("data", F.when((F.col("source_id") == "x") & (F.col("block") == 2), F.concat(F.unhex(F.lit("07")), F.expr("substring(data, 2)"))).otherwise(F.col("data")))
    broken.write.parquet(str(tmp_path / "b"))
    held_blocks, held.blocks = held.blocks, spark.read.parquet(str(tmp_path / "b"))
    try:
        assert [tuple(r) for r in held.binding_faults(vectors).collect()] == [("x", 2, "bytes")]
    finally:
        held.blocks = held_blocks


@pytest.mark.parametrize("bad", [[float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], None])
def test_non_finite_vectors_are_refused(spark, tmp_path, bad):
    df = spark.createDataFrame([("x", 1, [1.0, 2.0]), ("x", 2, bad)], "source_id string, chunk_id long, embedding array<double>")
    with pytest.raises(ValueError, match="non-finite vectors: 2"):
        plane.build(df, str(tmp_path / "p"))


def test_refused_planes(spark, tmp_path):
    kind = "source_id string, chunk_id long, embedding array<double>"
    with pytest.raises(ValueError, match="lengths"):
        plane.build(spark.createDataFrame([("x", 1, [1.0, 2.0]), ("x", 2, [1.0])], kind), str(tmp_path / "p"))
    with pytest.raises(ValueError, match="twice"):
        plane.build(spark.createDataFrame([("x", 1, [1.0]), ("x", 1, [1.0])], kind), str(tmp_path / "q"))


def test_metadata_must_be_there(spark):
    fused = spark.createDataFrame([(1, 0.5), (2, 0.25)], "chunk_id long, score double")
    meta = spark.createDataFrame([(1, "d")], "chunk_id long, document string")
    assert ranking.with_metadata(fused.where("chunk_id = 1"), meta).collect() == [(1, 0.5, "d")]
    with pytest.raises(Exception, match="candidate without metadata: 2"):
        ranking.with_metadata(fused, meta).collect()


def test_built_once(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    built = []
    make = lambda p: (built.append(p), spark.range(2).write.parquet(f"{p}/d"), stored.close(spark, p, {"format": "t"}))
    first = store.once(spark, "t", [str(tmp_path / "t")], make, lambda p: p)
    assert store.once(spark, "t", [str(tmp_path / "t")], make, lambda p: p) == first and len(built) == 1
    store._opened.clear()
    assert store.once(spark, "t", [str(tmp_path / "t")], make, lambda p: p) == first and len(built) == 1
    spark.range(4).write.mode("append").parquet(str(tmp_path / "t"))
    assert store.once(spark, "t", [str(tmp_path / "t")], make, lambda p: p) != first and len(built) == 2
