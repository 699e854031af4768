"""Run control, readers of workspaces and the command line."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestack import __main__ as cli
from lodestack.plans import runs
from lodestack.sources import normalise
from tests.test_storage import tables


def test_lock_and_staged_steps(spark, tmp_path):
    folder = runs.Folder(spark, f"file://{tmp_path}/work")
    with runs.exclusive(folder, "one"):
        with pytest.raises(ValueError, match="locked by one"), runs.exclusive(folder, "two"):
            pass
    assert not folder.exists("run.lock")
    staged = runs.Staged(folder)
    assert staged.rows() is None and staged.state()["cursor"] is None
    assert staged.advance(spark.range(3), "a") == 1
    # a step that was cut off counts for nothing and is written anew
    spark.range(50).write.parquet(f"{folder.root}/step-000001")
    assert staged.rows().count() == 3
    assert staged.advance(spark.range(3, 5), "b") == 2
    assert staged.state() == {"steps": 2, "cursor": "b"} and staged.rows().count() == 5


def test_runs_are_bound(spark, tmp_path):
    folder = runs.Folder(spark, f"file://{tmp_path}/build")
    pinned = runs.Pinned(folder, {"engine": "1", "tree": "x"})
    assert pinned.done() == []
    pinned.finish("b")
    pinned.finish("a")
    assert runs.Pinned(folder, {"tree": "x", "engine": "1"}).done() == ["a", "b"]
    with pytest.raises(ValueError, match="other tree"):
        runs.Pinned(folder, {"engine": "1", "tree": "y"}).done()
    runs.checked_run("/a/run", "/a/work", True, True)
    for args in (("/a/work/run", "/a/work", False, True), ("/a", "/a/work", False, True), ("/r", "/w", True, False)):
        with pytest.raises(ValueError):
            runs.checked_run(*args)


def test_updates_are_isolated():
    def broken():
        raise OSError("gone")

    got = runs.update_sources({"d": broken, "a": lambda: (0, []), "b": lambda: (3, []), "c": lambda: (3, ["row 1"])})
    assert [(o.source, o.status) for o in got] == [("a", "current"), ("b", "updated"), ("c", "partial"), ("d", "failed")]
    assert got[3].faults == ["OSError: gone"] and {o.status for o in got} == set(runs.OUTCOMES)


def test_retries_memo_and_timings():
    assert [runs.retry_after(503, n) for n in (1, 2, 3, 4, 5)] == [1, 2, 4, 8, None]
    assert runs.retry_after(404, 1) is None and runs.retry_after(None, 1) == 1
    assert runs.retry_after(429, 1, told=900) == 120 and runs.retry_after(429, 1, told=900, most=30) == 30
    ready, made = runs.Ready(2), []
    for key in ("a", "b", "a", "c", "a", "b"):
        ready.get((key,), lambda key=key: made.append(key))
    assert made == ["a", "b", "c", "b"]
    t = runs.Timings(5)
    with t.phase("fuse"):
        pass
    assert set(t.told()) == {*(f"{p}_us" for p in runs.PHASES), "queue_us", "total_us"} and t.told()["total_us"] >= 5
    with pytest.raises(ValueError), t.phase("other"):
        pass


def test_tree_fingerprint(spark, tmp_path):
    def tree(name, files):
        for path, text in files.items():
            p = tmp_path / name / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
        return runs.tree_fingerprint(spark, f"file://{tmp_path}/{name}")

    one = tree("one", {"a/x": "1", "b": "2", "run.lock": "p", "staging/z": "3"})
    assert one == tree("two", {"a/x": "1", "b": "2"}) and one[0] == 2
    assert one != tree("three", {"a/x": "2", "b": "1"}) and one != tree("four", {"a/y": "1", "b": "2"})


def test_schema_faults():
    a = StructType([StructField("x", LongType()), StructField("y", StringType())])
    b = StructType([StructField("y", StringType()), StructField("x", LongType())])
    assert runs.schema_faults(a, b) == []
    assert runs.schema_faults(a, StructType([StructField("x", StringType()), StructField("z", LongType())])) == ["x: bigint, not string", "y: string, not known", "z: missing, not bigint"]


def test_payloads(spark, tmp_path):
    pages = {"p/1.html": b"<html><body><h1>One</h1><p>First text.</p></body></html>", "p/2.html": b"\xff\xfe", "p/3.html": b"<p>x</p>"}
    for name, data in pages.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = [(n, n, len(d) + (n == "p/3.html"), hashlib.sha256(d).hexdigest()) for n, d in pages.items()] + [("p/4.html", "p/4.html", 1, "")]
    inventory = spark.createDataFrame(rows, "canonical_id string, path string, size long, sha256 string")
    got = {r.canonical_id: r for r in normalise.read_payloads(spark, f"file://{tmp_path}", inventory).collect()}
    assert got["p/1.html"].fault is None and "First text." in got["p/1.html"].text and got["p/1.html"].headings == ["One"]
    assert got["p/2.html"].fault.startswith("UnicodeDecodeError")
    assert got["p/3.html"].fault == "payload differs from its record" and got["p/4.html"].fault == "payload is missing"


def test_links_are_whole_addresses(spark):
    docs = spark.createDataFrame([(1, '<a href="/a">1</a><a href="/ab#t">2</a>'), (2, None), (3, "plain")], "canonical_id long, html string")
    known = spark.createDataFrame([("/a", "A")], "url string, target string")
    got = {r.canonical_id: r.html for r in normalise.with_internal_links(docs, known).collect()}
    assert got == {1: '<a href="doc:A">1</a><a href="/ab#t">2</a>', 2: None, 3: "plain"}


def test_command_line(spark, tmp_path):
    root = f"file://{tmp_path}/corpus"
    for i, title in enumerate(("One", "Two")):
        for name, df in tables(spark, title).items():
            df.write.parquet(f"{tmp_path}/in{i}/{name}.parquet")
    ids = [cli.run(spark, ["build", root, f"file://{tmp_path}/in{i}"])[0]["generation"] for i in range(2)]
    with pytest.raises(ValueError, match="no generation is active"):
        cli.run(spark, ["stats", root])
    for x in ids:
        cli.run(spark, ["activate", root, x])
    assert cli.run(spark, ["verify", root]) == [{"generation": ids[1], "ok": True, "faults": []}]
    assert cli.run(spark, ["stats", root])[0]["documents"] == 1
    assert [h["native_id"] for h in cli.run(spark, ["search", root, "text", "--source", "ato", "-k", "3"])] == ["PAC/1"]
    assert cli.run(spark, ["rollback", root]) == [{"active": ids[0]}]
    assert cli.run(spark, ["prune-generations", root, "--keep", "0"]) == [{"removed": ids[1]}]
    assert cli.run(spark, ["deactivate", root, ids[1]]) == [{"deactivated": False}]
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "canonical_id string, content_hash string")
    old.write.parquet(f"{tmp_path}/old")
    old.withColumn("content_hash", F.when(F.col("canonical_id") == "a", "2").otherwise(F.col("content_hash"))).write.parquet(f"{tmp_path}/new")
    assert cli.run(spark, ["snapshot-reduce", f"{tmp_path}/old", f"{tmp_path}/new"]) == [{"action": "replace", "n": 1}, {"action": "unchanged", "n": 1}]
