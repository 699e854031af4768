"""What the findings of the third round asked for."""

from __future__ import annotations

import random
import unicodedata
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.functions import text, wordpiece
from lodestack.functions.porter import stemmed
from lodestack.llm import common
from lodestack.operators import lexstore, stored
from lodestack.plans import q_rules, q_text, q_tools


def test_titles_need_no_index_of_texts(spark, sf_dir, monkeypatch):
    """the titles' own index is made from narrow columns; texts and vectors stay out of it."""

    def refused(*_, **__):
        raise AssertionError("built")

    monkeypatch.setattr(q_tools.store, "once", refused)
    assert q_tools.tool_titles(spark, sf_dir).count() > 0


@pytest.mark.parametrize("piece", [3, 1_000_000])
def test_index_in_pieces(spark, tmp_path, monkeypatch, piece):
    """Pieces of any size make the same postings, and nothing that the build wrote for itself is left."""
    rng = random.Random(5)
    rows = [(s, i, c, [rng.choice("abc") for _ in range(rng.randrange(6))]) for s in ("x", "y") for i in range(40) for c in (1, 0)]
    rows += [("x", 99, 0, None)]
    whole = spark.createDataFrame(rows, "source_id string, row_id long, col int, tokens array<string>")
    before = {p.name for p in Path(stored.shared_folder(spark)).glob("*")}
    monkeypatch.setattr(lexstore, "PIECE_TOKENS", piece)
    lexstore.build(whole, str(tmp_path / "i"), block_rows=16, buckets=8)
    assert {p.name for p in Path(stored.shared_folder(spark)).glob("*")} == before
    held = lexstore.LexicalStore(spark, str(tmp_path / "i"), {"x", "y"})
    number = {(s, i): n for s in ("x", "y") for n, i in enumerate(sorted({r[1] for r in rows if r[0] == s}))}
    expected = {}
    for s, i, c, tokens in rows:
        for at, t in enumerate(tokens or []):
            expected.setdefault((s, t, number[s, i]), []).append((c << 32) + at)
    got = {}
    for r in held.postings.collect():
        assert r.rows == sorted(r.rows) and r.n == len(r.rows) and r.tfs == [len(p) for p in r.places]
        got |= {(r.source_id, r.term, r.block * 16 + x): p for x, p in zip(r.rows, r.places, strict=True)}
    assert got == {k: sorted(v) for k, v in expected.items()}
    assert held.postings.groupBy("source_id", "term", "block").count().where("count > 1").isEmpty()
    told = {(r.row_id, r.col): r.positions for r in held.positional("x", ["a"]).collect()}
    assert told == {(n, c): [i for i, t in enumerate(ts or []) if t == "a"] for s, r, c, ts in rows for n in [number[s, r]] if s == "x" and "a" in (ts or [])}


def test_files_are_hashed_by_many_tasks(spark, tmp_path):
    """The manifest's digests are made where files are read."""
    spark.range(400).repartition(8).write.parquet(str(tmp_path / "s" / "t"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.sparkContext.setJobGroup("closing", "closing")
    try:
        stored.close(spark, str(tmp_path / "s"), {"format": "t"})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.sparkContext.setJobGroup("", "")
    t = spark.sparkContext.statusTracker()
    stages = [t.getStageInfo(s) for j in t.getJobIdsForGroup("closing") for s in t.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) > 1
    assert stored.faults(spark, str(tmp_path / "s"), hashed=True).isEmpty()


def test_every_order_has_its_template(spark, sf_dir):
    """F9"""
    assert q_rules.templates(spark, sf_dir).count() == q_rules.table(spark, sf_dir, "orders").count()


def test_large_batches_are_taken_in_slices():
    """F20, F22"""
    batch = pa.record_batch([pa.array(["x" * 1_000_000] * 20)], names=["t"])
    parts = list(q_text.sliced(batch))
    assert len(parts) > 2 and max(p.num_rows for p in parts) <= 5 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


ODD = ["a", "É", "Σ", "ς", "ß", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "-", "'", "中", "́", "9", ".", "", "퟿", " "]


def _slow_tokens(s: str) -> list[str]:
    out, run = [], ""
    for c in s + " ":
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind in ("Co", "Mn"):
            run += c
        else:
            out += [stemmed(t) for t in [text.fold_token(run)] if run and t]
            run = ""
    return out


def test_tokens_looked_up_by_run_are_those_of_the_whole_text():
    """splitting at white space changes no token and no count, and each run is worked out once."""
    rng, made = random.Random(3), wordpiece.WordPiece(["[UNK]", "[CLS]", "[SEP]", "a", "##a", "e", "σ", "##σ", "ς", "9"])
    for _ in range(4000):
        s = "".join(rng.choice(ODD) for _ in range(rng.randrange(14)))
        assert text.index_tokens(s) == _slow_tokens(s), ascii(s)
        assert made.count(s) == len(made.encode(s)), ascii(s)
    hits = made._pieces_in.cache_info().hits
    made.count("a " * 1000)
    assert made._pieces_in.cache_info().hits >= hits + 999


def test_characters_in_use(spark):
    """F18"""
    d = spark.createDataFrame([("ab",), ("",), (None,), ("b中𝒳",)], "t string")
    assert {r.c for r in wordpiece.characters(d, "t").collect()} == set("ab中𝒳")
    assert wordpiece.characters(d.where(F.lit(False)), "t").count() == 0


def test_facts_are_told_for_their_templates_only(spark, sf_dir):
    """a fact that no template of a row asks for is not worked out; rows are dealt to all tasks."""
    from lodestack.functions import metadata

    asked = {n for t in (metadata.TITLES, metadata.DATES) for names in t.values() for n in names}
    rows = spark.createDataFrame([(t,) for t in metadata.TITLES], "template string")
    for fact in sorted(asked):
        users = {r.template for r in rows.where(metadata._used(fact)).collect()}
        assert users == {t for t in metadata.TITLES if fact in (*metadata.TITLES[t], *metadata.DATES[t])}
    assert q_rules.derived_metadata(spark, sf_dir).rdd.getNumPartitions() > 1


def test_a_key_reads_and_writes_its_state_once():
    """a call of the operator makes one read and one write of state, whatever the number of rows."""
    from datetime import datetime

    from pyspark.sql import Row

    from lodestack.streaming.authoritative import Authoritative

    class Held:
        value, calls, timers = None, 0, set()

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def getCurrentWatermarkInMs(self):
            return 0

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    held = Held()
    made = Authoritative(1000)
    made.handle = made.held = held
    made.handleInitialState(("k",), Row(id="k", order_key="r1", payload="old"), held)
    made.handleInitialState(("k",), Row(id="k", order_key="r0", payload="older"), held)
    v = lambda order, current: Row(id="k", order_key=order, is_current=current, is_latest=False, at=datetime(2024, 1, 1), payload=order)
    held.calls = 0
    assert list(made.handleInputRows(("k",), iter([v("a", False), v("b", False)]), held)) == [] and held.calls == 2 and len(held.timers) == 1
    assert [tuple(r) for r in made.handleExpiredTimer(("k",), held, None)] == [("k", "r1", "old", "fallback")] and held.calls == 4
    held.timers.clear()
    assert list(made.handleInputRows(("k",), iter([v("a", False)]), held)) == [] and held.calls == 5
    assert [tuple(r) for r in made.handleInputRows(("k",), iter([v("c", True)]), held)] == [("k", "c", "c", "version")] and not held.timers


def test_coverage_is_told_by_one_sort(spark, sf_dir):
    """one shuffle and one sort serve all kinds of faults."""
    from lodestack.plans import q_sources

    plan = q_sources.coverage_faults(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1, plan


def test_shuffles_go_with_the_job(spark):
    """files of shuffles go once a table is written, also where the session never set Spark's own switch for that."""
    spark.conf.unset(stored.CLEANUP)
    seen = []
    stored.tidily(spark, lambda: seen.append(spark.conf.get(stored.CLEANUP)))
    assert seen == ["true"] and spark.conf.get(stored.CLEANUP) == "false"
    jvm = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(f.getName().startswith("shuffle_") for f in map(jvm.getAllFiles().apply, range(jvm.getAllFiles().size())))
    for make in (lambda df: stored.scratch(df, "t"), common.cut):
        before = held()
        made = make(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        assert held() <= before
        assert made.count() == 7


@pytest.mark.parametrize("piece", [1, 4, 1_000_000])
@pytest.mark.parametrize("batch", [1, 2, 7, 100])
def test_pieces_are_joined_across_batches(monkeypatch, piece, batch):
    """the pieces of a block make one posting, wherever batches end."""
    rng = random.Random(3)
    monkeypatch.setattr(lexstore, "PIECE_TOKENS", piece)
    told, wanted = [], {}
    for source, mean in (("x", 2.5), ("y", 4.0)):
        for term in (None, "a", "b"):
            for block in range(2):
                whole = wanted[source, term, block] = ([], [], [], [])
                for first in range(0, 10 * rng.randrange(1, 4), 10):
                    rows = sorted(rng.sample(range(first, first + 10), rng.randrange(1, 4)))
                    places = [sorted(rng.sample(range(50), rng.randrange(1, 4))) for _ in rows]
                    lengths = [rng.randrange(1, 9) for _ in rows]
                    ends = [sum(map(len, places[: i + 1])) for i in range(len(rows))]
                    told.append({"source_id": source, "bucket": 1, "term": term, "block": block, "first": first, "mean": mean, "rows": rows, "ends": ends, "lengths": lengths, "places": sum(places, [])})
                    norms = [lexstore.K1 * (1 - lexstore.B + lexstore.B * n / mean) for n in lengths]
                    for to, more in zip(whole, (rows, list(map(len, places)), norms, places), strict=True):
                        to.extend(more)
    kinds = pa.schema([("source_id", pa.string()), ("bucket", pa.int32()), ("term", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("mean", pa.float64()), *[(c, pa.list_(pa.int32())) for c in ("rows", "ends", "lengths")], ("places", pa.list_(pa.int64()))])
    batches = [pa.RecordBatch.from_pylist(told[i : i + batch], kinds) for i in range(0, len(told), batch)]
    got = [r for b in lexstore._joined_rows(iter(batches)) for r in b.to_pylist()]
    assert [(r["source_id"], r["term"], r["block"]) for r in got] == list(wanted)
    for r in got:
        rows, tfs, norms, places = wanted[r["source_id"], r["term"], r["block"]]
        assert (r["n"], r["rows"], r["tfs"], r["norms"], r["places"]) == (len(rows), rows, tfs, norms, places)
        assert r["most"] == max(tf * (lexstore.K1 + 1) / (tf + n) for tf, n in zip(tfs, norms, strict=True))
