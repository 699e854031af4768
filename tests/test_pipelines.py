"""Crawls, keyset scans, authoritative versions, payloads, digest trees, snapshots, seek paging."""

import glob
import hashlib
import json
import os
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestack.operators import crawl, digests, payloads, snapshots, stored
from lodestack.sources import keyset
from lodestack.streaming import authoritative

LISTING = "parent string, seq long, title string, folder string, href string"


# crawls
def plain_crawl(rows, root, excluded):
    """A queue and a set."""
    shown = {}
    for parent, seq, title, folder, href in sorted(rows, key=lambda r: (r[0], r[1])):
        shown.setdefault(parent, []).append((title or "(untitled)", folder, href))
    queue, opened, out = [(0, [], x) for x in shown.get(root, [])], set(), []
    while queue:
        level, above, (title, folder, href) = queue.pop(0)
        if excluded(title):
            opened |= {folder} - {None}
            continue
        out.append((level, (*above, title), folder, href))
        if folder is not None and folder not in opened:
            opened.add(folder)
            queue += [(level + 1, (*above, title), x) for x in shown.get(folder, [])]
    return out


def test_crawl(spark):
    draw = random.Random(4)
    for case in range(3):
        folders = [f"f{i}" for i in range(12)]
        rows = [("root", i, f"t{i}", draw.choice([*folders, None]), f"h{i}") for i in range(5)]
        rows += [(f, i, draw.choice(["a", "b", "skip", None]), draw.choice([*folders, None, None]), f"{f}-{i}") for f in folders for i in range(draw.randint(0, 4))]
        got = crawl.crawl(spark.createDataFrame(rows, LISTING), "root", F.col("title") == "skip").orderBy("level", "uid").collect()
        assert [(r.level, tuple(r.path), r.folder, r.href) for r in got] == plain_crawl(rows, "root", lambda t: t == "skip"), case
        by = {r.uid: r for r in got}
        assert all(r.parent_uid is None or by[r.parent_uid].level == r.level - 1 for r in got)


def test_crawl_is_deep_and_bounded(spark):
    rows = [("root" if i == 0 else f"f{i - 1}", 0, f"t{i}", f"f{i}", None) for i in range(40)] + [("f39", 0, "back", "f3", None)]
    listing = spark.createDataFrame(rows, LISTING).coalesce(1)
    assert crawl.crawl(listing, "root", F.lit(False)).agg(F.max("level"), F.count("*")).first() == (40, 41)
    with pytest.raises(ValueError, match="more than 10 nodes"):
        crawl.crawl(listing, "root", F.lit(False), max_nodes=10)
    assert crawl.crawl(listing, "nowhere", F.lit(False)).count() == 0


def test_closure(spark):
    rows = [(f"n{i}", None if i == 0 else f"n{(i - 1) // 2 if i < 20 else i - 1}") for i in range(60)] + [("alone", "unknown")]
    parent = dict(rows)
    want = set()
    for n in parent:
        at, d = n, 0
        while at in parent:
            want.add((at, n, d))
            at, d = parent[at], d + 1
    got = {tuple(r) for r in crawl.closure(spark.createDataFrame(rows, "id string, parent string"), "id", "parent").collect()}
    assert got == want
    with pytest.raises(ValueError, match="loop"):
        crawl.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id string, parent string"), "id", "parent")


# keyset scans
KEYED = "at timestamp, id long, name string"


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    spark.dataSource.register(keyset.KeysetSource)
    path = str(tmp_path_factory.mktemp("keyset") / "pages")
    rows = [(datetime(2024, 1, 1 + i // 9), i, f"n{i}") for i in range(95)]
    keyset.record(spark.createDataFrame(rows, KEYED).repartition(5), ["at", "id"], 10, path)
    return path, rows


def scan(spark, path, **options):
    return spark.read.format("keyset").schema(KEYED).option("path", path).option("keys", "at,id").option("page_size", 10).options(**options)


def test_keyset_batch(spark, recorded):
    path, rows = recorded
    assert len(glob.glob(f"{path}/page=*")) == 10
    for per_task in (1, 3, 100):
        df = scan(spark, path, pages_per_task=per_task).load()
        assert df.rdd.getNumPartitions() == -(-10 // per_task)
        assert [(r.at, r.id, r.name) for r in df.collect()] == rows
    bounded = scan(spark, path, ceiling='["2024-01-05T00:00:00.000Z", 40]', lower='["2024-01-03T00:00:00.000Z", 0]').load()
    assert sorted(r.id for r in bounded.collect()) == [i for i, _ in ((r[1], r) for r in rows) if 18 <= i <= 40]


def broken(path, to, change):
    """A copy of recorded pages with one page's lines changed."""
    for f in sorted(glob.glob(f"{path}/page=*/*.json")):
        lines = open(f).read().splitlines()
        number = int(f.split("page=")[1].split("/")[0])
        lines = change(number, lines)
        if lines is not None:
            os.makedirs(f"{to}/page={number}")
            with open(f"{to}/page={number}/part.json", "w") as out:
                out.write("\n".join(lines) + "\n")
    return str(to)


@pytest.mark.parametrize(
    ("change", "told"),
    [
        (lambda n, x: x[::-1] if n == 4 else x, "after"),
        (lambda n, x: x + x[-1:] if n == 9 else x, "after"),
        (lambda n, x: x[:-1] if n == 4 else x, "short"),
        (lambda n, x: x + [x[-1].replace('"n', '"m')] if n == 2 else x, "asked for"),
        (lambda n, x: None if n == 4 else x, "missing"),
    ],
)
def test_keyset_faults(spark, recorded, tmp_path, change, told):
    path = broken(recorded[0], tmp_path, change)
    with pytest.raises(Exception, match=told):
        scan(spark, path, pages_per_task=1).load().collect()


def test_keyset_across_tasks(spark, recorded, tmp_path):
    """The same page twice: each page is in order, only the bound that a task is given tells."""
    held = {}
    path = broken(recorded[0], tmp_path, lambda n, x: held.setdefault(n, x) if n != 4 else held[3])
    with pytest.raises(Exception, match="after"):
        scan(spark, path, pages_per_task=1).load().collect()


def test_keyset_stream_restarts(spark, recorded, tmp_path):
    """Three runs of a stream, a new page between them, give the rows of the batch read, each once."""
    path, rows = recorded
    grown = tmp_path / "pages"
    place = lambda low, high: [broken(path, grown, lambda n, x: x if n == k else None) for k in range(low, high)]
    for low, high in ((0, 4), (4, 5), (5, 10)):
        place(low, high)
        stream = spark.readStream.format("keyset").schema(KEYED).option("path", str(grown)).option("keys", "at,id").option("page_size", 10).option("pages_per_task", 2).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == min(high * 10, 95)
    assert sorted((r.at, r.id, r.name) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == rows


# authoritative versions
def test_authoritative(spark, tmp_path):
    """Out of order, twice and over several batches: the stream ends where the batch does."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    authoritative.configure(spark)
    try:
        draw = random.Random(3)
        at = lambda h: datetime(2024, 1, 1, h // 60, h % 60)
        rows = [(f"k{draw.randint(0, 9)}", f"v{draw.randint(0, 99):02d}", draw.random() < 0.2, draw.random() < 0.4, at(i), f"p{i}") for i in range(60)]
        rows += rows[10:20] + [("only-old", "v1", False, True, at(5), "x"), ("unknown", "v1", False, False, at(6), "y")]
        back = spark.createDataFrame([(f"k{i}", "v00", f"back{i}") for i in range(0, 10, 2)] + [("only-old", "v0", "z"), ("never", "v0", "n")], "id string, order_key string, payload string")
        draw.shuffle(rows)
        src = str(tmp_path / "in")
        for i in range(0, len(rows), 25):
            spark.createDataFrame(rows[i : i + 25], authoritative.VERSION).coalesce(1).write.mode("append").parquet(src)
            time.sleep(0.05)
        # a row far ahead moves the watermark, so that all timers fire
        spark.createDataFrame([("late", "v9", True, True, datetime(2024, 2, 1), "l")], authoritative.VERSION).coalesce(1).write.mode("append").parquet(src)
        changes = []

        def keep(df, batch):
            changes.extend((batch, *r) for r in df.collect())

        for _ in range(2):  # a restart in the middle
            stream = spark.readStream.schema(authoritative.VERSION).option("maxFilesPerTrigger", 1).parquet(src)
            q = authoritative.resolved(stream, back, "1 year").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start()
            q.awaitTermination()
            spark.createDataFrame([("later", "v9", True, True, datetime(2026, 2, 1), "l")], authoritative.VERSION).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(authoritative.VERSION).option("maxFilesPerTrigger", 1).parquet(src)
        authoritative.resolved(stream, back, "1 year").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
        last = {}
        for _, i, order_key, payload, origin in sorted(changes, key=lambda c: c[0]):
            last[i] = (order_key, payload, origin)
        whole = spark.read.parquet(src)
        want = {r.id: (r.order_key, r.payload, r.origin) for r in authoritative.resolved_batch(whole, back).collect()}
        assert last == want and {o for *_, o in want.values()} == {"version", "fallback", "missing"}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


# payloads
def digest_of_files(root):
    return {f: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{root}/data-*/**/*.parquet", recursive=True)}


def test_payloads(spark, tmp_path):
    at = lambda d: datetime(2024, 1, d)
    make = lambda rows: spark.createDataFrame(rows, payloads.FETCHED)
    held = payloads.Payloads(spark, str(tmp_path / "p"), buckets=8)
    assert held.read().count() == 0 and held.version() == 0
    first = [(f"d{i}", f"/d{i}", "success", 200, None, f"body {i}".encode(), at(1)) for i in range(40)] + [("gone", "/gone", "failed", 500, "boom", None, at(1)), (None, "/x", "success", 200, None, b"", at(1))]
    assert held.update(make(first)) == {"version": 1, "rewritten": 8}
    files = digest_of_files(tmp_path / "p")
    # nothing new: no version
    assert held.update(make(first[:3])) == {"version": 1, "rewritten": 0}
    # a failure after a success keeps the payload; of two answers the later holds; one bucket each
    told = held.update(make([("d3", "/d3", "failed", 503, "busy", None, at(2)), ("d3", "/d3", "missing_content", 200, "empty", None, at(3)), ("d5", "/d5", "success", 200, None, b"body 5", at(2))]))
    assert told == {"version": 2, "rewritten": 1}
    now = {r.canonical_id: r for r in held.read().collect()}
    assert len(now) == 41 and bytes(now["d3"].content) == b"body 3" and now["d3"].status == "success" and now["d3"].downloaded_at == at(1)
    assert (now["d3"].refresh_status, now["d3"].refresh_http_status, now["d3"].refresh_error, now["d3"].refresh_attempted_at) == ("missing_content", 200, "empty", at(3))
    assert now["gone"].status == "failed" and now["gone"].content is None and now["d5"].refresh_status is None
    after = digest_of_files(tmp_path / "p")
    assert all(after[f] == d for f, d in files.items()) and len({f for f in after if f not in files}) == 1
    assert len([1 for (b, f), (c, g) in zip(held.listing(1), held.listing(2), strict=True) if f != g]) == 1
    # success clears the note, and a first success replaces a failure
    held.update(make([("d3", "/d3", "success", 200, None, b"new", at(4)), ("gone", "/gone", "success", 200, None, b"", at(4))]))
    now = {r.canonical_id: r for r in held.read().collect()}
    assert bytes(now["d3"].content) == b"new" and now["d3"].refresh_status is None and now["gone"].status == "success" and now["gone"].sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.canonical_id: r.refresh_status for r in held.read(2).collect()}["d3"] == "missing_content"
    # an update that breaks off before its listing is there changes nothing, and doesn't stand in the way of the next
    version = held.version()
    os.makedirs(tmp_path / "p" / f"data-{version + 1:08d}-0")
    assert held.update(make([("d9", "/d9", "success", 200, None, b"nine", at(5))]))["version"] == version + 1
    with pytest.raises(stored.StoredError):
        held.read(99)


# digest trees
def test_digest_tree(spark, tmp_path):
    root = str(tmp_path / "g")
    for t, n in (("a", 50), ("b", 30)):
        spark.range(n).repartition(4).write.parquet(f"{root}/{t}")
    tree = digests.DigestTree.build(spark, root, str(tmp_path / "t1"))
    assert tree.tables().count() == 2
    start = tree.at_start(root)
    assert start.faults == () and start.bytes_read == 0 and start.files == 8
    assert tree.full(root).faults == ()
    # an update: one more file, the others aren't read
    spark.range(5).coalesce(1).write.mode("append").parquet(f"{root}/b")
    assert [f for _, f in tree.at_start(root).faults] == ["new"]
    after, told = tree.after_update(root, str(tmp_path / "t2"))
    assert told.files_read == 1 and told.files == 9 and 0 < told.bytes_read < tree.full(root).bytes_read / 4 and told.digest != tree.told
    assert after.full(root).faults == () and after.tables().where("table = 'a'").first().digest == tree.tables().where("table = 'a'").first().digest
    # a flipped byte with the old length and time: only reading everything tells
    file = sorted(glob.glob(f"{root}/a/*.parquet"))[0]
    stat, data = os.stat(file), bytearray(open(file, "rb").read())
    data[50] ^= 1
    open(file, "wb").write(bytes(data))
    os.utime(file, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    for crc in glob.glob(f"{root}/a/.*.crc"):
        os.remove(crc)
    assert after.at_start(root).faults == () and [f for _, f in after.full(root).faults] == ["content"]
    os.remove(file)
    assert [f for _, f in after.at_start(root).faults] == ["missing"]


# snapshots
def test_stable_snapshot(spark):
    base = spark.range(100).select(F.col("id"), (F.col("id") * 2).alias("v"))
    scans = []

    def moving(until):
        def scan(i):
            scans.append(i)
            return base if i >= until else base.where(F.col("id") % (i + 2) != 0)

        return scan

    rows, seal, made = snapshots.stable(moving(0), "id")
    assert made == 2 and seal.rows == rows.count() == 100
    rows, seal, made = snapshots.stable(moving(2), "id")
    assert made == 4 and rows.count() == 100
    with pytest.raises(snapshots.Unstable):
        snapshots.stable(moving(9), "id")
    # same count and bounds, another value
    other = base.withColumn("v", F.when(F.col("id") == 50, 1).otherwise(F.col("v")))
    assert snapshots.sealed(base, "id", ["id", "v"]).digest != snapshots.sealed(other, "id", ["id", "v"]).digest
    assert snapshots.sealed(spark.createDataFrame([(None, "a")], "x string, y string"), "x", ["x", "y"]) != snapshots.sealed(spark.createDataFrame([("a", None)], "x string, y string"), "x", ["x", "y"])


def test_coverage(spark):
    rows = [("ok", 1, 10, 25), ("ok", 11, 25, 25), ("gap", 1, 5, 9), ("gap", 8, 9, 9), ("over", 1, 10, 12), ("over", 3, 4, 12), ("over", 11, 12, 12), ("short", 1, 3, 7), ("moved", 1, 3, 6), ("moved", 4, 6, 5), ("late", 2, 4, 4)]
    got = sorted(tuple(r) for r in snapshots.coverage_faults(spark.createDataFrame(rows, "k string, a long, b long, n long"), ["k"], "a", "b", "n").collect())
    assert got == [("gap", "gap", 6, 7), ("late", "gap", 1, 1), ("moved", "moving total", 5, 6), ("over", "overlap", 3, 4), ("short", "short", 4, 7)]


def test_seek_paging(spark, tmp_path):
    draw = random.Random(1)
    rows = [(i, draw.choice([0.1, 0.2, 1 / 3, 7.0])) for i in range(100)] + [(200, None), (201, float("nan"))]
    ranking = snapshots.Ranking.store(spark.createDataFrame(rows, "chunk_id long, score double"), str(tmp_path / "r"), "r1")
    want = sorted([r for r in rows if r[1] is not None and r[1] == r[1]], key=lambda r: (-r[1], r[0]))
    for size in (1, 7, 100, 1000):
        got, cursor = [], None
        while True:
            page, cursor = ranking.page(size, cursor)
            got += [(r.chunk_id, r.score) for r in page.collect()]
            if cursor is None or len(got) > 200:
                break
            if size == 1 and len(got) == 5:
                break
        assert got == want[: len(got)] and (size == 1 or len(got) == 100)
    _, cursor = ranking.page(3)
    with pytest.raises(ValueError, match="another ranking"):
        snapshots.Ranking(ranking.rows, "r2").page(3, cursor)
    with pytest.raises(ValueError, match="cursor"):
        ranking.page(3, "!!")
    with pytest.raises(ValueError):
        ranking.page(0)
    assert json.loads(__import__("base64").urlsafe_b64decode(cursor + "=="))["ranking"] == "r1"
