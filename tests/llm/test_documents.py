"""Operators on single documents against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import chat, mixing, ordermin, packing, quality, queries_a, secrets, textkit, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, row string"
WS = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in WS.split(text or "") if w]


def frame(spark, texts, extra=True):
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "a", "b")[i % 3], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    yield df
    df.unpersist()


ODD = [None, "", " \t\n ", "word", "word", "é" * 50 + "  x", "a b c " * 3000, "x\ny\nx\n\n \nx"]


# secrets
BASE = [
    ("assign", re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
]


def base_spans(text):
    found = []
    for k, (kind, p, group, least) in enumerate(BASE):
        found += [(m.start(), k, m.end(), kind) for m in p.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


def test_secrets(spark, documents):
    tricky = [
        "password=token:abcdefghij", "PassWord : 'abcdefgh' secret=short", "AKIA1234567890ABCD AKIAxx AKIA" + "Z" * 11,
        "x" + "0123456789abcdef" * 3 + "g", "é€ token==abc.def-ghi api_key=12345678", "ſecret=abcdefgh apikey: \"A\" api__key=abcdefgh",
    ]
    df = frame(spark, ODD + tricky).unionByName(documents.withColumn("spans", F.lit("x")).withColumn("row", F.lit("y")).withColumn("doc_id", F.col("doc_id") + 1000))
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        want = base_spans(t)
        counts = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, got[k].spans, want)
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(counts[x] for x in ("assign", "access", "hex"))
        assert [x for x in got[k].spans.split(",") if x and not x.startswith("token")] == [x for x in want.split(",") if x]


def test_ownership(spark):
    own, shared = "a8Xk29Lmq0Zt47Rv51Wp", "b8Xk29Lmq0Zt47Rv51Wp"
    rows = [(1, own, "en", "s1"), (2, own, "en", "s1"), *[(10 + i, shared, "en", f"s{i}") for i in range(5)]]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1].spans == got[2].spans == f"token:0:{len(own)}" and got[10].spans == ""
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


# quality
def test_quality_counts(spark, documents):
    df = frame(spark, ODD)
    texts = {r.doc_id: r.text for r in df.union(documents.select("*", F.lit("x"), F.lit("y")).withColumn("doc_id", F.col("doc_id") + 1000)).collect()}
    got = {r.doc_id: r for r in quality.assess(df.union(documents.select("*", F.lit("x"), F.lit("y")).withColumn("doc_id", F.col("doc_id") + 1000))).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        w, t = words(t), t or ""
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = set()
        for i in range(len(w) - 2):
            if windows[tuple(w[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in got.values()) > 0.5 * len(documents.collect())


def test_quality_filter_keeps_rows(spark, documents):
    kept = quality.assess(documents, keep_columns=True)
    assert kept.columns == documents.columns
    assert quality.assess(documents.limit(0)).count() == 0
    odd = frame(spark, ODD)
    assert quality.assess(odd, keep_columns=True).columns == odd.columns


def test_bands_reject_what_is_far_outside(spark, documents):
    rng = random.Random(1)
    junk = " ".join("".join(rng.choice("ʘʬΩ⨀⨁⨂") for _ in range(9)) for _ in range(200))
    df = documents.select("doc_id", "text", "lang").union(spark.createDataFrame([(-1, junk, "en")], "doc_id long, text string, lang string"))
    row = quality.assess(df).where("doc_id = -1").first()
    assert not row.base_failed and not row.kept and "byte_share" in row.outside


def ordinary(n, seed, size=300):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(("", "n", "r", "s", "l")) for _ in range(2)) for _ in range(1500)]
    return vocab, [(i, " ".join(rng.choice(vocab) for _ in range(size)), "en") for i in range(n)]


def test_entropy_alone_rejects(spark):
    rng = random.Random(5)
    vocab, rows = ordinary(120, 4)
    few = " ".join(rng.choice(vocab[:20]) for _ in range(300))
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame([*rows, (-1, few, "en")], "doc_id long, text string, lang string")).collect()}
    assert not got[-1].base_failed and not got[-1].kept and got[-1].outside == "entropy"
    assert all(got[i].kept for i in range(120))


def test_rare_languages_have_the_band_of_script_or_corpus(spark):
    rng = random.Random(6)
    _, rows = ordinary(120, 7)
    latin = " ".join("".join(rng.choice("qxzjkvw") for _ in range(9)) for _ in range(200))
    odd = " ".join("".join(rng.choice("ʘʬ⨀⨁⨂") for _ in range(9)) for _ in range(200))
    rare = [(-1, latin, "zz"), (-2, odd, "zz"), (-3, latin, "invented"), (-4, odd, None), (-5, rows[0][1], "zz")]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame([*rows, *rare], "doc_id long, text string, lang string")).collect()}
    assert [got[i].kept for i in (-1, -2, -3, -4, -5)] == [False] * 4 + [True]


# toxicity
def test_toxicity_learns_planted_words():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda bad: " ".join(rng.choice(vocab) for _ in range(60)) + (" grobian" + rng.choice(["en", "s", "ly"]) if bad else "")
    labels = np.array([i % 2 for i in range(400)])
    ids = [toxicity.word_numbers(text(y).encode()) for y in labels]
    model = toxicity.train(ids, labels, 0.5)
    held = np.array([i % 2 for i in range(200)])
    scores = np.array([model.score(toxicity.word_numbers(text(y).encode())) for y in held])
    assert toxicity.auc(scores, held) > 0.95
    assert 0 <= model.score(toxicity.word_numbers(b"")) <= 1


def test_toxicity_contract(spark, documents):
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    df = frame(spark, ODD)
    rows = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert {round(r.score, 9) for r in rows if r.doc_id in (0, 1, 2)} and toxicity.fit(df, labels.limit(0)).score(np.empty((0, 2), np.int32)) == 0.5


# fingerprints
def test_fingerprints(spark):
    texts = [*ODD, "the quick brown fox jumps " * 20, "ends here"]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in ordermin.fingerprints(df).collect()}
    n = len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i - 1) % n] or ""
        other = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert got[i].fingerprint == ordermin.told(ordermin.fingerprint(t)) and got[i].edited_fingerprint == ordermin.told(ordermin.fingerprint(other))
    assert got[3].fingerprint == got[4].fingerprint
    assert ordermin.fingerprints(df.limit(0)).count() == 0
    assert ordermin.fingerprints(df.where("doc_id = 8")).first().near_next == 1.0


def test_order_matters_and_occurrences_are_numbered():
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(6)]
    a, moved = "".join(parts), "".join(parts[::-1])
    fp = ordermin.fingerprint
    near = ordermin.likeness(fp(a), fp(a[:-3] + "xyz"))
    assert near > 0.8 > ordermin.likeness(fp(a), fp(moved)) > ordermin.likeness(fp(a), fp("".join(rng.choice("stuvw ") for _ in range(1200))))
    h = ordermin.kmers("abcabcabcabcabcabcabc")
    assert len(set(h.tolist())) == len(h)


# chat
def test_chat_round_trip(spark):
    rng = random.Random(9)
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok", "&lt;| &amp;", "<", "|>", "\n", None, "", "a " * 1500]
    rows = []
    for c in [*range(30), None]:
        n = rng.choice([1, 2, 5, 600]) if c == 7 else rng.randrange(1, 9)
        for t in range(n):
            rows.append((c, None if rng.random() < 0.02 else t, "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "to\nol"]), rng.choice(nasty) if rng.random() < 0.3 else "word " * rng.randrange(90)))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(df, budget=300, history_budget=60).cache()
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r, x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        target = [len(x) for _, r, x in turns if r == "assistant"]
        assert got[c].n_turns == len(turns) and got[c].loss_chars == sum(target)
    for r in made.collect():
        assert r.formatted.count("<|im_start|>") == r.n_own + r.n_repeated == r.formatted.count("<|im_end|>\n")
        assert r.n_own == 1 or r.formatted.replace("<|im_start|>", " ").replace("<|im_end|>", " ").count("word") <= 300


def test_chat_digests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {r.conv_id: r for r in queries_a.op9_chat_windows(spark, sf_dir).collect()}
    convs = defaultdict(list)
    for r in rows.collect():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    convs[-1] = [(0, "user", said), (1, "assistant", said)]
    for c, turns in convs.items():
        turns.sort()
        whole, target = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha(whole), len(target), sha(target))


# mixing
def test_targets_by_iteration():
    sizes, weights = [100, 10, 1000, 0], [5, 2, 1, 5]
    got = mixing.shares(sizes, weights)
    assert sum(got) == pytest.approx(1110) and got[0] == 300 and got[1] == 30 and got[3] == 0 and got[2] == pytest.approx(780)


def test_fit_hits_the_budget():
    rng = random.Random(2)
    for seed in range(25):
        lengths = rng.sample(range(1, 400), rng.randrange(1, 60))
        counts = [rng.randrange(1, 30) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts, strict=True))
        budget = rng.randrange(0, total + 1)
        taken = mixing.fit(lengths, counts, budget, seed)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert abs(sum(a * t for a, t in zip(lengths, taken, strict=True)) - budget) <= max(lengths)


def test_mix(spark, documents):
    a, b = ({r.doc_id: r for r in mixing.plan(documents).collect()} for _ in range(2))
    assert a == b
    by = defaultdict(list)
    for r in documents.collect():
        assert a[r.doc_id].size == len(words(r.text))
        by[r.source].append(a[r.doc_id])
    names = sorted(by)
    want = mixing.shares([sum(x.size for x in by[n]) for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for n, t in zip(names, want, strict=True):
        assert by[n][0].target == pytest.approx(t) and abs(sum(x.taken for x in by[n]) - t) <= max(x.size for x in by[n])
        assert all(x.taken % max(x.size, 1) == 0 and x.taken <= 3 * x.size for x in by[n])
    odd = frame(spark, ODD + ["same words here"] * 50)
    assert mixing.plan(odd).count() == len(ODD) + 50
    assert mixing.mix(odd).columns == odd.columns and mixing.plan(odd.limit(0)).count() == 0


# packing
def test_packing(spark, documents):
    df = frame(spark, ODD).union(documents.select("*", F.lit("x"), F.lit("y")))
    rows = packing.pack(df, capacities=(64, 256, 1024), shard_rows=70).toPandas()
    want = Counter()
    for r in df.collect():
        want[r.doc_id] += len(words(r.text))
    assert rows.groupby("doc_id").length.sum().to_dict() == {k: v for k, v in want.items() if v}
    for _, b in rows.sort_values("slot").groupby(["shard", "bin"]):
        assert b.length.sum() == b.fill.iloc[0] <= b.capacity.iloc[0] and b["at"].tolist() == [0, *b.length.cumsum().tolist()[:-1]]
        assert b.capacity.iloc[0] == min(c for c in (64, 256, 1024) if c >= b.fill.iloc[0])
    assert packing.pack(df.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_bin():
    where, fill = packing.best_fit([7, 5, 3, 3, 2], (10,), 10)
    assert where == [0, 1, 0, 1, 1] and fill == [10, 10]


def test_word_hashes_agree_with_words():
    text = "Über  die\tBrücke\x0bgehen The the\n"
    h = textkit.word_hashes(text.encode())
    assert len(h) == len(words(text)) and h[-1] == h[-2] and len(set(h.tolist())) == len(h) - 1
    assert textkit.shingle_set(b"a b", 4).size == 1 and textkit.shingle_set(b" ", 4).size == 0


def test_packing_is_the_same_however_rows_are_dealt(spark, documents):
    df = documents.union(documents.where("doc_id < 20")).union(documents.where("doc_id < 5"))
    columns = ["shard", "bin", "capacity", "fill", "slot", "at", "doc_id", "piece", "copy", "length"]
    a, b = ({tuple(r) for r in packing.pack(x, shard_rows=60).select(columns).collect()} for x in (df, df.repartition(7)))
    assert a == b


def test_priced_opening():
    rng = random.Random(3)
    for _ in range(30):
        lengths = sorted((rng.randrange(1, 90) for _ in range(rng.randrange(1, 9))), reverse=True)
        where, sizes, fill = packing.pack_shard(lengths, (32, 64, 96), 4)
        held = [sum(n for n, w in zip(lengths, where, strict=True) if w == b) for b in range(len(fill))]
        assert held == fill and all(f <= s for f, s in zip(fill, sizes, strict=True))

        def cheapest(rest, bins):  # every way to put the pieces into bins
            if not rest:
                return sum(min(c for c in (32, 64, 96) if c >= b) + 4 for b in bins)
            found = [cheapest(rest[1:], [*bins, rest[0]])]
            for i, b in enumerate(bins):
                if b + rest[0] <= 96:
                    found.append(cheapest(rest[1:], [*bins[:i], b + rest[0], *bins[i + 1 :]]))
            return min(found)

        best = cheapest(lengths, [])
        assert best <= sum(sizes) + 4 * len(sizes) <= 1.25 * best
    # two of 40 fill a bin of 96 worse than one of 40 fills 64 with a 20
    assert packing.least_cost(60, [30, 60], {30: 1, 60: 2}, (64, 96), 4) == 96


def test_sequences(spark, documents):
    packed = packing.pack(documents, capacities=(64, 256), shard_rows=50)
    seq = packing.sequences(documents, packed, top=256).collect()
    assert len(seq) == packed.select("shard", "bin").distinct().count()
    assert all(len(r.tokens) == r.fill == len(r.segments) and max(r.segments) + 1 == len(r.doc_ids) for r in seq)


def test_short_texts_fill_every_cell_and_feel_order():
    a = "one two three four five six seven eight nine ten"
    x, y, z = (ordermin.fingerprint(t) for t in (a, a[:-3] + "xyz", a[25:] + a[:25]))
    assert (x > 0).all() and 0.5 < ordermin.likeness(x, y) < 1 and ordermin.likeness(x, z) < ordermin.likeness(x, y)
    assert ordermin.likeness(ordermin.fingerprint("ab"), ordermin.fingerprint("ab")) == 1 and not ordermin.fingerprint("").any()


def test_mix_of_ties_and_many_sources(spark, documents, monkeypatch):
    rows = [(i % 3, " ".join(["w"] * 4 + [str(i)]), f"s{i % 40}") for i in range(400)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = lambda d: sorted(tuple(r) for r in mixing.plan(d).collect())
    want = told(df)
    assert told(df.repartition(9)) == want
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert told(df) == want
    monkeypatch.setattr(mixing, "GROUP", 3)
    assert told(df) == want


def test_thresholds_from_histograms(spark):
    rows = [(i, "en" if i % 2 else "de", (i % 100) / 100) for i in range(2000)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, score double")
    labels = spark.createDataFrame([(i, int(s >= (0.3 if lang == "en" else 0.7))) for i, lang, s in rows], "doc_id long, toxic int")
    got = toxicity.thresholds(scored, labels, [1, 2])
    assert got["en"] == pytest.approx(0.31, abs=0.011) and got["de"] == pytest.approx(0.7, abs=0.011) and "*" in got
    assert toxicity.thresholds(scored, labels.where("toxic > 1"), []) == {}
