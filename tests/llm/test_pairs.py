"""Operators that compare documents or lines, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lodestack.llm import chaining, linededup, neardup, quality, textkit, unionfind

WS = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, th string"


def words(text):
    return [w for w in WS.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def family(seed, n, size=120, edits=6):
    """A text and near copies of it, each with a few words replaced."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdefghij" for b in ("lo", "mi", "ne", "ra", "su", "ti")]
    base = [rng.choice(vocab) + rng.choice(vocab) for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(size)] = rng.choice(vocab) + "x"
        out.append(" ".join(copy))
    return out


ODD = [None, "", " \n ", "one", "one two three", "One two  three", "one two three four"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x") for i, t in enumerate(texts)], DOCS)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5), (None, 3)]
    u = Union({x for e in edges for x in e if x is not None})
    for a, b in edges:
        if a is not None:
            u.join(a, b)
    got = {r.node: r.root for r in unionfind.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: u.find(x) for x in linked}
    assert unionfind.components(spark.createDataFrame([], "a long, b long")).count() == 0


def classes_by_force(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    inverted = defaultdict(list)
    for i, s in sets.items():
        for e in s:
            inverted[e].append(i)
    common = defaultdict(int)
    for ids in inverted.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] += 1
    u = Union(sets)
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            u.join(a, b)
    return {i: (len(s), u.find(i), u.find(i) == i) for i, s in sets.items()}


def test_near_duplicates(spark, sf_dir):
    texts = [*ODD, *family(1, 60), *family(2, 60, edits=14), *family(3, 5)[:1] * 4]
    df = frame(spark, texts).union(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars", "7L", "'x'"))
    want = classes_by_force({r.doc_id: r.text for r in df.collect()}, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(df, 4, 80).collect()}
    assert got == want
    stay = neardup.deduplicate(df.union(df.where("doc_id = 7")), 4, 80)
    assert stay.columns == df.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i, v in want.items() if v[2])
    assert neardup.classes(df.limit(0)).count() == 0
    nulls = df.where("doc_id = 3").selectExpr("cast(null as long) as doc_id", "text", "lang")
    assert neardup.classes(nulls.union(nulls)).count() == 2 and neardup.deduplicate(nulls.union(nulls)).count() == 1


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    for shared in (100, 400, 900):
        a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        b = np.concatenate((a[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)))
        same = (neardup.superminhash(np.unique(a)) == neardup.superminhash(np.unique(b))).mean()
        assert abs(same - shared / (2000 - shared)) < 0.12
    few = np.array([5, 9], np.uint64)
    assert np.isfinite(neardup.superminhash(few)).all() and np.isinf(neardup.superminhash(few[:0])).all()


def lines_by_force(texts, percent, min_chars):
    """Line numbers to drop, of each document."""
    places = defaultdict(list)
    for i, t in texts.items():
        for n, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\r\x0b\x0c").lower()
            if len(line) >= min_chars:
                places[line].append((i, n))
    grams = {x: frozenset(x[k : k + 5] for k in range(len(x) - 4)) or frozenset([x]) for x in places}
    inverted = defaultdict(list)
    for x, s in grams.items():
        for g in s:
            inverted[g].append(x)
    u = Union(places)
    for x, s in grams.items():
        seen = defaultdict(int)
        for g in s:
            for y in inverted[g]:
                if y > x:
                    seen[y] += 1
        for y, c in seen.items():
            if 100 * c >= percent * (len(s) + len(grams[y]) - c):
                u.join(x, y)
    groups = defaultdict(list)
    for x, where in places.items():
        groups[u.find(x)] += where
    gone = defaultdict(set)
    for where in groups.values():
        for i, n in sorted(where)[1:]:
            gone[i].add(n)
    return gone


def test_line_dedup(spark, sf_dir):
    fuzzy = ["The quick brown fox jumps over the lazy dog and runs far away into the dark wood", "The quick brown fox jumps over the lazy dog and runs far away into the dark woods", "  THE QUICK brown fox jumped over the lazy dog and runs far away into the dark wood\r"]
    texts = [*ODD, "\n".join(fuzzy), "keep me here please\nkeep me here please\nshort\nshort", fuzzy[0] + "\nanother line that nobody else has", *family(4, 25, size=25, edits=2)]
    df = frame(spark, texts).union(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars", "7L", "'x'"))
    plain = {r.doc_id: r.text for r in df.collect()}
    want = lines_by_force(plain, 80, linededup.MIN_CHARS)
    got = {r.doc_id: r for r in linededup.deduplicate(df, report=True).collect()}
    assert set(got) == set(plain)
    assert {i: {int(x) for x in r.dropped.split(",")} for i, r in got.items() if r.dropped} == {i: v for i, v in want.items() if v}
    clean = linededup.deduplicate(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        t = plain[r.doc_id]
        assert r.text == (t if not want[r.doc_id] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[r.doc_id]))
    assert linededup.deduplicate(df.limit(0)).count() == 0


def test_lines_without_or_with_few_blanks(spark):
    """Equal but for their beginning or one character: candidates must come from every position of a line."""
    rng = random.Random(9)
    run = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    han = "".join(map(chr, range(0x4E00, 0x4F00)))
    texts = []
    for k in range(12):
        body, url, row = run(90, han), run(110, "abcdefghijklmnop/"), "\t".join(run(9, "abcdefgh") for _ in range(9))
        few = [run(50, "abcdefghijklmnop"), run(50, "abcdefghijklmnop")]
        for a, b in ((f"{k}、" + body, f"{k + 40}、" + body), ("http://" + url, "ftp://" + url), (f"{k}\t" + row, f"{k + 40}\t" + row), (" ".join(few), "x" + " ".join(few)[1:])):
            texts += [a, b]
    plain = dict(enumerate(texts))
    want = {i: v for i, v in lines_by_force(plain, 80, linededup.MIN_CHARS).items() if v}
    assert len(want) == len(texts) // 2
    got = linededup.deduplicate(frame(spark, texts), report=True).collect()
    assert {r.doc_id: {int(x) for x in r.dropped.split(",")} for r in got if r.dropped} == want


def test_chains():
    p, q = np.array([0, 5, 10, 15, 300, 305]), np.array([100, 105, 111, 116, 10, 15])
    got = chaining.chain(p, q)
    assert [x.tolist() for x in got] == [[0, 1, 2, 3], [4, 5]]
    crossing = chaining.chain(np.array([0, 5, 10]), np.array([50, 20, 60]))
    assert sorted(map(len, crossing)) == [1, 2]


def test_chain_scores_against_a_plain_programme():
    rng = random.Random(6)
    for _ in range(30):
        anchors = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
        p, q = (np.array([a[k] for a in anchors]) for k in range(2))
        best = []
        for i, (x, y) in enumerate(anchors):
            options = [best[j] - chaining.GAP_COST * (x - a + y - b) for j, (a, b) in enumerate(anchors[:i]) if a < x and b < y]
            best.append(chaining.GAIN + max([0, *options]))
        first = chaining.chain(p, q)[0]
        total = chaining.GAIN
        for i, j in zip(first, first[1:], strict=False):
            total += chaining.GAIN - chaining.GAP_COST * (p[j] - p[i] + q[j] - q[i])
        assert total == pytest.approx(max(best)) or max(np.diff(p).max(), np.diff(q).max()) > chaining.MAX_GAP


def test_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    noise = lambda n: [word() for _ in range(n)]
    passage = noise(60)
    edited = passage[:20] + ["xx"] + passage[21:40] + passage[41:]
    texts = [*ODD, " ".join(noise(80) + passage + noise(80)), " ".join(noise(30) + edited + noise(10)), " ".join(passage), " ".join(noise(200)), " ".join(noise(40))]
    texts.append(texts[-1])
    rows = chaining.passages(frame(spark, texts)).collect()
    n = len(ODD)
    pairs = {frozenset((r.doc_id, r.other_id)) for r in rows if r.kind == "passage"}
    linked = Union(range(len(texts)))
    for a, b in map(tuple, pairs):
        linked.join(a, b)
    assert len({linked.find(n), linked.find(n + 1), linked.find(n + 2)}) == 1 and all(max(p) <= n + 2 for p in pairs)
    assert [(r.doc_id, r.other_id, r.end) for r in rows if r.kind == "copy"] == [(n + 5, n + 4, 40)]
    for r in rows:
        a, b = words(texts[r.doc_id])[r.start : r.end], words(texts[r.other_id])[r.other_start : r.other_end]
        assert len(set(a) & set(b)) >= 0.9 * len(set(passage if r.kind == "passage" else a)) and r.identity >= chaining.MIN_IDENTITY
    assert chaining.passages(frame(spark, [])).count() == 0


def test_passages_of_sentences_known_from_other_texts(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    noise = lambda n: [word() for _ in range(n)]
    texts, want = [], set()
    for _ in range(12):
        sentences = [noise(20) for _ in range(3)]
        for x in sentences:  # so many that some have a smaller hash than either text below
            texts += [" ".join(noise(30) + x + noise(30)) for _ in range(12)]
        n = len(texts)
        texts += [" ".join(noise(40) + sum(sentences, []) + noise(40)) for _ in range(2)]
        want.add(frozenset((n, n + 1)))
    got = {frozenset((r.doc_id, r.other_id)) for r in chaining.passages(frame(spark, texts)).collect() if r.end - r.start >= 50}
    assert want <= got


def test_all_positions_of_the_head(spark):
    """A passage begins with words that its head text has at an earlier place too."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    noise = lambda n: [word() for _ in range(n)]
    texts = []
    for _ in range(12):
        x = [noise(21) for _ in range(2)]
        body = x[0] + x[1]
        texts += [" ".join(x[1] + noise(90) + x[0] + noise(90) + body + noise(20)), " ".join(x[0] + noise(90) + x[1] + noise(90) + body + noise(60))]
    rows = [r for r in chaining.passages(frame(spark, texts)).collect() if r.end - r.start >= 40]
    assert {frozenset((r.doc_id, r.other_id)) for r in rows} == {frozenset((i, i + 1)) for i in range(0, 24, 2)}


def test_passages_of_one_seed(spark):
    """Least and edited passages, many of which have a single seed in common."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    noise = lambda n: [word() for _ in range(n)]
    texts = []
    for _ in range(60):
        x = noise(32)
        texts += [" ".join(noise(50) + x + noise(50)), " ".join(noise(50) + x + noise(50))]
    pairs = {frozenset((r.doc_id, r.other_id)) for r in chaining.passages(frame(spark, texts)).collect()}
    assert pairs == {frozenset((i, i + 1)) for i in range(0, 120, 2)}


@pytest.mark.parametrize(("size", "edits"), [(60, 6), (60, 9), (120, 18)])
def test_recall_of_edited_passages(spark, size, edits):
    """Passages with a tenth or more of their words replaced, between texts that share nothing else."""
    rng = random.Random(size + edits)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    noise = lambda n: [word() for _ in range(n)]
    texts = []
    for _ in range(80):
        x = noise(size)
        y = list(x)
        for k in rng.sample(range(size), edits):
            y[k] = word()
        texts += [" ".join(noise(50) + x + noise(50)), " ".join(noise(50) + y + noise(50))]
    pairs = {frozenset((r.doc_id, r.other_id)) for r in chaining.passages(frame(spark, texts)).collect()}
    want = {frozenset((i, i + 1)) for i in range(0, len(texts), 2)}
    assert pairs <= want and len(pairs & want) >= 0.9 * len(want)


@pytest.mark.parametrize("kind", ["put in", "left out", "all"])
@pytest.mark.parametrize(("size", "every"), [(80, 12), (100, 15), (60, 10)])
def test_recall_of_passages_with_shifts(spark, kind, size, every):
    """Words put in or left out at regular places: nothing stays on one diagonal for long."""
    rng = random.Random(size + len(kind))
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    noise = lambda n: [word() for _ in range(n)]
    texts = []
    for _ in range(40):
        x, y = noise(size), []
        for i, w in enumerate(x):
            edit = i % every == every - 1
            how = rng.choice(["put in", "left out", "replaced"]) if kind == "all" else kind
            y += [w] if not edit else [word(), w] if how == "put in" else [] if how == "left out" else [word()]
        texts += [" ".join(noise(50) + x + noise(50)), " ".join(noise(50) + y + noise(50))]
    pairs = {frozenset((r.doc_id, r.other_id)) for r in chaining.passages(frame(spark, texts)).collect()}
    want = {frozenset((i, i + 1)) for i in range(0, len(texts), 2)}
    assert pairs <= want and len(pairs & want) >= 0.9 * len(want), len(pairs & want)


def test_extension_over_shifts():
    """Ends in both runs and equal words, against the words that were left in place."""
    rng = random.Random(8)
    for _ in range(200):
        x = [rng.randrange(10**9) for _ in range(rng.randint(5, 120))]
        y, kept = [], 0
        for i, w in enumerate(x):
            how = rng.choice(["put", "out", "new"]) if i % 9 == 8 and i < len(x) - 3 else "keep"
            y += {"put": [rng.randrange(10**9), w], "out": [], "new": [rng.randrange(10**9)], "keep": [w]}[how]
            kept += how in ("put", "keep")
        tail = [rng.randrange(10**9) for _ in range(20)]
        ka, kb, equal = chaining._extend(np.array(x + tail), np.array(y + [v + 1 for v in tail]))
        assert (ka, kb, equal) == (len(x), len(y), kept)
    assert chaining._extend(np.array([1, 2]), np.array([3, 4])) == (0, 0, 0) and chaining._extend(np.array([], int), np.array([1])) == (0, 0, 0)


def test_long_passages_of_known_sentences(spark):
    """Two texts share a long passage each sentence of which, but no two in a row, earlier texts hold too."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    noise = lambda n: [word() for _ in range(n)]
    texts, want = [], set()
    for _ in range(10):
        sentences = [noise(22) for _ in range(8)]
        for x in sentences:
            texts += [" ".join(noise(20) + x + noise(20)) for _ in range(6)]
        n = len(texts)
        texts += [" ".join(noise(20) + sum(sentences, []) + noise(20)) for _ in range(2)]
        want.add(frozenset((n, n + 1)))
    longest = {}
    for r in chaining.passages(frame(spark, texts)).collect():
        key = frozenset((r.doc_id, r.other_id))
        longest[key] = max(longest.get(key, 0), r.end - r.start)
    assert all(longest.get(k, 0) >= 150 for k in want)


def test_seed_density():
    rng = random.Random(1)
    data = " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000)).encode()
    h, at = chaining.seeds(data)
    density = 2 / (chaining.WINDOW + 1)
    assert np.diff(at).max() <= chaining.WINDOW and 0.7 * density < len(at) / 2000 < 1.4 * density
    assert (textkit.windows(textkit.word_hashes(data), chaining.K)[at].view(np.int64) == h).all()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, sf_dir).cache()
        assert kept.columns == names, name
        if name == "quality rules":
            good = {r.doc_id for r in quality.assess(before).collect() if r.kept}
            assert {r.doc_id for r in kept.collect()} == good
        if name == "near-duplicates":
            want = classes_by_force({r.doc_id: r.text for r in before.collect()}, 5, 80)
            assert {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if v[2]}
    sizes = {r.doc_id: len(words(r.text)) for r in kept.collect()}
    rows = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).toPandas()
    assert rows.length.sum() == sum(sizes[r.doc_id] for r in kept.collect())
