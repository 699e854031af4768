"""Operators on a corpus and its target, vectors and pages against plain versions of their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestack.llm import importance, importance_sql, queries_c, registry, whitening
from tests.compare import difference

DOCS = "doc_id long, text string, weight string, rank string, a string, mid string, codes string, part long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", "r", "a", "m", "c", 1) for i, t in rows], DOCS)


# importance resampling
def grams(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    code = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(code, grams(text, longest)[1]))
    for text in target:
        t.update(map(code, grams(text, longest)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {c: math.floor(1000 * math.log((t[c] + 1) * (all_s + buckets) / ((s[c] + 1) * (all_t + buckets)))) for c in s}
    rows = []
    for i, text in docs:
        n, g = grams(text, longest)
        weight = sum(gain[code(x)] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return rows


def known(rows):
    return Counter(tuple(r)[:5] for r in rows)


@pytest.mark.parametrize("longest", [1, 3])
def test_resample(spark, longest):
    draw = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ǅx", "𝒳y", "a_b", "X'y"]
    rows = [(i, " ".join(draw.choice(vocabulary, draw.integers(0, 60)))) for i in range(150)]
    rows += [(None, "x " * 30), (200, None), (201, ""), (202, " .,\n"), (203, "one"), (7, rows[7][1]), (7, rows[7][1]), (8, "other text " * 20), (204, "long text " * 40_000)]
    target = [" ".join(draw.choice(vocabulary[:20], 50)) for _ in range(9)] + [None, ""]
    docs = docs_of(spark, rows).repartition(5)
    got = importance.resample(docs, docs_of(spark, enumerate(target)), longest=longest, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert known(got.collect()) == known(plain_resample(rows, target, longest, percent=30))


def test_resample_edges(spark):
    none = docs_of(spark, [])
    some = docs_of(spark, [(1, "a b " * 15), (2, None)])
    assert importance.resample(none, some).count() == 0
    assert known(importance.resample(some, none, percent=100).collect()) == known(plain_resample([(1, "a b " * 15), (2, None)], [], percent=100))


def test_resample_sql(spark, sf_dir):
    assert difference(spark, queries_c.op12_importance_resample, importance_sql.ORACLE, sf_dir) == ""


# whitening
def plain_whiten(rows, k=4):
    kept = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)}
    u = np.unique(np.array(list(kept.values())), axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return kept, n, s, values, axes


@pytest.mark.parametrize(("d", "block"), [(6, 32), (40, 8), (60, 8)])
def test_whitening(spark, d, block):
    draw = np.random.default_rng(d)
    x = draw.standard_normal((300, d)) * np.linspace(3, 1, d)
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)] + [(1000 + i, [float(e) for e in x[0]]) for i in range(200)]
    bad = [(2000, None), (2001, [None] + [0.0] * (d - 1)), (2002, [float("nan")] * d), (2003, [float("inf")] + [0.0] * (d - 1)), (2004, [-float("inf")] + [1.0] * (d - 1))]
    df = spark.createDataFrame([(i, v, "n", 1, 2.0, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, n string, component int, whitened double, x string").repartition(7)
    got = whitening.whiten(df, block=block).collect()
    kept, n, s, values, axes = plain_whiten(rows)
    assert len(got) == 4 * len(kept) and {r.vec_id for r in got} == set(kept)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = defaultdict(dict)
    for r in got:
        by[r.component][r.vec_id] = r
        assert r.deviation == int(((n * kept[r.vec_id] - s) ** 2).sum())
    for c, found in by.items():
        want = {i: float((v - s / n) @ axes[:, c - 1] / np.sqrt(values[c - 1])) for i, v in kept.items()}
        sign = 1 if sum(want[i] * found[i].whitened for i in want) > 0 else -1
        assert max(abs(want[i] - sign * found[i].whitened) for i in want) < 1e-8
        assert all(abs(r.explained - values[c - 1] / values.sum()) < 1e-12 for r in found.values())


def test_whitening_certifies_early(spark):
    """A spectrum that falls needs fewer passes than would span the whole space."""
    draw = np.random.default_rng(3)
    x = draw.standard_normal((200, 96)) * 0.6 ** np.arange(96) * 200
    grid = spark.createDataFrame([([int(e) for e in v],) for v in x], "x array<long>").distinct()
    model = whitening.fit(grid, 96, 4, 8)
    assert model.passes < 12 and model.identity_error < 1e-9


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], kind)).count() == 0
    alike = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], kind)
    assert whitening.whiten(alike).count() == 0
    line = spark.createDataFrame([(None, [0.0, 0.0], 0), (1, [1.0], 0), (1, [2.0, 0.0], 0), (2, [3.0, None], 0)], kind)
    got = sorted(whitening.whiten(line).collect(), key=lambda r: r.whitened)
    assert [r.vec_id for r in got] == [None, 1, 1] and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)
    assert [r.deviation for r in got] == [768**2, 0, 768**2]
    far = spark.createDataFrame([(i, [float(i) * 1e12, 0.0], 0) for i in range(5)], "vec_id long, embedding array<double>, label int")
    assert {r.deviation for r in whitening.whiten(far).collect()} == {None, 0}


def test_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())
