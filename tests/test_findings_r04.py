"""Tests of the fourth round's findings."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.functions import html
from lodestack.llm import chaining, textkit
from lodestack.plans import q_rules, q_text


def test_clean_html_is_returned_whole(spark, sf_dir):
    """F4"""
    pages = {r.page_id: r.html for r in q_rules.table(spark, sf_dir, "pages").select("page_id", "html").collect()}
    rows = q_text.html_clean(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    assert all((r.clean, r.text, r.title) == html.cleaned(pages[r.page_id] or "") and r.clean_chars == len(r.clean) for r in rows)


def test_history_switches_go_and_images_stay():
    """F4"""
    page = '<body><p>out</p><div id="contents"><p>a <b>View history note</b><img alt="Hide History Reference"><img title=" view history note "> view history notes</p><img alt="A map" data-asset-ref="D/0"><span data-asset-ref="D/1">seal</span><img src="x"><a data-doc-id="ato:A/B" data-pit="20200101">b</a></div></body>'
    clean, text, _ = html.cleaned(page)
    assert clean == '<div id="contents"><p>a <b></b> view history notes</p><img alt="A map" data-asset-ref="D/0"><span data-asset-ref="D/1">seal</span><img src="x"><a data-doc-id="ato:A/B" data-pit="20200101">b</a></div>'
    assert text == "a view history notes\n[image: A map] [asset:D/0][asset:D/1]b [doc:ato:A/B pit=20200101]"


def test_every_order_has_its_template_its_number_and_first_year(spark, sf_dir):
    """F5"""
    years = dict(q_rules.table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate")).collect())
    rows = q_rules.templates(spark, sf_dir).collect()
    assert sorted(r.o_orderkey for r in rows) == sorted(years)
    n = Counter(r.template for r in rows)
    first = {t: min(years[r.o_orderkey] for r in rows if r.template == t) for t in n}
    assert all((r.n, r.first_year) == (n[r.template], first[r.template]) for r in rows)


def test_texts_are_seeded_in_one_go():
    """the seeds of many texts are those of each by itself, found as their definition says"""
    rng = random.Random(3)
    texts = [b"", b" ", b"a b c d e", b"a b c d e f", b"\n\n x "] + [b" ".join(rng.choice([b"a", b"b", b"cc"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    h, row, pos, ctx = chaining.placed_all(texts)
    told = [[(int(h[k]), int(pos[k]), int(ctx[k])) for k in np.flatnonzero(row == i)] for i in range(len(texts))]
    for i, text in enumerate(texts):
        assert told[i] == list(zip(*(x.tolist() for x in chaining.placed(text)), strict=True))
        words = textkit.word_hashes(text)
        of = textkit.windows(words, chaining.K).tolist() if len(words) >= chaining.K else []
        order = [(x & ~15) | k % chaining.WINDOW for k, x in enumerate(of)]
        width = min(chaining.WINDOW, len(of))
        least = {min(range(k, k + width), key=order.__getitem__) for k in range(len(of) - width + 1)} if of else set()
        assert [p for _, p, _ in told[i]] == sorted(least)


@pytest.mark.parametrize("batch", [5, 64, 1000])
def test_small_cells_are_compared_together(monkeypatch, batch):
    """pairs of many cells in one go are those of each cell by itself"""
    rng = np.random.default_rng(5)
    rows, pos = [], 0
    for h in range(60):
        base = rng.integers(10, 14, 2 * chaining.SPAN + chaining.K).astype("<u4")
        for left in (True, False):
            for _ in range(rng.integers(0, 7)):
                w = np.where(rng.random(len(base)) < 0.1, 99, base).astype("<u4")
                w[chaining.SPAN : chaining.SPAN + chaining.K] = 7
                lo, hi = int(rng.integers(0, chaining.SPAN + 1)), len(w) - int(rng.integers(0, chaining.SPAN + 1))
                rows.append({"h": h, "xb": 0, "yb": 0, "left": left, "free": left or bool(rng.integers(2)), "th": int(rng.integers(6)), "pos": pos, "at": chaining.SPAN - lo, "words": w[lo:hi].tobytes()})
                pos += 1
    schema = pa.schema([("h", pa.int64()), ("xb", pa.int32()), ("yb", pa.int32()), ("left", pa.bool_()), ("free", pa.bool_()), ("th", pa.int64()), ("pos", pa.int32()), ("at", pa.int32()), ("words", pa.binary())])
    batches = pa.Table.from_pylist(rows, schema=schema).to_batches(max_chunksize=batch)

    def told(small: int) -> list[tuple]:
        monkeypatch.setattr(chaining, "SMALL", small)
        return sorted(tuple(r.values()) for b in chaining._cell_rows(20, 0.6)(iter(batches)) for r in b.to_pylist())

    assert told(1 << 12) == told(0) == told(9) and told(0)
