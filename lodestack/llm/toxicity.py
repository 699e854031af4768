"""Toxicity by a convolutional text classifier, trained in numpy.

Words become rows of a hashed embedding table; filters of several widths run
over the whole text, each keeps its greatest response (max pooling), and a
logistic layer turns these into a score. Training reads at most
``max_positive`` toxic and ``max_negative`` clean labelled rows, the first by a
hash of their id (a documented bound; only their word numbers reach the
driver); rows whose crc32(doc_id) mod 5 is 0 are never read. Labels, language,
source and doc_id are no inputs of a score. The score is shifted to the share
of toxic rows among all labelled training rows. Thresholds are calibrated for each language on
all labelled training rows that the sample left out: their scores meet as
histograms by language and label, and the edge of best F1 is taken; languages
of fewer than LEAST_TOXIC toxic rows take that of all rows together.

Null and empty texts get the score of a text without words. Without a label of
each kind every score is the share of toxic rows (0.5 if there is none).
Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm import textkit
from lodestack.llm.common import cut, require

BITS, DIM = 17, 12
WIDTHS, FILTERS = (1, 2, 3), 10
MAX_POSITIVE, MAX_NEGATIVE = 2000, 3000
EPOCHS, BATCH, RATE = 8, 32, 0.02
#: Bins of a histogram of scores, and toxic rows that a language needs for a threshold of its own.
BINS, LEAST_TOXIC = 1000, 10
PATIENCE = 2
SEED = 11
#: Bytes of a word's stem; inflected forms share its embedding.
STEM = 5


def word_numbers(data: bytes) -> np.ndarray:
    """(n, 2): rows of the embedding table of each word and of its first STEM bytes."""
    data = _letters(data)
    words = textkit.word_hashes(data), textkit.word_hashes(data, longest=STEM)
    return (np.stack(words, axis=1) >> np.uint64(64 - BITS)).astype(np.int32)


#: Punctuation of ASCII counts as white space, so a word at the end of a sentence is the same word.
_PLAIN = bytes(32 if (33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127) else c for c in range(256))


def _letters(data: bytes) -> bytes:
    return data.translate(_PLAIN)


@dataclass
class TextCNN:
    """Embeddings, filters by width, output layer; ``shift`` moves the score to the share of toxic rows."""

    table: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    shift: float = 0.0
    #: Ids of the sample, at most MAX_POSITIVE + MAX_NEGATIVE.
    fitted: list = field(default_factory=list)

    @classmethod
    def fresh(cls, seed: int = SEED) -> TextCNN:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
        filters = {w: rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        return cls(table, filters, bias, rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32))

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter, and where; a text shorter than a filter gives that filter 0."""
        x = self.table[ids[:, 0]] + self.table[ids[:, 1]]
        best, at = [], []
        for w in WIDTHS:
            n = len(ids) - w + 1
            if n < 1:
                best.append(np.zeros(FILTERS, np.float32)), at.append(np.full(FILTERS, -1))
                continue
            y = x[:n] @ self.filters[w][0]
            for i in range(1, w):
                y += x[i : n + i] @ self.filters[w][i]
            top = y.argmax(axis=0)
            best.append(np.maximum(y[top, np.arange(FILTERS)] + self.bias[w], 0)), at.append(top)
        return np.concatenate(best), np.concatenate(at)

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids)[0] @ self.out) + self.out_bias

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(ids) + self.shift, -30, 30))))

    def step(self, batch: list[np.ndarray], labels: np.ndarray, moments: dict, rate: float) -> None:
        """One step of Adagrad on the mean log loss; only the winning windows get a gradient."""
        grad_out, grad_bias = np.zeros_like(self.out), 0.0
        gf = {w: np.zeros_like(self.filters[w]) for w in WIDTHS}
        gb = {w: np.zeros_like(self.bias[w]) for w in WIDTHS}
        rows, values = [], []
        for ids, label in zip(batch, labels, strict=True):
            h, at = self.pooled(ids)
            d = (1 / (1 + np.exp(-np.clip(float(h @ self.out) + self.out_bias, -30, 30))) - label) / len(batch)
            grad_out += d * h
            grad_bias += d
            back = d * self.out * (h > 0)
            for k, w in enumerate(WIDTHS):
                g, p = back[k * FILTERS : (k + 1) * FILTERS], at[k * FILTERS : (k + 1) * FILTERS]
                on = np.flatnonzero((g != 0) & (p >= 0))
                if not len(on):
                    continue
                win = ids[p[on, None] + np.arange(w)]  # (filters on, width, 2)
                gf[w][:, :, on] += (self.table[win].sum(axis=2) * g[on, None, None]).transpose(1, 2, 0)
                gb[w][on] += g[on]
                spread = self.filters[w][:, :, on].transpose(2, 0, 1) * g[on, None, None]
                for part in range(2):
                    rows.append(win[:, :, part].ravel()), values.append(spread.reshape(-1, DIM))

        def move(name: object, weights: np.ndarray, grad: np.ndarray) -> None:
            seen = moments.setdefault(name, np.full_like(weights, 1e-6))
            seen += grad**2
            weights -= rate * grad / np.sqrt(seen)

        move("out", self.out, grad_out)
        for w in WIDTHS:
            move(w, self.filters[w], gf[w])
            move((w, "b"), self.bias[w], gb[w])
        bias = np.array([self.out_bias], np.float32)
        move("bias", bias, np.array([grad_bias], np.float32))
        self.out_bias = float(bias[0])
        if rows:
            at, back = np.unique(np.concatenate(rows), return_inverse=True)
            grad = np.zeros((len(at), DIM), np.float32)
            np.add.at(grad, back, np.concatenate(values))
            seen = moments.setdefault("table", np.full(self.table.shape, 1e-6, np.float32))
            seen[at] += grad**2
            self.table[at] -= rate * grad / np.sqrt(seen[at])


def auc(scores: np.ndarray, labels: np.ndarray) -> float:
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    pos = labels == 1
    n = int(pos.sum())
    return float((ranks[pos].sum() - n * (n + 1) / 2) / max(1, n * (len(scores) - n)))


def train(texts: list[np.ndarray], labels: np.ndarray, share: float, fitted: list | None = None, seed: int = SEED) -> TextCNN:
    """Fit on four fifths of the sample, stop early by the rest."""
    model = TextCNN.fresh(seed)
    model.fitted = fitted or []
    rng = np.random.default_rng(seed)
    share = min(max(share, 1e-4), 1 - 1e-4)
    if not len(labels) or len(set(labels.tolist())) < 2:
        model.out[:] = 0
        model.shift = float(np.log(share / (1 - share))) if len(labels) else 0.0
        return model
    held = rng.random(len(labels)) < 0.2
    fit, check = np.flatnonzero(~held), np.flatnonzero(held)
    if len(set(labels[fit].tolist())) < 2 or len(set(labels[check].tolist())) < 2:
        fit = check = np.arange(len(labels))
    moments: dict = {}
    best, kept, bad = np.inf, None, 0
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            model.step([texts[i] for i in part], labels[part], moments, RATE)
        z = np.array([model.logit(texts[i]) for i in check])
        loss = float(np.mean(np.logaddexp(0, np.where(labels[check] == 1, -z, z))))
        if loss < best - 1e-4:
            best, bad = loss, 0
            kept = (model.table.copy(), {w: x.copy() for w, x in model.filters.items()}, {w: x.copy() for w, x in model.bias.items()}, model.out.copy(), model.out_bias)
        else:
            bad += 1
            if bad >= PATIENCE:
                break
    if kept:
        model.table, model.filters, model.bias, model.out, model.out_bias = kept
    mean = float(labels.mean())
    model.shift = float(np.log(share / (1 - share)) - np.log(mean / (1 - mean)))
    return model


def best_threshold(bins: dict[int, tuple[int, int]]) -> float:
    """The edge of best F1 of a histogram: bin -> (clean, toxic)."""
    toxic = sum(n[1] for n in bins.values())
    hit = told = 0
    best, edge = -1.0, 0.5
    for k in sorted(bins, reverse=True):
        told, hit = told + sum(bins[k]), hit + bins[k][1]
        f1 = 2 * hit / (told + toxic)
        if f1 > best:
            best, edge = f1, k / BINS
    return edge


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [word_numbers(t.as_py() or b"") for t in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.ravel() for x in ids], pa.list_(pa.int32()))], names=["toxic", "lang", "ids"])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> TextCNN:
    """Train on a bounded sample: its ids are chosen from the labels alone and sent to the executors (at most max_positive + max_negative rows)."""
    known = _known(labels)
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), F.col("doc_id")]
    part = lambda k, n: known.where(F.col("toxic") == k).orderBy(*order).limit(n)
    sample = part(1, max_positive).union(part(0, max_negative)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = sorted(r.doc_id for r in sample.select("doc_id").collect())
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    chosen = docs.select("doc_id", lang.alias("lang"), "text").join(F.broadcast(sample), "doc_id").select("toxic", "lang", "text")
    # rows of one id beyond the bound are left out, whatever the table repeats
    rows = chosen.mapInArrow(_numbers, "toxic int, lang string, ids array<int>").limit(max_positive + max_negative).toArrow()
    # in an order that no schedule of tasks can change
    got = sorted(zip(rows["ids"].to_pylist(), rows["toxic"].to_pylist(), rows["lang"].to_pylist(), strict=True), key=lambda r: (zlib.crc32(np.asarray(r[0], np.int32).tobytes()), len(r[0]), r[1], r[2] or ""))
    del rows
    total = sum(counts.values())
    return train([np.asarray(r[0], np.int32).reshape(-1, 2) for r in got], np.array([r[1] for r in got], np.int64), counts.get(1, 0) / total if total else 0.5, ids)


def _known(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from."""
    return labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))


def thresholds(scored: DataFrame, labels: DataFrame, fitted: list) -> dict[str, float]:
    """Of each language with two letters, and of all rows (``*``): at most 26**2 + 1 histograms of BINS bins reach the driver."""
    known = _known(labels).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if fitted:
        kind = labels.schema["doc_id"].dataType.simpleString()
        known = known.join(F.broadcast(labels.sparkSession.createDataFrame([(i,) for i in fitted], f"doc_id {kind}")), "doc_id", "left_anti")
    lang = F.when(F.col("lang").rlike("^[a-z]{2}$"), F.col("lang"))
    rows = scored.join(known, "doc_id").select(lang.alias("lang"), F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), "toxic")
    counted = rows.groupBy("lang", "bin").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).collect()
    of: dict[str, dict[int, tuple[int, int]]] = {"*": {}}
    for r in counted:
        for name in {"*", r.lang or "*"}:
            clean, toxic = of.setdefault(name, {}).get(r.bin, (0, 0))
            of[name][r.bin] = (clean + r.clean, toxic + r.toxic)
    enough = {name: bins for name, bins in of.items() if sum(n[1] for n in bins.values()) >= (LEAST_TOXIC if name != "*" else 1)}
    return {name: best_threshold(bins) for name, bins in sorted(enough.items())}


def score(docs: DataFrame, model: TextCNN, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, then flagged: whether the score reaches the threshold of the text's language (0.5 without labels)."""
    require(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn = shared.value
        for batch in batches:
            scores = [cnn.score(word_numbers(t.as_py() or b"")) for t in batch.column(3).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang", "score"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), lang.alias("lang"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang string, score double")
    found = {}
    if labels is not None:
        made = cut(made, "scores")
        found = thresholds(made, labels, model.fitted)
    of_lang = F.lit(found.get("*", 0.5))
    if len(found) > 1:
        of_lang = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for name, v in found.items() for x in (name, v)]), F.col("lang")), of_lang)
    return made.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= of_lang).alias("flagged"))
