"""Quality rules with tokeniser fertility.

Base rules come from the words and lines of the whole text. The method adds
what public vocabularies say of a text: characters per token, share of byte
fallback tokens and entropy of the tokens. Each language that has enough
documents gets bands around its own medians; the others use the band of their
script, taken over all documents in it, or else that of the whole corpus.
Outside a band a document is rejected.

Words are encoded one by one (a blank before each), so a bounded table of
words already seen spares most calls of the tokenisers; no vocabulary here
merges across blanks, so this equals encoding words in place.

Bands: a measure is accepted within ``spread`` times the interquartile range
beyond its quartiles, and always within the absolute ``slack`` of the median.
Entropy is held in bits against texts of like length (within a power of two of
tokens), for its share of log2(n) falls as texts grow: over all lengths no band
of it could reject. A class of length with too few documents in the corpus has
no band of entropy.
The quartiles are taken over all documents that pass the base rules; at most
26**2 languages (two letters), the scripts and the corpus have a band, so the table of
bands that is sent to the executors has a proven bound.

Null text has no words and fails the base rules; null or odd languages count by
script. Repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import cut, quoted, require

VOCABULARIES = "/opt/tokenizers"
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.tiktoken"
SYMBOLS = "#*$%&|<>"
_WHITE = "\t\n\x0b\x0c\r "
#: Words kept with their tokens by each Python worker.
CACHE_WORDS = 400_000
#: Characters of texts whose words are looked up together.
CHUNK = 1_000_000
#: Documents with fewer words have no reliable fertility and are not judged by it.
MIN_TOKENS = 30
#: A language or script with fewer documents than this has no band of its own; a corpus with fewer has none at all.
MIN_GROUP = 40
#: The group of all documents.
ALL = "*"
SPREAD = 3.0
SLACK = {"chars_per_token": 0.45, "byte_chars_per_token": 0.45, "byte_share": 0.05, "entropy": 0.6}
MEASURES = tuple(SLACK)
SCRIPTS = (("han", r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"), ("kana", r"[\x{3040}-\x{30FF}]"), ("hangul", r"[\x{AC00}-\x{D7AF}]"), ("arabic", r"[\x{0600}-\x{06FF}]"), ("hebrew", r"[\x{0590}-\x{05FF}]"), ("devanagari", r"[\x{0900}-\x{097F}]"), ("thai", r"[\x{0E00}-\x{0E7F}]"), ("greek", r"[\x{0370}-\x{03FF}]"), ("cyrillic", r"[\x{0400}-\x{04FF}]"))

MEASURED = pa.schema(
    [("row", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()), *[(m, pa.float64()) for m in MEASURES]]
)


class Vocabulary:
    """Both public tokenisers and a bounded table of words: where a word's pieces lie in ``flat``, and its number of byte-level tokens."""

    def __init__(self, folder: str) -> None:
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECE_MODEL))
        with open(os.path.join(folder, BYTE_MODEL), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.level = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.get_piece_size())], bool)
        self.clear()

    def clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.flat, self.ends, self.levels = array("i"), array("q", [0]), array("i")

    def learn(self, texts: list[dict[bytes, int]]) -> None:
        """Take the words of some texts into the table; one call of a tokeniser for many words costs far less than many calls."""
        new = set().union(*texts).difference(self.seen)
        if new and len(self.seen) + len(new) > CACHE_WORDS and self.seen:
            self.clear()
            new = set().union(*texts)
        if not new:
            return
        fresh = [w.decode() for w in new]
        self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new)), strict=True))
        for ids in self.piece.encode(fresh, num_threads=1):
            self.flat.extend(ids)
            self.ends.append(len(self.flat))
        encode = self.level.encode_ordinary
        self.levels.extend([len(encode(" " + w)) for w in fresh])

    def pieces(self, words: dict[bytes, int], times: np.ndarray) -> tuple[np.ndarray, int, int]:
        """How often each piece occurs in a text with these (learnt) words, the pieces that are bytes, and the byte-level tokens."""
        at = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        # the views end with this call: an array that is viewed can't grow
        ends = np.frombuffer(self.ends, np.int64)
        first, size = ends[at], ends[at + 1] - ends[at]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids = np.frombuffer(self.flat, np.int32)[np.repeat(first, size) + inside] if len(inside) else np.empty(0, np.int32)
        counts = np.bincount(ids, np.repeat(times, size), len(self.is_byte)).astype(np.int64)
        return counts[counts > 0], int(counts[self.is_byte].sum()), int(np.frombuffer(self.levels, np.int32)[at] @ times)


def numbered(words: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """The distinct words with their numbers, and the text as these numbers."""
    number = dict(zip(dict.fromkeys(words), count(), strict=False))
    return number, np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def repeated_words(text: np.ndarray) -> int:
    """Words covered by a window of three words that is found at least twice in the text, given as word numbers."""
    n = len(text) - 2
    if n < 2:
        return 0
    # pairs are numbered anew, so that a pair and a word fit in 64 bits whatever the length of the text
    width = int(text.max()) + 1
    _, pair = np.unique(text[:-1] * width + text[1:], return_inverse=True)
    window = pair[:-1] * width + text[2:]
    order = window.argsort(kind="stable")
    same = np.diff(window[order]) == 0
    if not same.any():
        return 0
    at = np.concatenate((order[1:][same], order[:-1][same]))
    hit = np.zeros(len(text), bool)
    for i in range(3):
        hit[at + i] = True
    return int(hit.sum())


def dup_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measure(text: str, number: dict[bytes, int], order: np.ndarray, vocabulary: Vocabulary) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens and the four measures of a text given with its word numbers."""
    chars = len(text) - sum(map(text.count, _WHITE))
    base = (len(order), chars, sum(map(text.count, SYMBOLS)), dup_lines(text.encode()), repeated_words(order))
    if not number:
        return (*base, 0, None, None, None, None)
    counts, bytes_, level = vocabulary.pieces(number, np.bincount(order))
    n = int(counts.sum())
    entropy = float(np.log2(n) - (counts * np.log2(counts)).sum() / n) if n else 0.0
    # a text of n tokens can't exceed log2(n) bits, so short texts are compared by their share of that
    return (*base, n, chars / max(n, 1), chars / max(level, 1), bytes_ / max(n, 1), entropy / max(np.log2(max(n, 2)), 1e-9))


def measure_all(texts: Iterable[str | None], vocabulary: Vocabulary) -> Iterator[tuple]:
    """measure() of each text, whose words are learnt for about CHUNK characters of texts at a time."""
    held: list[tuple[str, dict[bytes, int], np.ndarray]] = []
    chars = 0

    def told() -> Iterator[tuple]:
        vocabulary.learn([number for _, number, _ in held])
        yield from [measure(*h, vocabulary) for h in held]

    for text in texts:
        text = text or ""
        held.append((text, *numbered(text.encode().split())))
        chars += len(text)
        if chars >= CHUNK:
            yield from told()
            held, chars = [], 0
    yield from told()


def measures(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(folder)
            rows = list(measure_all((t.as_py() for t in batch.column(1)), vocabulary))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in MEASURED.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(MEASURED)[1:], strict=True)]], schema=MEASURED)

    return run


def script_of(text: Column) -> Column:
    """``script:NAME`` of the first of SCRIPTS that the text has; one pass settles a text that has none of them."""
    head = F.coalesce(text, F.lit(""))
    script = F.when(head.rlike("[A-Za-z]"), F.lit("latin")).otherwise(F.lit("other"))
    named = script
    for name, pattern in reversed(SCRIPTS):
        named = F.when(head.rlike(pattern), F.lit(name)).otherwise(named)
    anyone = "[" + "".join(pattern[1:-1] for _, pattern in SCRIPTS) + "]"
    return F.concat(F.lit("script:"), F.when(head.rlike(anyone), named).otherwise(script))


def group_of(lang: Column, script: Column) -> Column:
    """A two-letter language, else the script: a bounded set of groups."""
    return F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise(script)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bits() -> Column:
    """Entropy in bits; the column of that name is its share of log2(n)."""
    return F.col("entropy") * F.log2(F.greatest("n_tokens", F.lit(2)))


def _length_class() -> Column:
    """Texts of like length: the number of tokens, to the power of two below."""
    return F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("string")


def bands(measured: DataFrame, spread: float = SPREAD, slack: dict[str, float] | None = None) -> list[tuple]:
    """(group, measure, low, high) from the quartiles of all documents that pass the base rules: of each language, script and of ALL."""
    slack = slack or SLACK
    fine = measured.where(~base_failed() & (F.col("n_tokens") >= MIN_TOKENS))
    quartiles = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(2000)).alias(m) for m in MEASURES]
    out = []
    groups = F.array_distinct(F.array("grp", "script", F.lit(ALL)))
    by_length = F.transform(groups, lambda g: F.concat_ws("/", g, _length_class()))
    plain = fine.select(F.explode(groups).alias("grp"), *[F.col(m) if m != "entropy" else F.lit(None).cast("double").alias(m) for m in MEASURES])
    fine = plain.union(fine.select(F.explode(by_length).alias("grp"), *[_bits().alias(m) if m == "entropy" else F.lit(None).cast("double").alias(m) for m in MEASURES]))
    for row in fine.groupBy("grp").agg(F.count("*").alias("n"), *quartiles).where(f"n >= {MIN_GROUP}").collect():
        for m in MEASURES:
            if row[m] is None:
                continue
            q1, mid, q3 = row[m]
            reach = spread * (q3 - q1)
            out.append((row.grp, m, min(q1 - reach, mid - slack[m]), max(q3 + reach, mid + slack[m])))
    return sorted(out)


def assess(docs: DataFrame, vocabularies: str = VOCABULARIES, spread: float = SPREAD, keep_columns: bool = False) -> DataFrame:
    """Counts, measures and verdict of each document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, then the group, the four measures and
    the names of the measures outside their band. With ``keep_columns``: the
    documents that are kept, as they came.
    """
    require(docs, "doc_id", "text")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    # the rows themselves travel with their measures only where they are wanted back: one write of the table instead of a join on its texts
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]) if keep_columns else F.struct(F.col("doc_id"))
    packed = docs.select(row.alias("row"), F.col("doc_id"), F.col("text"), lang.alias("lang"), script_of(F.col("text")).alias("script"))
    lang = F.col("lang")
    tagged = packed.select(F.struct(F.col("row"), F.col("doc_id"), group_of(lang, F.col("script")).alias("grp"), F.col("script")).alias("tag"), "text")
    table = cut(tagged.mapInArrow(_tagged(vocabularies), _tagged_type(tagged)).select("tag.*", *MEASURED.names[1:]), "quality")
    judged = verdicts(table, bands(table, spread))
    return judged.where("kept").select("row.*") if keep_columns else judged.drop("row")


def _tagged_type(tagged: DataFrame) -> str:
    kinds = {pa.int64(): "long", pa.float64(): "double"}
    return ", ".join([f"tag {tagged.schema['tag'].dataType.simpleString()}", *[f"{f.name} {kinds[f.type]}" for f in list(MEASURED)[1:]]])


def _tagged(folder: str):
    run = measures(folder)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags: list[pa.Array] = []

        def with_rows() -> Iterator[pa.RecordBatch]:
            for b in batches:
                tags.append(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column(1)], names=["row", "text"])

        for out in run(with_rows()):
            yield pa.RecordBatch.from_arrays([tags.pop(0), *out.columns[1:]], names=["tag", *MEASURED.names[1:]])

    return mapped


def verdicts(table: DataFrame, found: list[tuple]) -> DataFrame:
    """found: the bands, at most four for each of the bounded set of groups."""
    limits: dict[str, dict[str, tuple[float, float]]] = {}
    for grp, m, low, high in found:
        limits.setdefault(m, {})[grp] = (low, high)
    reasons = []
    for m in MEASURES:
        of = limits.get(m, {})
        if not of:
            continue
        low = F.create_map(*chain.from_iterable((F.lit(g), F.lit(float(v[0]))) for g, v in of.items()))
        high = F.create_map(*chain.from_iterable((F.lit(g), F.lit(float(v[1]))) for g, v in of.items()))
        groups = [F.col("grp"), F.col("script"), F.lit(ALL)]
        if m == "entropy":
            groups = [F.concat_ws("/", g, _length_class()) for g in groups]
        of_row = lambda limit, groups=groups: F.coalesce(*[F.try_element_at(limit, g) for g in groups])
        value = _bits() if m == "entropy" else F.col(m)
        outside = (value < of_row(low)) | (value > of_row(high))
        reasons.append(F.when((F.col("n_tokens") >= MIN_TOKENS) & outside, F.lit(m)))
    why = F.filter(F.array(*reasons), lambda x: x.isNotNull()) if reasons else F.array().cast("array<string>")
    out = table.withColumn("base_failed", base_failed()).withColumn("outside", why)
    return out.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("outside") == 0)).alias("kept"), F.col("grp"), *MEASURES, F.array_join("outside", ",").alias("outside"))
