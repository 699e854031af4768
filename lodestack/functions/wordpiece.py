"""WordPiece tokens of a vocabulary without case, and chunks cut by their exact number.

Text is cleaned, lowered and stripped of accents; punctuation and CJK
characters stand alone; each word becomes the longest pieces of the vocabulary
from its left, later pieces with ``##`` before them, or the unknown token as a
whole if that fails or the word is too long.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

UNKNOWN, FIRST, LAST = "[UNK]", "[CLS]", "[SEP]"
LONGEST_WORD = 100
LIMIT = 512
#: First and last code points of the blocks of CJK characters.
CJK = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2F800, 0x2FA1F))

#: White space that ends a word; control characters but these are left out and end none.
_SPACE = re.compile("[\t\n\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Runs between white space whose number of pieces is kept.
KEPT = 1 << 17


def _alone(c: str) -> bool:
    """Characters that are words of their own."""
    n = ord(c)
    if 33 <= n <= 47 or 58 <= n <= 64 or 91 <= n <= 96 or 123 <= n <= 126:
        return True
    return unicodedata.category(c).startswith("P") or any(a <= n <= b for a, b in CJK)


def words(text: str) -> list[str]:
    out: list[str] = []
    now = ""
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        if kind == "Mn" or c in "\x00�" or (kind.startswith("C") and c not in "\t\n\r"):
            continue
        if c.isspace() or _alone(c):
            out += [now] if now else []
            out += [c] if not c.isspace() else []
            now = ""
        else:
            now += c
    return out + ([now] if now else [])


class WordPiece:
    def __init__(self, vocabulary: list[str]) -> None:
        self.ids = {piece: i for i, piece in enumerate(vocabulary)}
        for needed in (UNKNOWN, FIRST, LAST):
            if needed not in self.ids:
                raise ValueError(f"the vocabulary has no {needed}")
        self._pieces_in = lru_cache(maxsize=KEPT)(lambda run: sum(len(self.pieces(w)) for w in words(run)))

    def pieces(self, word: str) -> list[str]:
        if len(word) > LONGEST_WORD:
            return [UNKNOWN]
        out, at = [], 0
        while at < len(word):
            head = "##" if at else ""
            end = next((e for e in range(len(word), at, -1) if head + word[at:e] in self.ids), None)
            if end is None:
                return [UNKNOWN]
            out.append(head + word[at:end])
            at = end
        return out

    def encode(self, text: str) -> list[int]:
        """Ids between those of the first and the last token."""
        found = [self.ids[p] for w in words(text) for p in self.pieces(w)]
        return [self.ids[FIRST], *found, self.ids[LAST]]

    def count(self, text: str) -> int:
        return sum(map(self._pieces_in, _SPACE.split(text))) + 2


def checked(ids: list[int], limit: int = LIMIT) -> list[int]:
    """The ids, which must fit the model; they are never cut."""
    if len(ids) > limit:
        raise ValueError(f"{len(ids)} tokens where {limit} are allowed")
    return ids


def split_exactly(text: str, count: Callable[[str], int], limit: int) -> list[str]:
    """Runs of words of at most ``limit`` tokens, each the longest that fits, found by bisection; a word that doesn't fit alone is cut."""
    parts = text.split()
    out: list[str] = []
    at = 0
    while at < len(parts):
        upper = min(len(parts) - at, limit)
        n = bisect_right(range(1, upper + 1), limit, key=lambda k, at=at: count(" ".join(parts[at : at + k])))
        if n:
            out.append(" ".join(parts[at : at + n]))
            at += n
            continue
        word = parts[at]
        m = max(1, bisect_right(range(1, len(word) + 1), limit, key=lambda k, word=word: count(word[:k])))
        out.append(word[:m])
        if m < len(word):
            parts[at] = word[m:]
        else:
            at += 1
    return out


def characters(rows: DataFrame, text: str) -> DataFrame:
    """c: each character in use once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            seen.update(*(t for t in b.column(0).to_pylist() if t))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["c"])

    return rows.select(text).mapInArrow(run, "c string").distinct()


def tokenised(rows: DataFrame, text: str, vocabulary: list[str], limit: int = LIMIT) -> DataFrame:
    """``rows`` with the number of tokens and whether they fit; the vocabulary is a table of fixed size."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    names = rows.columns
    at = names.index(text)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = WordPiece(shared.value)
        for b in batches:
            counts = [made.count(t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array([n <= limit for n in counts], pa.bool_())], names=[*names, "tokens", "fits"])

    return rows.mapInArrow(run, f"{ddl}, tokens long, fits boolean")
