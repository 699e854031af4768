"""Snippets: the best window of a text for a query."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WINDOW, STRIDE, CHARS = 20, 10, 280
K1, B = 1.2, 0.75
_TOKEN = re.compile(r"[A-Za-z0-9']+")


def snippet_terms(query: str) -> list[str]:
    """All tokens of at least two characters; stopwords and repeats stay."""
    return [t.lower() for t in _TOKEN.findall(query) if len(t) >= 2]


def best_window(tokens: list[str], terms: list[str]) -> int:
    """First token of the window of greatest BM25, the text's own tokens being the corpus; the first of equals."""
    n = len(tokens)
    counts = {t: sum(x == t for x in tokens) for t in set(terms)}
    weight = {t: math.log((n - c + 0.5) / (c + 0.5) + 1) for t, c in counts.items()}
    best, at = -1.0, 0
    for start in range(0, max(1, n - WINDOW + STRIDE), STRIDE):
        part = tokens[start : start + WINDOW]
        norm = K1 * (1 - B + B * len(part) / WINDOW)
        score = sum(weight[t] * (tf := part.count(t)) * (K1 + 1) / (tf + norm) for t in terms if t in part)
        if score > best:
            best, at = score, start
    return at


def snippet(text: str, query: str, longest: int = CHARS) -> str:
    """At most ``longest`` bytes of the collapsed text around the best window, moved out to whole characters, with ellipses where text is left out."""
    plain = " ".join(text.split())
    data = plain.encode()
    if len(data) <= longest:
        return plain
    found = list(_TOKEN.finditer(plain))
    terms = snippet_terms(query)
    first = 0
    if found and terms:
        at = best_window([m[0].lower() for m in found], terms)
        last = found[min(at + WINDOW, len(found)) - 1]
        middle = (len(plain[: found[at].start()].encode()) + len(plain[: last.end()].encode())) // 2
        first = max(0, min(middle - longest // 2, len(data) - longest))
    end = first + longest
    while first > 0 and data[first] & 0xC0 == 0x80:
        first -= 1
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return ("..." if first else "") + data[first:end].decode() + ("..." if end < len(data) else "")


def snippet_col(text: Column, query: str, longest: int = CHARS) -> Column:
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else snippet(t, query, longest))

    return run(text)
