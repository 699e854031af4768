"""Text functions as Column expressions, and the tokenisers of index and query."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that a query drops (fixed values).
STOPWORDS = frozenset("a an and are as at be by for from in is it of on or that the this to was were with".split())
QUERY_CHARS, QUERY_TERMS, MIN_TERM = 4096, 16, 2


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def approx_tokens(c: Column) -> Column:
    """Words times 1.3, cut off, at least 1."""
    words = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words * 1.3).cast("int"))


def sentences(c: Column) -> Column:
    """Split at white space after . ! or ? and before a capital or an opening bracket."""
    return F.split(c, r"(?<=[.!?])\s+(?=[A-Z(])")


def normalise_block(c: Column) -> Column:
    """No-break blanks, runs of blanks, blanks around line breaks, at most one empty line, spaced hyphens between digits and padded quotes."""
    c = F.regexp_replace(c, " ", " ")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", ""))
    c = F.regexp_replace(c, r"(\d) - (\d)", "$1-$2")
    return F.regexp_replace(c, r'" ([^"\n]*) "', '"$1"')


def paragraph_breaks(c: Column) -> Column:
    """Each line collapsed, runs of empty lines to one, none at the ends."""
    lines = F.transform(F.split(c, "\n", -1), collapse_ws)
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def definition_term(c: Column) -> Column:
    """Unescaped, freed of blanks, colons and stars at the ends, collapsed, lower case."""
    c = F.replace(F.replace(c, F.lit("\\*"), F.lit("*")), F.lit("\\&"), F.lit("&"))
    return F.lower(collapse_ws(F.regexp_replace(c, r"^[\s:*]+|[\s:*]+$", "")))


def slug(c: Column, fallback: str = "item", longest: int = 80) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(s == "", F.lit(fallback)).otherwise(F.coalesce(s, F.lit(fallback))), 1, longest)


def description_of(title: Column) -> Column:
    return F.substring_index(title, " — ", 1)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_html(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def text_to_html(c: Column) -> Column:
    """Paragraphs at empty lines, collapsed and escaped."""
    parts = F.filter(F.transform(F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"\n\s*\n", -1), collapse_ws), lambda p: p != "")
    return F.concat(F.lit("<article>"), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), ""), F.lit("</article>"))


def source_characters(c: Column) -> Column:
    """C1 controls as their windows-1252 characters; other controls but tab and line breaks go."""
    mapped = [(chr(i), bytes([i]).decode("cp1252", "ignore")) for i in range(0x80, 0xA0)]
    pairs = [(a, b) for a, b in mapped if b]
    c = F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{80}-\x{9F}]", "")


def decode_bytes(b: Column) -> Column:
    """UTF-8 if valid, else windows-1252."""
    return F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(F.decode(b, "windows-1252"))


def redacted(c: Column) -> Column:
    """Keys, bearer tokens and secrets after a telling name are blanked."""
    c = F.regexp_replace(c, r"(?i)(bearer)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 [REDACTED]")
    c = F.regexp_replace(c, r"AKIA[A-Z0-9]{12,}", "[REDACTED]")
    return F.regexp_replace(c, r"(?i)(api[_-]?key|password|secret|token)(\s*[:=]\s*)[^\s,;]+", "$1$2[REDACTED]")


#: Names of fields that hold credentials, the form of an interface key and of a bearer token.
CREDENTIAL_FIELDS = frozenset(("authorization", "x-api-key", "api_key", "api-key", "access_token", "refresh_token"))
INTERFACE_KEY = r"\b[a-z0-9][a-z0-9_-]{0,63}\.[A-Za-z0-9_-]{43}\b"
BEARER_TOKEN = r"(?i)(authorization[\"']?\s*[:=]\s*[\"']?bearer\s+)[^\s\"']+"


def without_credentials(value: object) -> object:
    """A decoded JSON value with credentials blanked at any depth: by the name of their field, or by their form in a text."""
    if isinstance(value, str):
        return re.sub(BEARER_TOKEN, r"\1[REDACTED_TOKEN]", re.sub(INTERFACE_KEY, "[REDACTED_API_KEY]", value))
    if isinstance(value, list):
        return [without_credentials(v) for v in value]
    if isinstance(value, dict):
        return {k: "[REDACTED_CREDENTIAL]" if k.lower() in CREDENTIAL_FIELDS else without_credentials(v) for k, v in value.items()}
    return value


def redacted_json(c: Column) -> Column:
    """JSON records without credentials; what is no JSON is treated as a text."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(without_credentials(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return without_credentials(text)

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(c)


def evidence(c: Column) -> Column:
    """Dashes folded, lower case, white space collapsed: for comparing quoted evidence."""
    return collapse_ws(F.lower(F.translate(c, "‐‑‒–—−", "------")))


#: What text that was decoded wrongly shows.
DAMAGE = ("�", "ï¿½", "â€", "Â ")
#: Single letters one after another that make a run; letters in runs that condemn a text if they are a 20th, or half, of all.
GLYPH_RUN, GLYPHS_MANY, GLYPHS_FEW = 8, 100, 24


def glyph_runs(c: Column) -> Column:
    """Lengths of the runs of at least eight single-letter words: text whose glyphs were spaced apart."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: t != "")
    # a letter for each single one, a dot for each other word: runs are then found by one pattern
    marks = F.array_join(F.transform(words, lambda t: F.when(t.rlike(r"^\p{IsAlphabetic}$"), "x").otherwise(".")), "")
    return F.transform(F.regexp_extract_all(marks, F.lit(f"x{{{GLYPH_RUN},}}"), F.lit(0)), lambda r: F.length(r))


def encoding_damage(c: Column) -> Column:
    """Whether a text shows traces of a wrong decoding."""
    out = F.lit(False)
    for trace in DAMAGE:
        out = out | F.contains(c, F.lit(trace))
    return F.coalesce(out, F.lit(False))


def spaced_glyphs(c: Column) -> Column:
    """Whether so many letters stand apart that the text can't be searched."""
    spaced = F.aggregate(glyph_runs(c), F.lit(0), lambda s, n: s + n)
    letters = F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\P{IsAlphabetic}", ""))
    return (spaced >= GLYPHS_MANY) & (spaced * 20 >= letters) | (spaced >= GLYPHS_FEW) & (spaced * 2 >= letters)


def text_damage(c: Column) -> Column:
    """Why a text is no evidence: nothing in it, damaged, or spaced apart; null if it is sound."""
    empty = ~F.coalesce(c, F.lit("")).rlike(r"[\p{IsAlphabetic}\p{N}]")
    return F.when(empty, "empty").when(encoding_damage(c), "encoding").when(spaced_glyphs(c), "glyphs")


def version_parts(c: Column) -> Column:
    """A dotted version as numbers, null if it isn't one; arrays compare in order."""
    return F.when(c.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(c, r"\."), lambda x: x.cast("int")))


def simple_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits: the tokeniser that SQL engines share."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Terms of a query: words with inner hyphens, not short, no stopwords, first spelling of each, at most 16."""
    out: dict[str, str] = {}
    for word in re.findall(r"[A-Za-z0-9']+(?:-[A-Za-z0-9']+)*", query[:QUERY_CHARS]):
        key = word.lower()
        if len(word.encode()) >= MIN_TERM and key not in STOPWORDS:
            out.setdefault(key, word)
    return list(out.values())[:QUERY_TERMS]


def strict_query(query: str) -> str:
    """The terms as quoted phrases, all of which must match."""
    return " ".join(f'"{t}"' for t in query_terms(query))


def fold_token(token: str) -> str:
    """Lower case, without marks."""
    return "".join(c for c in unicodedata.normalize("NFD", token.lower()) if unicodedata.category(c) != "Mn")


def index_tokens(text: str, stem: bool = True) -> list[str]:
    """Runs of letters, digits and private-use characters, folded and stemmed."""
    # white space ends a run, so what lies between can be looked up
    return [t for part in text.split() for t in _part_tokens(part, stem)]


@lru_cache(maxsize=1 << 16)
def _part_tokens(text: str, stem: bool) -> tuple[str, ...]:
    from lodestack.functions.porter import stemmed

    out, run = [], []
    for c in text + " ":
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind in ("Co", "Mn"):
            run.append(c)
        elif run:
            token = fold_token("".join(run))
            if token:
                out.append(stemmed(token) if stem else token)
            run = []
    return tuple(out)
