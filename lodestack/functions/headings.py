"""What a heading is: a citation, the name of a kind of document, the name of a case or law, or a subject. All as Columns.

One table says how each citation is recognised, how it is spelled and where its
year stands; recognising, cleaning and dating read the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Series of rulings, and those that are also cited by number alone.
SERIES = ("CLR", "COG", "CR", "FBT", "FBTR", "FTR", "GII", "GSTD", "GSTR", "IT", "LCG", "LCR", "LG", "LI", "MT", "PCG", "PR", "PRR", "SGR", "SMSFD", "SMSFR", "SMSFRB", "TA", "TD", "TPA", "TR", "TXD", "WETD", "WETR", "WT")
NUMBERED_SERIES = ("CRP", "IT", "MT")
#: Headings that only name a kind of document.
KINDS = {
    "ruling_kind": (
        "class ruling", "fringe benefits tax ruling", "fuel tax ruling", "goods and services tax determination", "goods and services tax ruling", "gst determination", "gst ruling",
        "income tax ruling", "law companion guideline", "law companion ruling", "miscellaneous taxation ruling", "product ruling", "ruling compendium", "smsf determination", "smsf ruling",
        "superannuation guarantee determination", "superannuation guarantee ruling", "taxation determination", "taxation ruling", "wine equalisation tax determination", "wine equalisation tax ruling",
    ),
    "guideline_kind": ("practical compliance guideline", "practical compliance guidelines"),
    "alert_kind": ("taxpayer alert",),
    "decision_kind": ("ato interpretative decision",),
    "practice_kind": ("ato practice statement law administration", "law administration practice statement", "practice statement law administration"),
    "bulletin_kind": ("smsf regulator's bulletin", "smsf regulators bulletin"),
    "impact_kind": ("decision impact statement", "decision impact statements"),
    "memorandum_kind": ("explanatory memorandum", "supplementary explanatory memorandum"),
}


def any_of(words: tuple[str, ...]) -> str:
    """A pattern for one of some words, longer ones first."""
    return "(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


@dataclass(frozen=True)
class Citation:
    """A form of citation: its pattern at the beginning of a heading, its parts put together, and the part that is a year (0: none)."""

    shape: str
    pattern: str
    spelled: tuple[str | int, ...]
    year: int


CITATIONS = (
    Citation("neutral", r"^\[(\d{4})\] ([A-Z]+) (\d+)", ("[", 1, "] ", 2, " ", 3), 1),
    Citation("decision", r"^ATO ID (\d{4})/(\d+)", ("ATO ID ", 1, "/", 2), 1),
    Citation("practice", r"^PS LA (\d{4})/(D?\d+)", ("PS LA ", 1, "/", 2), 1),
    Citation("bulletin", r"^SMSFRB (\d{4})/(\d+)", ("SMSFRB ", 1, "/", 2), 1),
    Citation("ruling", rf"^{any_of(SERIES)} (\d{{1,4}})/(D?\d+[A-Z0-9]*)(?![\w/])", (1, " ", 2, "/", 3), 2),
    Citation("numbered", rf"^{any_of(NUMBERED_SERIES)} (\d{{1,5}})(?![\w/.])", (1, " ", 2), 0),
)
#: Names of cases and laws, tried in this order.
NAMES = (
    ("act", r"(?i)^\p{L}.* (?:act|regulations?|code|rules) (?:19|20)\d\d(?: ?\(cth\))?$"),
    ("bill", r"\bBill (?:19|20)\d\d\b"),
    ("matter", r"(?i)^(?:re|in re|in the matter of|ex parte) \p{L}"),
    ("case_number", r"(?i)^case [a-z]?\d+(?:/\d+)?$"),
    ("versus", r"^(?=.{1,199}$)\p{L}.*? vs?\.? [\p{L}(]"),
)
SHAPES = ("empty", *[c.shape for c in CITATIONS], *KINDS, *[n for n, _ in NAMES], "subject")
CASE_SHAPES = ("neutral", "versus", "matter", "case_number")
WITHDRAWN = r"(?i)\s*\(\s*withdrawn\s*\)"


def plain(c: Column) -> Column:
    """White space in single spaces, null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def shape(text: Column) -> Column:
    """The shape of a plain heading: citations before kinds, kinds before names."""
    low = F.lower(text)
    told = [F.when(text == "", "empty")]
    told += [F.when(text.rlike(c.pattern), c.shape) for c in CITATIONS]
    told += [F.when(low.isin(*held), name) for name, held in KINDS.items()]
    told += [F.when(text.rlike(pattern), name) for name, pattern in NAMES]
    return F.coalesce(*told, F.lit("subject"))


def _group(text: Column, c: Citation, i: int) -> Column:
    return F.regexp_extract(text, c.pattern, i)


def spelled(text: Column, *shapes: str) -> Column:
    """A citation of one of ``shapes`` in its one spelling, null if the text is none."""
    forms = [c for c in CITATIONS if not shapes or c.shape in shapes]
    return F.coalesce(*[F.when(text.rlike(c.pattern), F.concat(*[F.lit(p) if isinstance(p, str) else _group(text, c, p) for p in c.spelled])) for c in forms])


def whole_year(year: Column) -> Column:
    """Years of one or two digits are in the 1900s; null for an empty one."""
    return F.when(F.length(year) == 4, year.cast("int")).when(year != "", F.lit(1900) + year.cast("int"))


def cited_year(text: Column) -> Column:
    """The year that a citation names, null if it names none."""
    return F.coalesce(*[F.when(text.rlike(c.pattern), whole_year(_group(text, c, c.year))) for c in CITATIONS if c.year])


def clean_citation(text: Column) -> Column:
    """A citation without the remark that it was withdrawn, in its one spelling; another text merely tidied."""
    bare = plain(F.regexp_replace(F.coalesce(text, F.lit("")), WITHDRAWN, ""))
    return F.coalesce(spelled(bare), bare)


def case_name(text: Column) -> Column:
    """A heading as the name of a case: without a citation behind it; null if it is empty or too long for one."""
    short = plain(F.regexp_replace(F.regexp_replace(text, r"\s*\[\d{4}\].*$", ""), r"\bv\. ", "v "))
    return F.when((F.octet_length(text) <= 200) & (short != ""), short)


def same_start(a: Column, b: Column) -> Column:
    """Whether one of two texts begins with the other, whatever their case."""
    x, y = F.lower(a), F.lower(b)
    return F.startswith(x, y) | F.startswith(y, x)
