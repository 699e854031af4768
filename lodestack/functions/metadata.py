"""Titles and dates of documents, from headings, id, folder and the beginning of the text, as one plan of Columns.

A document is read once into facts: what its headings cite and name, what its
id spells, which day its text tells. Headings, id and folder choose one of
eleven templates. ``TITLES`` and ``DATES`` say for each template which facts
make its title and its date, in order of preference; what they leave open is
filled from ``ALWAYS_TITLES`` and ``ALWAYS_DATES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import headings as h

#: Columns that :func:`derive` reads; those that are missing count as null.
INPUT = {"native_id": "string", "headings": "array<string>", "levels": "array<int>", "category": "string", "body": "string", "published": "string", "refs": "array<string>", "phrase": "string"}
#: Characters of the text that each fact is looked for in.
DAY_IN, REPORT_IN, BELOW_IN, IMPACT_IN, ADVICE_IN, BILL_IN = 600, 400, 500, 1200, 1500, 800
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_DAY = rf"(?i)\b(\d{{1,2}})\s+({_MONTHS})\s+(\d{{4}})\b"
_ADVISED = rf"(?i)\bdate\s+of\s+(?:advice|ruling|issue)\s*[:-]?\s*(\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}})"
_YEAR = r"\b((?:19|20)\d\d)\b"
_REPORT = r"\((\d{4})\)\s+\d+\s+[A-Z]{2,}"
_NEUTRAL = h.CITATIONS[0].pattern
_BILL = dict(h.NAMES)["bill"]
#: Ids that spell a citation without blanks: pattern, parts put together, part that is a year.
SPELLED_IDS = (
    (rf"^{h.any_of(h.SERIES)}((?:19|20)\d\d)(D?\d+)$", (1, " ", 2, "/", 3), 2),
    (r"^PSLA(\d{4})(\d+)$", ("PS LA ", 1, "/", 2), 1),
    (r"^PSD(\d{4})D?(\d+)$", ("PS LA ", 1, "/D", 2), 1),
    (r"^A(?:TO)?ID(\d{4})(\d+)$", ("ATO ID ", 1, "/", 2), 1),
    (rf"^{h.any_of(h.SERIES)}([89]\d)(D?\d+)$", (1, " ", 2, "/", 3), 2),
)
#: What an id's second part may begin with, and folders.
OLD_CASE, SECTION_ID = r"^\*(\d{4})\*.", r"^(\d{4})(\d{4})$"
CASES, LAWS, ADVICE = "Cases", "Legislation_and_supporting_material", "Edited_private_advice"

_OTHER = ("front", "levels", "second_level", "reference")
TITLES = {
    "publication": ("cited", "numbered", *_OTHER),
    "bulletin": ("bulletin", *_OTHER),
    "case": ("named", "named_within", "filed_case"),
    "case_below": ("name_below",),
    "old_case": ("mailed_case", "first_heading", "inner"),
    "impact": ("impact",),
    "act": ("top",),
    "section": ("section",),
    "bill": ("front", "bill", "levels", "second_level", "reference", "top"),
    "advice": ("advice",),
    "other": _OTHER,
}
DATES = {
    "publication": ("day", "cited_year"),
    "bulletin": ("bulletin_year",),
    "case": ("day", "named_year", "report_year"),
    "case_below": ("day", "below_year"),
    "old_case": ("day", "starred_year"),
    "impact": ("day", "impact_year"),
    "act": ("top_year",),
    "section": ("day", "section_year", "act_year"),
    "bill": ("day", "bill_year"),
    "advice": ("advised",),
    "other": ("day", "published", "spelled_year"),
}
ALWAYS_TITLES = ("spelled", "id")
ALWAYS_DATES = ("published", "starred_year", "section_year", "inner_year", "spelled_title_year")


def day_in(text: Column) -> Column:
    """The first ``d Month yyyy`` of a text as ISO text, null if there is none."""
    part = lambda i: F.regexp_extract(text, _DAY, i)
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in _MONTHS.split("|")]), F.lower(F.substring(part(2), 1, 3)))
    return F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")))


def _found(text: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _first(heads: Column, within: int, condition) -> Column:
    """The first of some headings that satisfies a condition on its struct (text, shape), null if there is none."""
    return F.get(F.filter(F.slice(heads, 1, within), condition), F.lit(0))


def _spelled_id(inner: Column) -> tuple[Column, Column]:
    group = lambda p, i: F.regexp_extract(inner, p, i)
    title = F.coalesce(*[F.when(inner.rlike(p), F.concat(*[F.lit(x) if isinstance(x, str) else group(p, x) for x in parts])) for p, parts, _ in SPELLED_IDS])
    year = F.coalesce(*[F.when(inner.rlike(p), h.whole_year(group(p, y))) for p, _, y in SPELLED_IDS])
    return title, year


def _with_subject(primary: Column, heads: Column) -> Column:
    """``primary — subject``, if a heading tells what it is about."""
    subject = _first(heads, 5, lambda x: (x["shape"] == "subject") & ~x["text"].startswith("/law/view/") & (F.lower(x["text"]) != F.lower(primary)))
    return F.when(primary.isNotNull(), F.concat_ws(" — ", primary, subject["text"]))


def _with_levels(df: DataFrame) -> DataFrame:
    """The first three levels that follow one another, each found once: __one, __two, __three; __second where there is no level 1."""
    heads, usable = F.col("__heads"), F.size("__heads") == F.size("__levels")
    rows = F.filter(F.transform(F.arrays_zip(heads.alias("h"), F.col("__levels").alias("l")), lambda x, i: F.struct(i.alias("at"), x["h"]["text"].alias("text"), x["l"].alias("level"))), lambda r: r["text"] != "")
    after = lambda level, at: F.get(F.filter("__rows", lambda r: (r["level"] == level) & (r["at"] > at)), F.lit(0))
    df = df.withColumn("__rows", F.when(_used("levels", "second_level") & usable, rows))
    df = df.withColumn("__one", after(1, F.lit(-1))).withColumn("__two", after(2, F.col("__one.at")))
    df = df.withColumn("__three", after(3, F.coalesce("__two.at", "__one.at"))["text"])
    return df.withColumn("__second", F.when(F.col("__one").isNull(), after(2, F.lit(-1))["text"])).withColumn("__one", F.col("__one.text")).withColumn("__two", F.col("__two.text")).drop("__rows")


def _titled(one: Column, two: Column, three: Column) -> Column:
    shown_two = F.when(~h.same_start(two, one), two)
    shown_three = F.when(~h.same_start(three, one) & ~F.coalesce(h.same_start(three, shown_two), F.lit(False)), three)
    return F.when(one.isNotNull(), F.concat_ws(" — ", one, shown_two, shown_three))


def _mailed(body: Column) -> Column:
    """Lines of the body of the first mail link: decoded, without blank ones and links."""
    raw = F.regexp_extract(F.regexp_extract(body, r"mailto:[^\s)\"'>]*", 0), r"(?i)[?&]body=([^&]*)", 1)
    lines = F.transform(F.split(F.regexp_replace(F.replace(raw, F.lit("+"), F.lit("%2B")), r"(?i)%0D%0A|%0D|%0A", "\n"), "\n"), lambda x: F.trim(F.coalesce(F.try_url_decode(x), x)))
    return F.filter(lines, lambda x: (x != "") & ~F.lower(x).startswith("link:"))


def template(shapes: Column, outer: Column, inner: Column, folder: Column) -> Column:
    """The first template whose condition holds; ``shapes`` are those of the first six headings."""
    has = lambda *names: F.arrays_overlap(shapes, F.array(*[F.lit(n) for n in names]))
    at = lambda i: F.get(shapes, F.lit(i))
    told = (
        ("bulletin", has("bulletin", "bulletin_kind")),
        ("old_case", (outer == "JUD") & inner.rlike(OLD_CASE)),
        ("section", outer.isin("PAC", "REG") & inner.rlike(SECTION_ID)),
        ("publication", has("ruling", "numbered", "decision", "practice")),
        ("impact", has("impact_kind") & has("versus", "matter", "neutral")),
        ("case", at(0).isin(*h.CASE_SHAPES)),
        ("case_below", (at(1) == "versus") & (folder == CASES)),
        ("case", folder == CASES),
        ("act", (at(0) == "act") | has("act") & (folder == LAWS)),
        ("bill", has("bill", "memorandum_kind")),
        ("advice", folder == ADVICE),
    )
    return F.coalesce(*[F.when(fits, name) for name, fits in told], F.lit("other"))


def _used(*facts: str) -> Column:
    """Whether a row's template asks for one of some facts."""
    return F.col("template").isin(*[t for t in TITLES if {*TITLES[t], *DATES[t]} & {*facts}])


def _named(c: dict[str, Column]) -> dict[str, Column]:
    """Names that several facts are made from, told once for the rows that need them."""
    heads, mailed = c["heads"], c["mailed"]
    text = lambda i: F.coalesce(F.get(heads, F.lit(i))["text"], F.lit(""))
    of = lambda n, *shapes: _first(heads, n, lambda x: x["shape"].isin(*shapes))["text"]
    act = F.coalesce(of(6, "act"), F.get(F.filter(mailed, lambda x: h.shape(h.plain(x)) == "act"), F.lit(0)))
    bold = F.filter(F.transform(F.regexp_extract_all(F.substring(c["body"], 1, BILL_IN), F.lit(r"\*\*([^*]+?)\*\*"), F.lit(1)), h.plain), lambda x: x.rlike(_BILL) | (h.shape(x) == "act"))
    lawlike = lambda x: F.when(x.rlike(_BILL) | (h.shape(x) == "act"), x)
    bill = F.coalesce(F.when(text(1).rlike(_BILL), text(1)), lawlike(text(0)), F.get(bold, F.lit(0)), F.nullif(text(0), F.lit("")))
    spelled, spelled_year = _spelled_id(c["inner"])
    return {"cited": F.when(_used("cited", "cited_year"), of(6, "ruling", "decision", "practice")), "act": F.when(_used("section", "act_year"), act), "bill": F.when(_used("bill", "bill_year"), bill), "spelled": spelled, "spelled_year": spelled_year}


def _facts(c: dict[str, Column]) -> dict[str, Column]:
    """Every fact by its name; dates as ISO text or as a year."""
    heads, body, outer, inner, section = c["heads"], c["body"], c["outer"], c["inner"], c["section"]
    text = lambda i: F.coalesce(F.get(heads, F.lit(i))["text"], F.lit(""))
    of = lambda n, *shapes: _first(heads, n, lambda x: x["shape"].isin(*shapes))["text"]
    lead = lambda n: F.substring(body, 1, n)
    lawful = lambda x: ~x.startswith("/law/view/") & (x != "") & (F.octet_length(x) < 200)

    cited, act, bill = c["cited"], c["act"], c["bill"]
    mark = F.when(cited.rlike(h.WITHDRAWN), " (Withdrawn)").otherwise("")
    numbered = h.spelled(of(6, "numbered"), "numbered")
    as_name = lambda x: F.when(x["shape"] == "neutral", h.spelled(x["text"], "neutral")).when(x["shape"] == "case_number", x["text"]).otherwise(h.case_name(x["text"]))
    names = F.filter(F.transform(F.filter(F.slice(heads, 1, 5), lambda x: x["shape"].isin(*h.CASE_SHAPES)), as_name), lambda x: x.isNotNull())
    parts = F.flatten(F.transform(F.slice(heads, 1, 3), lambda x: F.split(x["text"], r"\s+—\s+")))
    within = F.filter(F.transform(parts, lambda p: F.when(h.shape(p) == "neutral", h.spelled(p, "neutral")).when(h.shape(p) == "versus", h.case_name(p))), lambda x: x.isNotNull())
    filed = _first(heads, 3, lambda x: lawful(x["text"]))["text"]
    mailed = c["mailed"]
    unit = F.when(outer == "PAC", "s").otherwise("reg")
    law_year, law_number = _found(inner, SECTION_ID, 1), F.ltrim(F.regexp_extract(inner, SECTION_ID, 2), F.lit("0"))
    behind = F.when(section != "", F.concat(F.lit(" "), unit, F.lit(" "), section)).otherwise("")
    by_number = F.when(outer == "PAC", F.concat(F.lit("Act "), law_year, F.lit(" No. "), law_number, F.lit(" s "), section)).otherwise(F.concat(F.lit("Regulations "), law_year, F.lit(" reg "), section))
    letter = F.get(F.filter(F.transform(F.filter(mailed, lambda x: (F.lower(x) != "cases") & (x.contains(" v ") | x.contains(" - ("))), lambda x: F.trim(F.regexp_replace(x, r"\s*-\s*\([^)]+\)\s*$", ""))), lawful), F.lit(0))
    bill_year = F.coalesce(_found(bill, r"\bBill ((?:19|20)\d\d)\b"), _found(bill, _YEAR))
    kind = F.endswith(h.shape(bill), F.lit("_kind"))
    refs = F.filter(F.transform(c["refs"], h.plain), lambda r: r != "")
    ref = F.get(refs, F.lit(0))
    phrase = F.nullif(F.trim(c["phrase"]), F.lit(""))
    opening = _first(heads, 1 << 20, lambda x: x["text"] != "")["text"]
    fresh = F.when(~h.same_start(opening, phrase) & ~h.same_start(opening, ref), opening)
    year_of = lambda found: found.cast("int")
    return {
        "cited": _with_subject(F.when(cited.isNotNull(), F.concat(h.clean_citation(cited), mark)), heads),
        "cited_year": h.cited_year(cited),
        "numbered": _with_subject(numbered, heads),
        "bulletin": _with_subject(h.spelled(of(4, "bulletin"), "bulletin"), heads),
        "bulletin_year": h.cited_year(of(4, "bulletin")),
        "named": F.get(names, F.lit(0)),
        "named_within": F.get(within, F.lit(0)),
        "filed_case": F.when(c["folder"] == CASES, filed),
        "named_year": h.cited_year(of(5, "neutral")),
        "report_year": year_of(_found(lead(REPORT_IN), _REPORT)),
        "name_below": h.case_name(text(1)),
        "below_year": year_of(F.coalesce(_found(lead(BELOW_IN), _NEUTRAL), _found(lead(BELOW_IN), _REPORT))),
        "mailed_case": letter,
        "first_heading": _first(heads, 4, lambda x: lawful(x["text"]))["text"],
        "inner": F.nullif(inner, F.lit("")),
        "starred_year": year_of(_found(inner, OLD_CASE)),
        "impact": F.concat(F.lit("DIS: "), F.coalesce(h.case_name(text(1)), h.case_name(text(0)))),
        "impact_year": year_of(_found(lead(IMPACT_IN), _NEUTRAL)),
        "top": F.nullif(text(0), F.lit("")),
        "top_year": year_of(_found(text(0), _YEAR)),
        "section": F.coalesce(F.concat(act, behind), by_number, F.concat(outer, F.lit(" "), inner, F.lit("/"), section)),
        "section_year": year_of(law_year),
        "act_year": year_of(_found(act, _YEAR)),
        "bill": F.when(~kind, F.when(bill_year.isNotNull() & ~bill.contains("Explanatory"), F.concat(F.lit("EM to "), bill)).otherwise(bill)),
        "bill_year": year_of(bill_year),
        "advice": F.when(F.trim(inner) != "", F.concat_ws(" ", outer, F.trim(inner))),
        "advised": day_in(F.regexp_extract(lead(ADVICE_IN), _ADVISED, 1)),
        "front": F.when(phrase.isNotNull() & ref.isNotNull(), F.concat_ws(" — ", phrase, ref, fresh)),
        "levels": _titled(c["one"], c["two"], c["three"]),
        "second_level": c["second"],
        "reference": F.when(c["phrase"].isNull(), ref),
        "spelled": c["spelled"],
        "spelled_year": c["spelled_year"],
        "spelled_title_year": c["spelled_year"],
        "id": F.nullif(F.concat_ws(" ", F.nullif(outer, F.lit("")), F.nullif(inner, F.lit(""))), F.lit("")),
        "day": day_in(lead(DAY_IN)),
        "published": F.nullif(c["published"], F.lit("")),
        "inner_year": year_of(_found(inner, r"^((?:19|20)\d\d)")),
    }


def _dated(fact: Column, name: str) -> Column:
    """A day as it is, a year as its first day."""
    return F.concat(fact.cast("string"), F.lit("-01-01")) if name.endswith("_year") else fact


def _chosen(facts: dict[str, Column], table: dict[str, tuple[str, ...]], always: tuple[str, ...], shown) -> Column:
    by = F.lit(None).cast("string")
    for name, wanted in table.items():
        by = F.when(F.col("template") == name, F.coalesce(*[shown(facts[w], w) for w in wanted])).otherwise(by)
    return F.coalesce(by, *[shown(facts[w], w) for w in always])


def derive(documents: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, template, title and date (null where nothing tells one) of each document."""
    given = {c: F.col(c) if c in documents.columns else F.lit(None).cast(kind) for c, kind in INPUT.items()}
    parts = F.filter(F.split(given["native_id"], "/"), lambda p: p != "")
    heads = F.transform(F.coalesce(given["headings"], F.array().cast("array<string>")), h.plain)
    held = documents.select(
        *keep,
        heads.alias("__plain"),
        *[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("__o", "__inner", "__section"))],
        F.coalesce(given["category"], F.lit("")).alias("__folder"),
        F.coalesce(given["body"], F.lit("")).alias("__body"),
        *[given[c].alias(f"__{c}") for c in ("levels", "published", "refs", "phrase")],
    )
    # shapes are told once, in a column of their own
    shaped = held.withColumn("__heads", F.transform("__plain", lambda t: F.struct(t.alias("text"), h.shape(t).alias("shape")))).withColumn("__outer", F.upper("__o"))
    of = {n: F.col(f"__{n}") for n in ("heads", "outer", "inner", "section", "folder", "body", "published", "refs", "phrase", "mailed", "cited", "act", "bill", "one", "two", "three", "second", "spelled", "spelled_year")}
    first = shaped.withColumn("__shapes", F.transform(F.slice("__heads", 1, 6), lambda x: x["shape"]))
    chosen = first.withColumn("template", template(F.col("__shapes"), of["outer"], of["inner"], of["folder"]))
    mailed = chosen.withColumn("__mailed", F.when(_used("section", "act_year", "mailed_case"), _mailed(F.col("__body"))))
    ready = _with_levels(mailed.select("*", *[f.alias(f"__{n}") for n, f in _named(of).items()]))
    # each fact is computed once, for the rows whose template asks for it; then the tables choose among plain columns
    facts = {n: f if n in (*ALWAYS_TITLES, *ALWAYS_DATES) else F.when(_used(n), f) for n, f in _facts(of).items()}
    told = ready.select(*keep, "template", *[f.alias(f"__f_{n}") for n, f in facts.items()])
    named = {n: F.col(f"__f_{n}") for n in facts}
    return told.select(*keep, "template", _chosen(named, TITLES, ALWAYS_TITLES, lambda f, _: f).alias("title"), _chosen(named, DATES, ALWAYS_DATES, _dated).alias("date"))
