"""What is read out of marker text: definitions, citations, currency, titles and dates."""

from __future__ import annotations

import hashlib
import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
_DATE = re.compile(r"\b(\d{1,2})\s+(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{4})\b", re.I)
#: Stands for a withdrawal whose date is unknown.
UNKNOWN_DATE = "0001-01-01"


def precise_date(text: str) -> str | None:
    """The first ``d Month yyyy`` as ISO text; not held against the calendar."""
    m = _DATE.search(text)
    return f"{m[3]}-{MONTHS[m[2].lower()]:02d}-{int(m[1]):02d}" if m else None


def real_date(text: str) -> str | None:
    """ISO text of ``d Month yyyy``, ``yyyy-mm-dd`` or ``dd/mm/yyyy`` if there is such a day."""
    text = text.strip()
    parts = None
    if m := _DATE.fullmatch(text):
        parts = (int(m[3]), MONTHS[m[2].lower()], int(m[1]))
    elif m := re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", text):
        parts = tuple(map(int, m.groups()))
    elif m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", text):
        parts = (int(m[3]), int(m[2]), int(m[1]))
    try:
        return date(*parts).isoformat() if parts else None
    except ValueError:
        return None


def real_date_col(c: Column) -> Column:
    c = F.trim(c)
    return F.date_format(F.coalesce(F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), "yyyy-MM-dd"), F.try_to_date(F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), c), "d/M/yyyy"), F.try_to_date(F.when(c.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), c), "d MMMM yyyy")), "yyyy-MM-dd")


def clean_term(term: str) -> str:
    term = term.replace("\\*", "*").replace("\\&", "&")
    return " ".join(re.sub(r"^[\s:*]+|[\s:*]+$", "", term).split())


def clean_body(body: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", body.strip(" \t:;")).strip()


_TERM = re.compile(r"\*\*\*([^*\n]{1,200})\*\*\*")
_CUE = re.compile(r"^\s*(?:,?\s*(?:in relation to|of|for)\b[^:;.\n]{0,200}?)?\s*(?:\([^)]*\)\s*)?(?::|means\b|includes\b|has the (?:same )?meaning\b|—|-\s)", re.I)
_LINK = re.compile(r"^\s*(?:or|and|,)\s*$")


def definitions(source: str, native_id: str, text: str) -> list[dict]:
    """Emphasised terms that a cue follows; terms linked by or/and share what comes after the last of them."""
    found = list(_TERM.finditer(text))
    out, seen = [], set()
    for i, m in enumerate(found):
        last = i
        while last + 1 < len(found) and _LINK.match(text[found[last].end() : found[last + 1].start()]):
            last += 1
        begin = found[last].end()
        end = found[last + 1].start() if last + 1 < len(found) else len(text)
        rest = text[begin:end]
        if not _CUE.match(rest):
            continue
        term, body = clean_term(m[1]), clean_body(rest.split("\n\n\n")[0])
        if len(body.encode()) < 4 or not term or (term.lower(), body) in seen:
            continue
        seen.add((term.lower(), body))
        ident = hashlib.sha256("\x1f".join((source, native_id, term.lower(), body)).encode()).hexdigest()[:20]
        out.append({"definition_id": ident, "term": term, "norm_term": term.lower(), "ord": len(out), "body": body})
    return out


_MARKER = re.compile(r"\[doc:([^\s\]@:]+):([^\s\]@]+)([^\]]*)\]")


def citations(own: tuple[str, str], text: str) -> list[tuple[str, str]]:
    """Distinct (source, id) that a chunk's markers name, but its own document."""
    return list(dict.fromkeys((m[1], m[2]) for m in _MARKER.finditer(text) if (m[1], m[2]) != own))


def rewritten(text: str, own: tuple[str, str], known: set[tuple[str, str]]) -> str:
    """Markers of documents outside the corpus become fetch markers with a canonical URI."""

    def one(m: re.Match) -> str:
        if (m[1], m[2]) in known or (m[1], m[2]) == own:
            return m[0]
        query = "&".join(f"{k}={v}" for k, v in re.findall(r"\b(pit|view)=(\S+)", m[3]))
        return f"[fetch:legal://{m[1]}/{m[2]}" + (f"?{query}" if query else "") + "]"

    return _MARKER.sub(one, text)


_WITHDRAWN = re.compile(r"\b(?:is|was|has been|are|were)?\s*withdrawn\b(?:[^.;\n]{0,60}?\b(?:on|from|with effect from)\s+([^.;\n]{6,40}))?", re.I)
_REPLACED = re.compile(r"\b(?:replaced|superseded)\s+by\s+([A-Z][A-Za-z]{0,10}\s*\d{4}/D?\d+[A-Z]*|[A-Z]{2,6}\s*\d+)", re.I)
_REPLACES = re.compile(r"\b(?:replaces|supersedes)\s+([A-Z][A-Za-z]{0,10}\s*\d{4}/D?\d+[A-Z]*|[A-Z]{2,6}\s*\d+)", re.I)
_SELF = re.compile(r"\bthis\s+(?:ruling|determination|document|bulletin|statement|guideline|page)\b", re.I)


def currency(alert: str, body: str, title: str) -> tuple[str | None, str | None, str | None]:
    """(withdrawn date, superseded by, replaces); each from the alert, else the body's statements on itself, else the title."""
    withdrawn = superseded = replaces = None
    for text, trusted in ((alert, True), (body, False)):
        for part in re.split(r"[.;\n]", text or ""):
            if not trusted and not _SELF.search(part):
                continue
            if withdrawn is None and (m := _WITHDRAWN.search(part)):
                withdrawn = (precise_date(m[1]) if m[1] else precise_date(part)) or UNKNOWN_DATE
            if superseded is None and (m := _REPLACED.search(part)):
                superseded = " ".join(m[1].split())
            if replaces is None and (m := _REPLACES.search(part)):
                replaces = " ".join(m[1].split())
    if withdrawn is None and re.search(r"\(withdrawn\)\s*$", title or "", re.I):
        withdrawn = UNKNOWN_DATE
    return withdrawn, superseded, replaces


#: Shapes of a heading, in order; the first that fits is its shape.
SHAPES: tuple[tuple[str, str], ...] = (
    ("ruling", r"^[A-Z]{2,6} \d{4}/D?\d+[A-Z0-9]*$"),
    ("ruling_bare", r"^[A-Z]{2,6} \d{1,5}(W|[A-Z]\d*)?$"),
    ("interpretative", r"^ATO ID \d{4}/\d+$"),
    ("practice", r"^(PS|PCG) ?(LA|CM|\d{4}/) ?\S*$"),
    ("neutral", r"^\[\d{4}\] [A-Z]{2,8} \d+"),
    ("case", r"^(?=.{1,199}$).+ v\.? .+$"),
    ("re_case", r"^(?i:re|ex parte) .+$"),
    ("act", r"^.+ (Act|Regulations?|Rules?|Ordinance) (\([^)]*\) )?\d{4}( .*)?$"),
    ("bill", r"^.+ Bill( \(No\.? ?\d+\))? \d{4}$"),
    ("type_phrase", r"^(Taxation|Goods and Services Tax|Product|Class|Miscellaneous|Superannuation|Fuel Tax|Law Companion) (Ruling|Determination|Guideline)s?( Addendum)?$"),
    ("explanatory", r"^(Supplementary )?Explanatory (Memorandum|Statement)"),
    ("date", r"^\d{1,2} (January|February|March|April|May|June|July|August|September|October|November|December) \d{4}$"),
)


def shape_of(heading: str) -> str:
    return next((name for name, p in SHAPES if re.search(p, heading)), "text" if heading.strip() else "empty")


def shape_col(heading: Column) -> Column:
    out = F.when(F.trim(heading) == "", "empty").otherwise("text")
    for name, pattern in reversed(SHAPES):
        out = F.when(heading.rlike(pattern), name).otherwise(out)
    return out


def collapse(text: str) -> str:
    return " ".join(text.split())


def joined_title(citation: str, subject: str) -> str:
    """``citation — subject``; a subject that only repeats the citation adds nothing."""
    citation, subject = collapse(citation), collapse(subject)
    if not subject or subject.lower() == citation.lower():
        return citation
    if subject.lower().startswith(citation.lower()):
        subject = subject[len(citation) :].lstrip(" -—:")
    return f"{citation} — {subject}" if citation else subject


def year_of(token: str) -> str | None:
    """A year of four digits, or of two in the 1900s."""
    m = re.search(r"(?<!\d)(\d{4}|\d{2})(?=/)", token)
    return None if not m else m[1] if len(m[1]) == 4 else f"19{m[1]}"


def metadata(native_id: str, heads: list[str], body: str = "", category: str | None = None, published: str | None = None) -> tuple[str, str | None]:
    """(title, date) by the shapes of the leading headings, then the id, then the publication date."""
    shapes = [shape_of(h) for h in heads[:6]]
    pairs = list(zip(shapes, heads, strict=False))
    get = lambda *kinds: next((h for s, h in pairs if s in kinds), None)
    kind, *rest = native_id.split("/")
    title, when = None, next((precise_date(h) for s, h in pairs if s == "date"), None)
    cite = get("ruling", "ruling_bare", "interpretative", "practice")
    if (category or "").startswith("Edited_private_advice") or kind.upper() == "EV":
        title = joined_title(f"{kind.upper()} {rest[0]}" if rest else kind, next((h for s, h in pairs if s == "text" and "private advice" not in h.lower()), ""))
    elif kind.upper() in ("PAC", "REG", "RPC", "RRG") and rest and re.fullmatch(r"\d{8}", rest[0]):
        act, section = get("act"), rest[1] if len(rest) > 1 else None
        title = f"{act or 'Act ' + rest[0]}" + (f" s {section}" if section else "")
        when = when or f"{rest[0][:4]}-01-01"
    elif cite:
        title = joined_title(cite, next((h for s, h in pairs if s == "text"), ""))
        when = when or precise_date(body) or (f"{y}-01-01" if (y := year_of(cite)) else None)
    elif case := get("case", "re_case", "neutral"):
        neutral = get("neutral")
        title = f"{neutral} — {case}" if neutral and neutral != case else case
        when = when or (f"{m[1]}-01-01" if (m := re.search(r"\[(\d{4})\]", neutral or "")) else None)
    elif act := get("act", "bill", "explanatory"):
        title = act
        when = when or (f"{m[1]}-01-01" if (m := re.search(r"(\d{4})\s*$", act)) else None)
    if not title:
        title = heads[0].strip() if heads and heads[0].strip() and shapes[0] == "text" and len(heads) > 1 else " ".join([kind, *rest])
    return collapse(title), when or precise_date(body[:400]) or (real_date(published) if published else None)


_PIT = re.compile(r"^\d{8,14}$")


def pit_to_date(pit: str) -> str | None:
    return real_date(f"{pit[:4]}-{pit[4:6]}-{pit[6:8]}") if _PIT.match(pit) else None


def mail_fields(link: str) -> list[str]:
    """Lines of a mailto body, decoded, without its links."""
    from urllib.parse import unquote

    m = re.search(r"[?&]body=([^&]*)", link, re.I)
    lines = [unquote(x).strip() for x in re.split(r"%0D(?:%0A)?|%0A", m[1], flags=re.I)] if m else []
    return [x for x in lines if x and not x.lower().startswith("link:")]
