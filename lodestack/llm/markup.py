"""Pages as text blocks: one pass over the markup, boilerplate left out, each block told with the container it stands in.

A page never becomes a tree of objects: the scan keeps the open elements on a
stack and, of containers, their parent and path. It is linear in the page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Elements whose content is not markup: only their own end tag ends them.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul""".split()
)
#: Elements that can hold an article as a whole; others count with the nearest of these around them.
CONTAINERS = frozenset("article body center div main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never part of an article.
DROPPED = RAW | frozenset("head nav aside footer form menu button select option datalist dialog svg math canvas audio video object applet map search".split())
#: A start tag ends an open element of the first set, unless one of the second is open within.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: Words of a class, id or role that mark what is not the article, whatever stands beside them.
SURE = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promoted outbrain taboola
    nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toolbar topbar masthead footer sidebar sidebars contentinfo complementary
    cookie cookies consent gdpr newsletter signup popup comment comments commentlist disqus respond responses replies social copyright""".split()
)
#: Words that do so unless a word beside them speaks of the article (``article-header``).
LIKELY = frozenset("header banner banners notice notices notification alert alerts disclaimer paywall subscribe subscription modal overlay discussion related recommended recommendations recirc trending share sharing widget widgets login".split())
BESIDE = frozenset("content article body entry story post text main".split())
#: ``has-sidebar``, ``no-comments``: not the thing itself.
ABOUT = frozenset("has with no without show hide".split())

_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGEST = re.compile(r"(?=.*\d.*\d)[0-9a-f_-]{6,}", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_READERS = re.compile(r"\W*(?:\d[\d.,]*\s*)?(?:reader comments?|comments?|kommentare?|leserkommentare|commentaires?|comentarios?)\s*(?:\(\d+\))?\W*", re.I)
#: A path longer than this is told by a digest.
LONGEST_PATH = 240
#: Why what is in an element is left out: not at all; by its tag; as an article's own header, whose headings stay; by its name, in which a main part stays.
ALIVE, BY_TAG, HEAD_OF_ARTICLE, BY_NAME = range(4)


@dataclass(slots=True)
class Page:
    """Containers by number (parent, path, tag), number 0 being the page, and blocks in page order."""

    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[str] = field(default_factory=lambda: [""])
    tag: list[str] = field(default_factory=lambda: [""])
    #: (container, text, characters within links, whether a heading)
    blocks: list[tuple[int, str, int, bool]] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _words(name: str) -> list[str]:
    """The words of a class or id: ``postBody-12`` is post, body."""
    return [w.lower() for w in _WORD.findall(name)]


def general_label(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes without numbers and digests, so that it is the same on all pages of a template; an id stands in where there is no class."""
    kept = set()
    for name in attributes.get("class", "").split() or attributes.get("id", "").split():
        words = _words(name)
        if words and sum(map(len, words)) * 2 >= len(name) and not _DIGEST.fullmatch(name):
            kept.add("-".join(words))
    return ".".join([tag, *sorted(kept)])


def left_out(tag: str, attributes: dict[str, str]) -> int:
    """Whether an element is something else than the article, by its tag or by its name."""
    if tag in DROPPED:
        return BY_TAG
    if tag in ("html", "body", "main") or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody":
        return ALIVE
    for name in [*attributes.get("class", "").split(), *attributes.get("id", "").split(), attributes.get("role", "")]:
        words = set(_words(name))
        if words & SURE and not words & ABOUT or tag not in HEADINGS and words & LIKELY and not words & (ABOUT | BESIDE):
            return BY_NAME
    return ALIVE


def of_article(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element calls itself an article or its content."""
    return tag in ("article", "main") or tag not in ("html", "body") and bool(BESIDE & {w for k in ("class", "id", "role", "itemprop") for w in _words(attributes.get(k, ""))})


def scan(source: str, by_name: bool = True) -> Page:
    """The page's containers and text blocks. Without ``by_name`` only tags tell what is left out."""
    page = Page()
    stack: list[tuple[str, int, int]] = []  # tag, container, why it is left out
    opened: Counter[str] = Counter()
    known: dict[tuple[str, str], tuple[str, int, bool, bool]] = {}
    pieces: list[str] = []
    held = [False]  # of each container: whether it is or stands in something that calls itself an article
    linked = headings = where = why = at = 0
    n = len(source)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.blocks.append((where, text, min(linked, len(text)), headings > 0))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not why:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if opened["a"]:
                linked += len(text.strip())

    def close(depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        nonlocal where, why, headings
        ended = stack[depth:]
        if any(t in BLOCKS for t, _, _ in ended):
            flush()
        del stack[depth:]
        for t, _, _ in ended:
            opened[t] -= 1
            headings -= t in HEADINGS
        where, why = stack[-1][1:] if stack else (0, ALIVE)

    def close_last(tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        """Ends the innermost open element of ``tags`` that has none of ``bounds`` within it."""
        if not any(opened[t] for t in tags):
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in tags:
                close(depth)
                return
            if stack[depth][0] in bounds:
                return

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            add(source[at:])
            break
        m = _TAG.match(source, lt)
        if not m:
            add(source[at:lt])
            if re.match(r"</?[A-Za-z]", source[lt : lt + 3]):  # a quote that never ends: the tag ends at the next bracket
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                add("&lt;")
                at = lt + 1
            continue
        add(source[at:lt])
        at = m.end()
        if m[2] is None or not m[4]:  # a comment or declaration, or the page ends within a tag
            continue
        tag, raw = m[2].lower(), m[3]
        if tag == "br":
            add(" ")
        elif m[1]:
            if tag == "table" or tag in ("html", "body"):
                close_last({tag}, set())
            else:  # an end tag reaches out of no table and, of an inline element, of no block
                close_last({tag}, {"table"} if tag in BLOCKS else BLOCKS)
            if tag in BLOCKS:
                flush()
        elif tag in VOID:
            if tag in BLOCKS:
                flush()
        elif tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else n
        else:
            if tag in BLOCKS:
                flush()
                close_last({"p"}, BLOCKS | {"td", "th"} - {"p"})
            if tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
                close(len(stack) - 1)
            if tag in ENDS:
                close_last(*ENDS[tag])
            if tag == "a":
                close_last({"a"}, BLOCKS)
            if tag in ("td", "th"):
                add(" ")
            inner, cause = where, why
            if tag in BLOCKS or tag in DROPPED or raw and tag in ("span", "td", "th"):
                told = known.get((tag, raw))
                if told is None:
                    found = _attributes(raw)
                    told = known[tag, raw] = (general_label(tag, found), left_out(tag, found), tag == "main" or found.get("role") == "main" or found.get("itemprop") == "articleBody", of_article(tag, found))
                label, own, chief, holds = told
                if own == BY_NAME and not by_name:
                    own = ALIVE
                if tag == "header" and own != BY_NAME:
                    own = HEAD_OF_ARTICLE if held[where] else BY_TAG
                if why == BY_NAME and chief or why == HEAD_OF_ARTICLE and tag in HEADINGS:
                    cause = own
                elif why == ALIVE or why == HEAD_OF_ARTICLE and own:
                    cause = own
                if not cause and tag in CONTAINERS:
                    path = f"{page.path[where]}/{label}"
                    if len(path) > LONGEST_PATH:
                        path = f"#{hashlib.blake2b(path.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}/{label[:LONGEST_PATH]}"
                    inner = len(page.parent)
                    page.parent.append(where)
                    page.path.append(path)
                    page.tag.append(tag)
                    held.append(held[where] or holds)
            stack.append((tag, inner, cause))
            opened[tag] += 1
            headings += tag in HEADINGS
            where, why = inner, cause
    flush()
    return page


def begins_comments(text: str) -> bool:
    """Whether a heading begins a list of reader comments."""
    return len(text) < 60 and bool(_READERS.fullmatch(text))
