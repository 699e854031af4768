"""HTML by a small tree over the standard parser: cleaning, marker text, headings, links and anchors.

The tree closes what HTML lets stand open (p, li, dt, dd, tr, td, th, option)
and ignores end tags that match nothing, so malformed pages have one reading.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urlsplit

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("script style noscript nav header footer aside form iframe svg template button".split())
BLOCK = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What an opening tag closes, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CONTAINERS = ("LawContent", "lawContents", "LawContents", "contents", "LawBody", "lawbody")
#: What the switches of a page's history say, as text or of an image.
HISTORY_SWITCH = re.compile(r"(?i)\s*(?:view|hide) history (?:note|reference)\s*")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def text(self) -> str:
        return " ".join("".join(c if isinstance(c, str) else f" {c.text()} " if c.tag in BLOCK else c.text() for c in self.children).split())

    def html(self) -> str:
        if self.tag == "#root":
            return "".join(escape(c, quote=False) if isinstance(c, str) else c.html() for c in self.children)
        head = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{head}>"
        return f"<{self.tag}{head}>" + "".join(escape(c, quote=False) if isinstance(c, str) else c.html() for c in self.children) + f"</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close(self, tags: set[str], until: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in until:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        elif tag in BLOCK:
            self._close({"p"}, {"td", "th", "div", "li", "body"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def strip(node: Node, drop: Callable[[Node], bool]) -> Node:
    node.children = [c if isinstance(c, str) else strip(c, drop) for c in node.children if isinstance(c, str) or not drop(c)]
    return node


def container(root: Node) -> Node:
    """The first of the known containers by id, else main, else body, else all."""
    for name in CONTAINERS:
        if found := root.first(lambda n, name=name: n.attrs.get("id") == name):
            return found
    return root.first(lambda n: n.tag == "main") or root.first(lambda n: n.tag == "body") or root


def is_noise(n: Node) -> bool:
    marks = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()
    return n.tag in NOISE or bool(re.search(r"\b(ads?|advert\w*|banner|cookie\w*|sidebar|breadcrumbs?)\b", marks)) or "history-panel" in marks


def without_switches(node: Node) -> Node:
    """The tree without texts and images that switch a page's history on or off."""
    said = lambda c: (c,) if isinstance(c, str) else (c.attrs.get("title", ""), c.attrs.get("alt", "")) if c.tag == "img" else ()
    node.children = [c if isinstance(c, str) else without_switches(c) for c in node.children if not any(HISTORY_SWITCH.fullmatch(x) for x in said(c))]
    return node


def title_of(root: Node) -> str:
    for tag in ("title", "h1"):
        if found := root.first(lambda n, tag=tag: n.tag == tag):
            if found.text():
                return found.text()
    return ""


def headings(root: Node) -> list[str]:
    return [t for n in root.walk() if n.tag in HEADINGS and (t := n.text())]


def leading_headings(root: Node, most: int = 4, wrapper: int = 800) -> list[str]:
    """Headings before the first body text; one small wrapper is looked into."""
    out: list[str] = []

    def scan(node: Node, dived: bool) -> bool:
        for c in node.children:
            if len(out) >= most:
                return False
            if isinstance(c, str):
                if c.strip():
                    return False
            elif c.tag in HEADINGS:
                if c.text():
                    out.append(c.text())
            elif c.text():
                if dived or len(c.text().encode()) > wrapper or not any(x.tag in HEADINGS for x in c.walk()):
                    return False
                return scan(c, True)
        return True

    scan(node=root, dived=False)
    return out


def document_of_link(href: str, base: str = "https://www.ato.gov.au") -> tuple[str, str | None, str | None] | None:
    """(native id, point in time, view) of a link to a document of the policy source; None for any other."""
    parts = urlsplit(href if "://" in href else base + ("" if href.startswith("/") else "/") + href)
    if parts.scheme not in ("http", "https") or parts.hostname != urlsplit(base).hostname or parts.path.rstrip("/") not in ("/law/view/document", "/law/view.htm"):
        return None
    given = {k.lower(): v for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    if len(given.get("docid", [])) != 1:
        return None
    native = unquote(given["docid"][0]).strip().strip('"')
    if not native or native.startswith("/"):
        return None
    segments = native.split("/")
    whole = segments[0].upper() in ("CLR", "OPS")
    native = "/".join(s.upper() if whole or i < 2 else s for i, s in enumerate(segments))
    one = lambda k: given[k][0] if len(given.get(k, [])) == 1 and given[k][0] else None
    return native, one("pit"), one("view")


def referenced(root: Node) -> set[str]:
    return {n.attrs["href"][1:] for n in root.walk() if n.tag == "a" and n.attrs.get("href", "").startswith("#") and len(n.attrs["href"]) > 1}


def targets(root: Node) -> set[str]:
    return {v for n in root.walk() for v in (n.attrs.get("id"), n.attrs.get("name") if n.tag == "a" else None) if v}


def render(node: Node, names: set[str], source: str = "ato") -> str:
    """Marker text: ``[doc:…]``, ``[anchor:…]``, ``[image:…]``, ``[asset:…]``, emphasis, headings, blocks on lines of their own."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
            continue
        name = c.attrs.get("id") or (c.attrs.get("name") if c.tag == "a" else None)
        mark = f"[anchor:{name}]" if name in names else ""
        inner = mark + render(c, names, source)
        if c.tag == "br":
            out.append("\n")
        elif c.tag == "a" and c.attrs.get("data-doc-id"):
            # a rewritten link names its document itself
            tail = "".join(f" {k}={v}" for k in ("pit", "view") if (v := c.attrs.get(f"data-{k}")))
            out.append(f"{inner.strip()} [doc:{c.attrs['data-doc-id']}{tail}]")
        elif c.tag == "a" and (doc := document_of_link(c.attrs.get("href", ""))):
            tail = "".join(f" {k}={v}" for k, v in (("pit", doc[1]), ("view", doc[2])) if v)
            out.append(f"{inner.strip()} [doc:{source}:{doc[0]}{tail}]")
        elif c.tag == "img":
            alt, asset = c.attrs.get("alt", "").strip(), c.attrs.get("data-asset-ref") or c.attrs.get("data-asset")
            out.append(mark + " ".join(f"[{k}:{v}]" for k, v in (("image", alt and f" {alt}"), ("asset", asset)) if v))
        elif c.tag == "span" and c.attrs.get("data-asset-ref"):
            out.append(f"{mark}[asset:{c.attrs['data-asset-ref']}]")
        elif c.tag in ("b", "strong"):
            whole = inner.strip()
            out.append(f"***{whole.strip('*')}***" if whole.startswith("*") and not whole.startswith("**") and whole.endswith("*") else f"**{whole}**" if whole else "")
        elif c.tag in ("i", "em"):
            whole = inner.strip()
            out.append(f"***{whole.strip('*')}***" if whole.startswith("**") else f"*{whole}*" if whole else "")
        elif c.tag in HEADINGS:
            out.append(f"\n\n{'#' * int(c.tag[1])} {inner.strip()}\n\n")
        elif c.tag == "li":
            out.append(f"\n- {inner.strip()}\n")
        elif c.tag == "tr":
            cells = [render(x, names, source).strip() for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")]
            out.append("\n" + " | ".join(cells) + "\n")
        elif c.tag in BLOCK:
            out.append(f"\n{inner}\n")
        else:
            out.append(inner)
    return "".join(out)


def tidy(text: str) -> str:
    lines = [re.sub(r"[ \t ]+", " ", x).strip() for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def cleaned(html: str, source: str = "ato") -> tuple[str, str, str]:
    """(clean HTML, marker text, title) of a page."""
    root = parse(html)
    title = title_of(root)
    body = without_switches(strip(container(root), is_noise))
    return body.html(), tidy(render(body, referenced(root), source)), title


def links(html: str) -> list[tuple[str, str]]:
    """(href, label) in order, without script and data links."""
    return [(n.attrs["href"].strip(), n.text()) for n in parse(html).walk() if n.tag == "a" and n.attrs.get("href", "").strip() and not re.match(r"(?i)\s*(javascript|data):", n.attrs["href"])]


#: Points in time that stand for "now" and "from the beginning".
SENTINELS = ("99991231235958", "10010101000001")


def _labels(root: Node) -> dict[int, str]:
    """For each link in a table row, the text of the row's other cells."""
    out: dict[int, str] = {}
    for row in (n for n in root.walk() if n.tag == "tr"):
        cells = [n for n in row.walk() if n.tag in ("td", "th")]
        texts = [c.text() for c in cells]
        for i, c in enumerate(cells):
            beside = " ".join(t for k, t in enumerate(texts) if k != i and t)
            for n in c.walk():
                if n.tag == "a":
                    out[id(n)] = beside
    return out


def anchors(html: str, own: str) -> list[dict]:
    """Links as anchors, each once: ``in_doc`` (a name that the page has), ``history`` (a document at a point in time), ``sister`` (another document).

    A label is the text beside the link in its table row, then its own; of a
    history with the day, and ``(unnamed)`` if there is none.
    """
    from lodestack.functions.extract import pit_to_date
    from lodestack.ident import DocumentId

    root = parse(html)
    names, beside = targets(root), _labels(root)
    out, seen = [], set()
    for n in root.walk():
        # a rewritten link names its document itself
        named = n.attrs.get("data-doc-id", "") if n.tag == "a" else ""
        href = n.attrs.get("href", "") if n.tag == "a" else ""
        if not href and not named:
            continue
        target, pit = href[1:], None
        if named:
            try:
                target = DocumentId.parse(named).native_id
            except ValueError:
                continue
            pit = n.attrs.get("data-pit") or None
            pit = None if pit in SENTINELS else pit
            if pit is None and target == own:
                continue
            kind = "history" if pit else "sister"
        elif href.startswith("#"):
            if target not in names:
                continue
            kind = "in_doc"
        else:
            found = document_of_link(href)
            if not found:
                continue
            target, pit = found[0], None if found[1] in SENTINELS else found[1]
            if pit is None and target == own:
                continue
            kind = "history" if pit else "sister"
        parts = dict.fromkeys(t for t in (beside.get(id(n), ""), n.text()) if t)
        label = " ".join(parts)
        if pit:
            day = pit_to_date(pit) or pit.strip()
            label = f"{label} ({day})" if label else day
        row = {"kind": kind, "label": label or "(unnamed)", "target": target, "pit": pit}
        if tuple(row.values()) not in seen:
            seen.add(tuple(row.values()))
            out.append(row)
    return out


def front_matter(html: str) -> tuple[list[str], str | None]:
    """What the front of an explanatory document says: its references and the phrase that names its kind."""
    front = parse(html).first(lambda n: n.attrs.get("id") == "Lawfront")
    refs, phrase = [], None
    for child in front.children if front else []:
        strong = child.first(lambda n: n.tag == "strong") if isinstance(child, Node) else None
        told = strong.text() if strong else ""
        if isinstance(child, Node) and child.tag == "div" and "ref" in child.attrs.get("class", "").split() and told:
            refs.append(told)
        elif isinstance(child, Node) and child.tag == "p" and phrase is None and told.lower().startswith("explanatory "):
            phrase = told
    return refs, phrase


def law_contents(html: str) -> str | None:
    """The first article's content in a division named for it."""
    article = parse(html).first(lambda n: n.tag == "article")
    return None if article is None else Node("div", {"id": "lawContents"}, article.children).html()


def withdrawn_by_timeline(html: str) -> str | None:
    """The last day that the table around the timeline's anchor gives for a withdrawal."""
    from lodestack.functions.extract import real_date

    root = parse(html)
    holds = lambda n: n.first(lambda x: x.tag == "a" and x.attrs.get("name") == "LawTimeLine") is not None
    panels = [n for n in root.walk() if (n.tag == "table" or "panel" in n.attrs.get("class", "").split()) and holds(n)]
    latest = None
    for row in (n for n in panels[-1].walk() if n.tag == "tr") if panels else ():
        cells = [n for n in row.walk() if n.tag == "td"]
        at = next((i for i, c in enumerate(cells) if "date" in c.attrs.get("class", "").lower()), None)
        if len(cells) < 2 or at is None:
            continue
        label = cells[at + 1] if at + 1 < len(cells) else cells[-1]
        if "withdraw" in label.text().lower():
            latest = real_date(cells[at].text()) or latest
    return latest


_TAG_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s>]*))"""


def attribute_of(tag: str, name: str) -> str | None:
    m = re.search(rf"(?is)\b{re.escape(name)}\s*=\s*{_TAG_VALUE}", tag)
    return next((g for g in m.groups() if g is not None), "") if m else None


def linked(html: str, source: str = "ato") -> str:
    """Links to documents become references to them; script and data links lose their address."""

    def one(m: re.Match) -> str:
        href = attribute_of(m[1], "href")
        if href is None:
            return m[0]
        bare = re.sub(r"""(?is)\s+href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*)""", "", m[1])
        if found := document_of_link(href):
            from lodestack.ident import DocumentId

            native, pit, view = found
            told = {"data-doc-id": str(DocumentId(source, native)), "data-pit": pit, "data-view": view}
            return f"<a{bare}" + "".join(f' {k}="{escape(v)}"' for k, v in told.items() if v) + ">"
        dead = not href.strip() or re.match(r"(?i)\s*(javascript|data):", href)
        return f"<a{bare}>" if dead else m[0]

    return re.sub(r"(?is)<a\b([^>]*)>", one, html)


def pictured(html: str, document: str) -> tuple[str, list[dict]]:
    """Images become spans that refer to numbered assets; warning signs go. Also the assets: id, src, alt, title."""
    assets: list[dict] = []

    def one(m: re.Match) -> str:
        src, alt, title = ((" ".join((attribute_of(m[1], k) or "").split()) or None) for k in ("src", "alt", "title"))
        if (alt or title or "").lower() == "exclamation":
            return ""
        asset = {"asset_id": f"{document}/{len(assets)}", "src": src, "alt": alt, "title": title}
        assets.append(asset)
        return f'<span data-asset-ref="{escape(asset["asset_id"])}">{escape(alt or title or "")}</span>'

    return re.sub(r"(?is)<img\b([^>]*)>", one, html), assets


ALLOWED = frozenset("a article blockquote br caption code dd div dl dt em h1 h2 h3 h4 h5 h6 hr i img li ol p pre section span strong b sub sup table tbody td th thead tr ul".split())
KEPT = {"a": ("href", "name"), "img": ("src", "alt", "title"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}


def normalised(html: str) -> str:
    """Only allowed tags and attributes; other tags give way to their contents, noise goes."""

    def keep(n: Node) -> list[Node | str]:
        inner: list[Node | str] = []
        for c in n.children:
            inner += [c] if isinstance(c, str) else [] if is_noise(c) else keep(c)
        if n.tag not in ALLOWED:
            return inner
        attrs = {k: v for k in KEPT.get(n.tag, ()) if (v := n.attrs.get(k)) and not re.match(r"(?i)\s*(javascript|data):", v)}
        return [Node(n.tag, attrs, inner)]

    root = parse(html)
    return "<article>" + Node("#root", {}, keep(container(root))).html().strip() + "</article>"
