"""Deterministic chunks from HTML: blocks, headings attached to what follows, greedy packing to a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from lodestack.functions.html import BLOCK, HEADINGS, Node, container, is_noise, parse, referenced, render, strip, tidy
from lodestack.functions.wordpiece import LIMIT, split_exactly

#: Chunk format and budget, tokens to a word, and the widest run of words.
FORMAT, BUDGET = 9, 512
TOKENS_PER_WORD, WINDOW_DIVISOR = 1.3, 1.4
_MARKER = re.compile(r"\[(?:doc|anchor|asset|fetch):[^\]]*\]")


@dataclass
class Block:
    kind: str
    text: str
    anchor: str | None = None


def approx_tokens(text: str) -> int:
    return max(1, int(len(text.split()) * TOKENS_PER_WORD))


def normalise(text: str) -> str:
    text = text.replace(" ", " ")
    text = re.sub(r"[ \t]+", " ", text)
    text = re.sub(r" *\n *", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    text = re.sub(r"(\d) - (\d)", r"\1-\2", text)
    return re.sub(r'" ([^"\n]*) "', r'"\1"', text)


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z(])", text) if s]


def word_windows(text: str, budget: int) -> list[str]:
    """Runs of at most budget / 1.4 words; a marker is never cut."""
    whole = _MARKER.sub(lambda m: m[0].replace(" ", "\x00"), text).split(" ")
    size = max(1, int(budget / WINDOW_DIVISOR))
    return [" ".join(whole[i : i + size]).replace("\x00", " ") for i in range(0, len(whole), size)]


def blocks(html: str, title: str = "") -> list[Block]:
    """Headings, paragraphs, list items, table rows, definition pairs, quotes and preformatted text, in order."""
    root = parse(html)
    names = referenced(root)
    out: list[Block] = []
    inline: list[Node | str] = []

    def anchor_of(n: Node) -> str | None:
        return next((v for x in n.walk() for v in (x.attrs.get("id"), x.attrs.get("name") if x.tag == "a" else None) if v and v in names), None)

    def flush() -> None:
        if inline:
            holder = Node("#root", {}, list(inline))
            text = normalise(tidy(render(holder, set())))
            if text:
                out.append(Block("p", text, anchor_of(holder)))
            inline.clear()

    def add(kind: str, n: Node, text: str, anchor: str | None = None) -> None:
        text = normalise(tidy(text))
        if text:
            out.append(Block(kind, text, anchor or anchor_of(n)))

    def visit(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str) or c.tag not in BLOCK and not any(x.tag in BLOCK for x in c.walk()):
                inline.append(c)
                continue
            flush()
            inner = render(c, set())
            if c.tag in HEADINGS:
                own = c.attrs.get("id") or next((x.attrs.get("id") or x.attrs.get("name") for x in c.walk() if x.tag == "a" and (x.attrs.get("id") or x.attrs.get("name"))), None)
                text = normalise(tidy(inner))
                if text and text.lower() != normalise(title).lower():
                    out.append(Block(c.tag, text, own))
            elif c.tag == "tr":
                add("tr", c, " | ".join(normalise(tidy(render(x, set()))) for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")))
            elif c.tag == "dt":
                add("dt", c, inner)
            elif c.tag == "dd" and out and out[-1].kind == "dt":
                out[-1] = Block("dl", f"{out[-1].text}: {normalise(tidy(inner))}", out[-1].anchor)
            elif c.tag == "pre":
                add("pre", c, "```\n" + "".join(x for m in c.walk() for x in m.children if isinstance(x, str)).strip("\n") + "\n```")
            elif c.tag == "blockquote":
                add("quote", c, "\n".join("> " + x for x in normalise(tidy(inner)).split("\n") if x))
            elif c.tag == "li" and not any(isinstance(x, Node) and x.tag in ("ul", "ol", "table") for x in c.children):
                add("li", c, "- " + normalise(tidy(inner)).replace("\n", " "))
            elif c.tag in ("p", "caption") and not any(isinstance(x, Node) and x.tag in BLOCK for x in c.children):
                add("p", c, inner)
            else:
                visit(c)
        flush()

    visit(strip(container(root), is_noise))
    return out


def split_oversize(block: Block, budget: int) -> list[Block]:
    """A block over the budget: whole table rows, else sentences, else runs of words."""
    if approx_tokens(block.text) <= budget:
        return [block]
    parts = block.text.split("\n") if block.kind in ("tr", "table") and "\n" in block.text else sentences(block.text)
    out, now = [], ""
    for part in parts:
        for piece in [part] if approx_tokens(part) <= budget else word_windows(part, budget):
            joined = f"{now} {piece}".strip()
            if now and approx_tokens(joined) > budget:
                out.append(now)
                now = piece
            else:
                now = joined
    out += [now] if now else []
    return [Block(block.kind, t, block.anchor if i == 0 else None) for i, t in enumerate(out)]


def _tokens(words: int) -> int:
    return max(1, int(words * TOKENS_PER_WORD))


def pack(found: list[Block], budget: int = BUDGET) -> list[Block]:
    """Greedy chunks: headings wait for a body and open a new chunk; a body too long repeats its heading on each part.

    The budget holds for the tokens of the whole chunk, counted from its words:
    counts of parts are cut off one by one and would add up to less.
    """
    out: list[Block] = []
    held: list[Block] = []
    now: list[Block] = []
    words = lambda blocks: sum(len(b.text.split()) for b in blocks)

    def close() -> None:
        nonlocal now
        if now:
            out.append(Block("chunk", "\n\n".join(b.text for b in now), next((b.anchor for b in now if b.anchor), None)))
        now = []

    for block in found:
        if block.kind in HEADINGS:
            level = int(block.kind[1])
            held = [h for h in held if int(h.kind[1]) < level] if held and level <= int(held[-1].kind[1]) else held
            held.append(block)
            continue
        context = [Block(h.kind, f"{'#' * int(h.kind[1])} {h.text}", h.anchor) for h in held]
        if held:
            close()
        room = max(1, budget - _tokens(words(context)) - 1) if context else budget
        for i, part in enumerate(split_oversize(block, room)):
            if now and (i > 0 or _tokens(words(now) + words([part])) > budget):
                close()
            if context and not now and (i == 0 or held):
                now = list(context)
            now.append(part)
        held = []
    if held:
        close()
        now = [Block(h.kind, f"{'#' * int(h.kind[1])} {h.text}", h.anchor) for h in held]
    close()
    return out


def chunk_html(html: str, title: str = "", budget: int = BUDGET, count: Callable[[str], int] | None = None, limit: int = LIMIT) -> list[tuple[int, str | None, str]]:
    """(ord, anchor, text) of each chunk. With ``count``, a chunk of more than ``limit`` tokens as the model counts them is split where it no longer fits."""
    packed = [(c.anchor, c.text) for c in pack(blocks(html, title), budget)]
    if count:
        parts = [(anchor, split_exactly(text, count, limit) if count(text) > limit else [text]) for anchor, text in packed]
        packed = [(anchor if i == 0 else None, x) for anchor, texts in parts for i, x in enumerate(texts)]
    return [(i, anchor, text) for i, (anchor, text) in enumerate(packed)]
