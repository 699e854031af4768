"""Public identifiers: documents, chunks, assets, URIs and cursors. Plain Python; ``*_col`` are column forms."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE = re.compile(r"[a-z0-9-]+")
GENERATION = re.compile(r"[A-Za-z0-9._-]+")
#: Characters that a public component escapes, besides controls and blanks.
RESERVED = "%:?#[]"
MAX_COMPONENT = 256


def encode_component(text: str) -> str:
    return "".join(f"%{b:02X}" if b < 33 or b == 127 or chr(b) in RESERVED else chr(b) for b in text.encode()) if text.isascii() else "".join(c if ord(c) > 127 else encode_component(c) for c in text)


def decode_component(text: str) -> str:
    """Inverse of :func:`encode_component`; anything but its own output is an error."""
    if not text or len(text.encode()) > MAX_COMPONENT:
        raise ValueError("component is empty or too long")
    out = unquote_to_bytes(text).decode("utf-8")
    if encode_component(out) != text:
        raise ValueError(f"not canonical: {text!r}")
    return out


def encode_segment(text: str) -> str:
    """Percent-encode all but unreserved characters, upper-case hex."""
    return "".join(chr(b) if chr(b).isalnum() and b < 128 or chr(b) in "-._~" else f"%{b:02X}" for b in text.encode())


def decode_segment(text: str) -> str:
    out = unquote_to_bytes(text).decode("utf-8")
    if encode_segment(out) != text:
        raise ValueError(f"not canonical: {text!r}")
    return out


@dataclass(frozen=True, order=True)
class DocumentId:
    source: str
    native_id: str

    def __post_init__(self) -> None:
        if not SOURCE.fullmatch(self.source):
            raise ValueError(f"bad source {self.source!r}")
        if not self.native_id:
            raise ValueError("empty native id")

    def __str__(self) -> str:
        return f"{self.source}:{encode_component(self.native_id)}"

    @classmethod
    def parse(cls, text: str) -> DocumentId:
        source, sep, rest = text.partition(":")
        if not sep:
            raise ValueError(f"bad document id {text!r}")
        return cls(source, decode_component(rest))


@dataclass(frozen=True, order=True)
class ChunkRef:
    generation: str
    source: str
    chunk_id: int

    def __str__(self) -> str:
        return f"{self.generation}:{self.source}:{self.chunk_id}"

    @classmethod
    def parse(cls, text: str) -> ChunkRef:
        parts = text.split(":")
        if len(parts) != 3 or not GENERATION.fullmatch(parts[0]) or not SOURCE.fullmatch(parts[1]) or not re.fullmatch(r"0|[1-9]\d*", parts[2]):
            raise ValueError(f"bad chunk reference {text!r}")
        return cls(parts[0], parts[1], int(parts[2]))


@dataclass(frozen=True, order=True)
class AssetRef:
    source: str
    asset_id: str

    def __str__(self) -> str:
        return f"{self.source}:{encode_component(self.asset_id)}"

    @classmethod
    def parse(cls, text: str) -> AssetRef:
        doc = DocumentId.parse(text)
        return cls(doc.source, doc.native_id)


@dataclass(frozen=True)
class DocUri:
    """``legal://source/native[?pit&view]``; only the canonical spelling parses."""

    source: str
    native_id: str
    pit: str | None = None
    view: str | None = None

    def __str__(self) -> str:
        query = "&".join(f"{k}={encode_segment(v)}" for k, v in (("pit", self.pit), ("view", self.view)) if v)
        path = "/".join(encode_segment(s) for s in self.native_id.split("/"))
        return f"legal://{self.source}/{path}" + (f"?{query}" if query else "")

    @classmethod
    def parse(cls, text: str) -> DocUri:
        found = re.fullmatch(r"legal://([a-z0-9-]+)/([^?#]+)(?:\?([^#]*))?", text)
        if not found:
            raise ValueError(f"bad uri {text!r}")
        given = dict(p.partition("=")[::2] for p in found[3].split("&")) if found[3] else {}
        if set(given) - {"pit", "view"}:
            raise ValueError("unknown query parameter")
        out = cls(found[1], "/".join(decode_segment(s) for s in found[2].split("/")), *(decode_segment(given[k]) if k in given else None for k in ("pit", "view")))
        if out.pit is not None and not re.fullmatch(r"\d{8,14}", out.pit):
            raise ValueError("bad point in time")
        if str(out) != text:
            raise ValueError(f"not canonical: {text!r}")
        return out


def encode_cursor(state: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(state, separators=(",", ":"), sort_keys=True).encode()).rstrip(b"=").decode()


def decode_cursor(text: str) -> dict:
    try:
        return json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError as e:
        raise ValueError("bad cursor") from e


def canonical_path_col(native_id: Column) -> Column:
    """Upper case for the first two segments, for all of the CLR and OPS families."""
    parts = F.split(native_id, "/", -1)
    whole = F.upper(F.element_at(parts, 1)).isin("CLR", "OPS")
    return F.array_join(F.transform(parts, lambda x, i: F.when((i < 2) | whole, F.upper(x)).otherwise(x)), "/")


def document_type_col(native_id: Column) -> Column:
    return F.upper(F.element_at(F.split(native_id, "/", -1), 1))


def pit_date_col(pit: Column) -> Column:
    """The date of a point in time of 8 to 14 digits; null if there is none."""
    return F.when(pit.rlike(r"^\d{8,14}$"), F.try_to_date(F.substring(pit, 1, 8), "yyyyMMdd"))
