"""Sources: inventories, dictionaries, archives and markup, read as DataFrames."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schema
from lodestack.functions.text import collapse_ws

INVENTORY = "source_id string, native_id string, type string, title string, date string, canonical_url string, upstream_version string, content_hash string, downloaded_at string, payload string"
#: Bounds on what an archive may unpack to.
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 10_000, 64 << 20, 512 << 20
MAX_DEPTH, MAX_NODES = 128, 200_000
_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(source: str) -> Callable:
    """Makes a reader known under its source id."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if not re.fullmatch(schema.SOURCE_ID, source) or source in _REGISTRY:
            raise ValueError(f"bad or repeated source {source!r}")
        _REGISTRY[source] = f
        return f

    return add


def documents(spark: SparkSession, source: str, path: str) -> DataFrame:
    if source not in _REGISTRY:
        raise ValueError(f"unknown source {source!r}")
    return _REGISTRY[source](spark, path)


def read_inventory(spark: SparkSession, path: str, ddl: str = INVENTORY) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a malformed line or a repeated document is an error."""
    rows = spark.read.schema(ddl).option("mode", "FAILFAST").json(path)
    return schema.require_unique(rows, ["source_id", "native_id"], "documents")


def write_inventory(rows: DataFrame, path: str) -> None:
    """Sorted by document; the folder appears only when its job has committed."""
    rows.repartitionByRange("source_id", "native_id").sortWithinPartitions("source_id", "native_id").write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_dictionary(spark: SparkSession, path: str, most: int = 5) -> DataFrame:
    """norm, term, definition from JSON lines or arrays, else tab-separated lines; at most ``most`` meanings of a term."""
    from pyspark.sql import Window

    raw = spark.read.text(path, wholetext=True)
    kinds = "array<struct<term:string,definition:string>>"
    whole = F.from_json(F.when(F.trim("value").startswith("["), F.col("value")), kinds)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    by_json = F.transform(lines, lambda x: F.from_json(x, "struct<term:string,definition:string>"))
    by_tab = F.transform(lines, lambda x: F.struct(F.split(x, "\t")[0].alias("term"), F.try_element_at(F.split(x, "\t"), F.lit(2)).alias("definition")))
    chosen = F.when(F.trim("value").startswith("["), whole).when(F.trim("value").startswith("{"), by_json).otherwise(by_tab)
    rows = raw.select(F.posexplode(chosen).alias("seq", "d")).select("seq", "d.*").where("term is not null and definition is not null")
    norm = rows.withColumn("norm", F.lower(collapse_ws(F.col("term"))))
    return norm.withColumn("n", F.row_number().over(Window.partitionBy("norm").orderBy("seq"))).where(F.col("n") <= most).select("norm", "term", "definition", "n")


def read_wordnet(lines: DataFrame, pos: str) -> DataFrame:
    """norm, term, pos, gloss from the lines (``value``) of a data file: the third-next field is the number of words in hex."""
    data = lines.where(F.col("value").rlike(r"^\d{8} ") & F.contains("value", F.lit(" | ")))
    fields = F.split(F.substring_index("value", " | ", 1), " ")
    count = F.conv(fields[3], 16, 10).cast("int")
    words = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.get(fields, 4 + 2 * i))
    gloss = F.trim(F.substring_index("value", " | ", -1))
    out = data.select(F.explode(words).alias("word"), gloss.alias("gloss")).where("word is not null")
    term = F.regexp_replace(F.replace("word", F.lit("_"), F.lit(" ")), r"\((?:a|p|ip)\)$", "")
    return out.select(F.lower(term).alias("norm"), term.alias("term"), F.lit(pos).alias("pos"), "gloss").distinct()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size and content of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def safe_path(name: str) -> bool:
    return bool(name) and not name.startswith(("/", "\\")) and "\\" not in name and ":" not in name and ".." not in name.split("/") and "\x00" not in name


def archive_entries(data: bytes) -> dict[str, bytes]:
    """Files of a ZIP archive within bounds; unsafe or repeated names are an error."""
    out: dict[str, bytes] = {}
    total = 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if len(z.infolist()) > MAX_ENTRIES:
            raise ValueError("too many entries")
        for info in z.infolist():
            if info.is_dir():
                continue
            if not safe_path(info.filename) or info.filename in out:
                raise ValueError(f"bad entry {info.filename!r}")
            total += info.file_size
            if info.file_size > MAX_ENTRY or total > MAX_TOTAL:
                raise ValueError("archive unpacks to too much")
            out[info.filename] = z.read(info)
    return out


def parse_xml(text: str | bytes) -> ElementTree.Element:
    """An XML tree without a document type, within bounds of depth and size."""
    if re.search(rb"<!DOCTYPE|<!ENTITY" if isinstance(text, bytes) else r"<!DOCTYPE|<!ENTITY", text):
        text = re.sub(rb"<!DOCTYPE[^>\[]*>" if isinstance(text, bytes) else r"<!DOCTYPE[^>\[]*>", b"" if isinstance(text, bytes) else "", text)
        if re.search(rb"<!ENTITY|<!DOCTYPE" if isinstance(text, bytes) else r"<!ENTITY|<!DOCTYPE", text):
            raise ValueError("document type with declarations")
    root = ElementTree.fromstring(text)
    nodes, level, depth = 0, [root], 0
    while level:
        depth, nodes = depth + 1, nodes + len(level)
        if depth > MAX_DEPTH or nodes > MAX_NODES:
            raise ValueError("XML tree is too large")
        level = [c for n in level for c in n]
    return root


def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def epub_html(data: bytes) -> str:
    """The parts of an EPUB in the order of its spine, else its XHTML items by name; links between parts become anchors."""
    files = archive_entries(data)
    container = parse_xml(files["META-INF/container.xml"])
    opf_path = next(n.attrib["full-path"] for n in container.iter() if _local(n.tag) == "rootfile")
    opf, base = parse_xml(files[opf_path]), posixpath.dirname(opf_path)
    items = {n.attrib["id"]: n for n in opf.iter() if _local(n.tag) == "item"}
    path = lambda i: posixpath.normpath(posixpath.join(base, items[i].attrib["href"]))
    spine = [n.attrib["idref"] for n in opf.iter() if _local(n.tag) == "itemref" and n.attrib["idref"] in items]
    order = [path(i) for i in spine] or sorted(path(i) for i, n in items.items() if "html" in n.attrib.get("media-type", ""))
    part = {p: f"part-{i}" for i, p in enumerate(order)}
    out = []
    for p in order:
        body = re.search(rb"<body[^>]*>(.*)</body>", files[p], re.S | re.I)
        text = (body[1] if body else files[p]).decode("utf-8", "replace")

        def link(m: re.Match, p: str = p) -> str:
            file, _, name = m[1].partition("#")
            goal = posixpath.normpath(posixpath.join(posixpath.dirname(p), file)) if file else p
            return f'href="#{name or part[goal]}"' if goal in part else m[0]

        out.append(f'<section id="{part[p]}">' + re.sub(r'href="([^":]*)"', link, text) + "</section>")
    return "<article>" + "".join(out) + "</article>"


def ordinal_label(n: int, style: str) -> str:
    """A list number: decimal, letters (a…z, aa…) or roman."""
    if style in ("lowerLetter", "upperLetter"):
        text = chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1)
    elif style in ("lowerRoman", "upperRoman"):
        text = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            text += sign * (n // value)
            n %= value
    elif style == "ordinal":
        text = f"{n}{'th' if 10 <= n % 100 <= 20 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"
    else:
        text = str(n)
    return text.upper() if style.startswith("upper") else text


def docx_html(data: bytes) -> str:
    """Paragraphs by style, lists with numbers, tables, and footnotes in order of their first visible reference."""
    from html import escape

    files = archive_entries(data)
    body = next(n for n in parse_xml(files["word/document.xml"]).iter() if _local(n.tag) == "body")
    attr = lambda n, k: next((v for a, v in n.attrib.items() if _local(a) == k), None)
    child = lambda n, k: next((c for c in n if _local(c.tag) == k), None)
    notes: dict[str, str] = {}
    if "word/footnotes.xml" in files:
        for n in parse_xml(files["word/footnotes.xml"]).iter():
            if _local(n.tag) == "footnote" and attr(n, "type") in (None, "normal"):
                if attr(n, "id") in notes:
                    raise ValueError(f"footnote {attr(n, 'id')} twice")
                notes[attr(n, "id")] = "".join(t.text or "" for t in n.iter() if _local(t.tag) == "t").strip()
    cited: list[str] = []
    counts: dict[tuple[str, int], int] = {}

    def inline(p: ElementTree.Element, deleted: bool = False) -> str:
        out = ""
        for n in p:
            kind = _local(n.tag)
            if kind == "del":
                continue
            if kind == "t":
                out += escape(n.text or "")
            elif kind == "tab":
                out += " "
            elif kind == "br":
                out += "<br>"
            elif kind == "footnoteReference":
                ident = attr(n, "id")
                if ident not in notes:
                    raise ValueError(f"footnote {ident} is missing")
                if ident not in cited:
                    cited.append(ident)
                out += f'<sup><a href="#fn{cited.index(ident) + 1}">{cited.index(ident) + 1}</a></sup>'
            elif kind == "r":
                props = child(n, "rPr")
                text = inline(n)
                for tag in ("i", "b"):
                    if props is not None and child(props, tag) is not None and text.strip():
                        text = f"<{tag}>{text}</{tag}>"
                out += text
            elif kind not in ("pPr", "rPr"):
                out += inline(n)
        return out

    def block(n: ElementTree.Element) -> str:
        kind = _local(n.tag)
        if kind == "tbl":
            rows = ("".join("<td>" + "".join(block(x) for x in c if _local(x.tag) in ("p", "tbl")) + "</td>" for c in r if _local(c.tag) == "tc") for r in n if _local(r.tag) == "tr")
            return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"
        if kind != "p":
            return "".join(block(c) for c in n) if kind in ("sdt", "sdtContent") else ""
        text, props = inline(n).strip(), child(n, "pPr")
        if not text:
            return ""
        style = attr(child(props, "pStyle"), "val") if props is not None and child(props, "pStyle") is not None else ""
        number = child(props, "numPr") if props is not None else None
        if m := re.fullmatch(r"[Hh]eading\s?([1-6])", style or ""):
            return f"<h{m[1]}>{text}</h{m[1]}>"
        if number is not None:
            level = int(attr(child(number, "ilvl"), "val") or 0) if child(number, "ilvl") is not None else 0
            ident = attr(child(number, "numId"), "val") if child(number, "numId") is not None else "0"
            counts[(ident, level)] = counts.get((ident, level), 0) + 1
            for key in [k for k in counts if k[0] == ident and k[1] > level]:
                del counts[key]
            return f"<p>{ordinal_label(counts[(ident, level)], ('decimal', 'lowerLetter', 'lowerRoman')[level % 3])}. {text}</p>"
        return f"<p>{text}</p>"

    main = "".join(block(n) for n in body)
    tail = "".join(f'<p id="fn{i}">{i}. {escape(notes[k])}</p>' for i, k in enumerate(cited, 1))
    return f"<article>{main}{tail}</article>"


def archives_html(files: DataFrame, convert: Callable[[bytes], str]) -> DataFrame:
    """path, sha256 and HTML of each archive; what can't be read has a fault instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html, faults = [], []
            for data in b.column(2).to_pylist():
                try:
                    html.append(convert(data)), faults.append(None)
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    html.append(None), faults.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(html, pa.string()), pa.array(faults, pa.string())], names=["path", "sha256", "html", "fault"])

    return files.select("path", "sha256", "content").mapInArrow(run, "path string, sha256 string, html string, fault string")
