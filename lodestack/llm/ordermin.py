"""Document fingerprints by order min-hash, which feels edit distance.

Every character k-mer of a text is hashed together with the number of its
earlier occurrences. CELLS evenly spaced numbers are as many rotations of one
permutation: for each, the PICK k-mers whose hashes follow it (round the end of
the range if need be) are the least, so every cell is filled, of a short text
too. They are put back in the order of the text and their tuple is hashed. Two
texts agree in a cell only if the same k-mers are least and stand in the same
order, so moves count as well as replacements. (Rotations stand in for
independent permutations, which cost CELLS times as much.)

Likeness: the share of equal cells; 1 for equal fingerprints, so also for two
texts without a k-mer. A text shorter than a k-mer is one k-mer; an empty text
fills no cell.

Null text counts as empty. Order of documents: doc_id falling, null last, then
the hash of the text; repeated rows follow each other. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import textkit
from lodestack.llm.common import cut, partitions, require

K = 9
CELLS = 64
PICK = 2
_U = np.uint64
_SHIFT = _U(64 - CELLS.bit_length() + 1)
_STARTS = (np.arange(CELLS + 1, dtype=object) << int(_SHIFT)).tolist()
_BOUNDS = np.array(_STARTS[1:-1], dtype=np.uint64)


def kmers(text: str) -> np.ndarray:
    """Hashes of the k-mers in text order, equal ones told apart by their occurrence number."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.empty(0, _U)
    k = min(K, n)
    powers, inverses = textkit._tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((points.astype(_U) + _U(1)) * powers[:n], out=sums[1:])
    h = textkit.mix((sums[k:] - sums[: n - k + 1]) * inverses[: n - k + 1])
    ordered = np.sort(h)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        again = again[np.concatenate(([True], again[1:] != again[:-1]))]
        at = np.searchsorted(again, h)
        at[at == len(again)] = 0
        where = np.flatnonzero(again[at] == h)
        order = where[np.argsort(at[where], kind="stable")]
        group = at[order]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        number = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        later = number > 0
        h[order[later]] = textkit.mix(h[order[later]] + number[later].astype(_U) * _U(0x9E3779B97F4A7C15))
    return h


def fingerprint(text: str) -> np.ndarray:
    """CELLS numbers of sixteen bits; 0 for an empty cell."""
    out = np.zeros(CELLS, np.uint16)
    h = kmers(text)
    if not len(h):
        return out
    ordered = np.sort(h)
    starts = np.concatenate(([0], np.searchsorted(ordered, _BOUNDS)))
    values = ordered[(starts[:, None] + np.arange(PICK)) % len(h)]
    wanted = np.unique(values)
    at = np.searchsorted(wanted, h)
    at[at == len(wanted)] = 0
    hits = np.flatnonzero(wanted[at] == h)
    place = np.zeros(len(wanted), np.int64)
    place[at[hits]] = hits
    order = np.argsort(place[np.searchsorted(wanted, values)], axis=1, kind="stable")
    values = np.take_along_axis(values, order, axis=1)
    key = np.zeros(CELLS, _U)
    for j in range(PICK):
        key = textkit.mix(key * _U(31) + values[:, j] + _U(1))
    return ((key >> _U(48)) % _U(65535) + _U(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a > 0) | (b > 0)
    n = int(filled.sum())
    return float(((a == b) & filled).sum()) / n if n else 1.0


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by the beginning of the next."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def told(fp: np.ndarray) -> str:
    return fp.astype(">u2").tobytes().hex()


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("role", pa.int32()), ("pid", pa.int32()), ("text", pa.string())]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, role int, pid int, text string"
WHOLE, HEAD, TAIL = 0, 1, 2


def _judged(doc_id: int | None, text: str, fp: np.ndarray, following: str, next_fp: np.ndarray) -> tuple:
    other = edited(text, following)
    other_fp = fp if other == text else fingerprint(other)
    return (doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), told(fp), told(other_fp), likeness(fp, other_fp), likeness(fp, next_fp))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)], schema=_SCHEMA)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted partition with the next; the last waits for the next partition's first."""
    pid = TaskContext.get().partitionId()
    held = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fp = fingerprint(text)
            if held is None:
                rows.append((doc_id, len(text), None, told(fp), None, None, None, HEAD, pid, text))
            else:
                rows.append((*_judged(*held, text, fp), WHOLE, pid, None))
            held = (doc_id, text, fp)
        yield _batch(rows)
    if held is not None:
        doc_id, text, fp = held
        yield _batch([(doc_id, len(text), None, told(fp), None, None, None, TAIL, pid, text)])


def _join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows.append((*_judged(doc_id, text, fingerprint(text), following, fingerprint(following)), WHOLE, 0, None))
        yield _batch(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The texts move once, dealt by ranges of doc_id; only the first and last
    row of each range meet again, and of these only the range numbers are
    seen by the driver.
    """
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    order = [F.desc_nulls_last("doc_id"), F.col("th")]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    table = cut(ranged.select("doc_id", "text").mapInArrow(_walk, _DDL), "omh")
    columns = [c for c, _ in _FIELDS[:7]]
    heads = table.where(F.col("role") == HEAD)
    pids = sorted(r.pid for r in heads.select("pid").collect())
    after = spark.createDataFrame([(p, pids[(i + 1) % len(pids)]) for i, p in enumerate(pids)], "pid int, after int")
    tails = table.where(F.col("role") == TAIL).select("pid", "doc_id", "text").join(F.broadcast(after), "pid")
    ends = tails.join(heads.select(F.col("pid").alias("after"), F.col("text").alias("following")), "after").select("doc_id", "text", "following")
    return table.where(F.col("role") == WHOLE).select(columns).union(ends.mapInArrow(_join_ends, _DDL).select(columns))
