"""Near-duplicate documents by SuperMinHash.

Signature: each element of a set draws a random permutation of the slots, one
rank after another; the value at rank j is j plus a uniform number, so ranks
of one element are correlated and the estimate varies less than with
independent hashes. Drawing stops as soon as every slot holds a value below the
next rank, which later ranks can't improve.

Links: equal sets become one class first. Classes that share a band of their
signatures are candidates; at a similarity of 0.8 thirty bands of four lose a
pair in 10 million. Two passes keep big buckets cheap:

1. each class of a bucket against the bucket's hub, the class that shares most
   buckets (of a family of near copies that is the text they come from);
2. of buckets that still hold several components: the classes of a bucket that
   are outside its largest component meet all its classes, in blocks. The
   block holds the full sets: a pair of different components is tested on them
   at once, and a pair found similar makes one component of two, so a block
   hands out one link less than it has components and never a list of pairs.

Signatures that agree in too small a share are put aside before the sets are
compared: at 0.8 the share of equal slots varies by 0.0365 at most (120 slots,
independent ones; SuperMinHash varies less), LEAST_AGREEMENT lies four of these
below. That loses about one pair in 30,000 of those exactly at 0.8, and less
above; such a pair is lost only if no third text links its ends.

Components come from the distributed union-find. A row is identified by doc_id
and the hash of its text.

Null text counts as empty; a text without words links with nothing. Rows with
a null doc_id take part; their component may have a null id if no member has
one. Repeated rows and ties fall in one class. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestack.llm import textkit
from lodestack.llm.common import cut, drop, quoted, require, sieved
from lodestack.llm.unionfind import components

SLOTS = 120
#: Bands of ROWS slots.
BANDS, ROWS = 30, 4
#: Signatures that agree in a smaller share are not compared further.
LEAST_AGREEMENT = 0.65
#: Rows of a block; two blocks and their sets meet in a task's memory.
BLOCK = 256
_U = np.uint64
_SIGNED = "doc_id long, th long, n long, k1 long, k2 long, sig binary, bands array<long>"


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature (float64) of a set of 64-bit hashes; ``inf`` everywhere for an empty set."""
    sig = np.full(slots, np.inf)
    n = len(elements)
    if not n:
        return sig
    order = None
    rows = np.arange(n)
    for j in range(slots):
        drawn = textkit.mix(elements + _U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = (drawn >> _U(12)).astype(np.float64) * 2.0**-52 + j
        k = j + ((drawn & _U(0xFFF)) * _U(slots - j) >> _U(12)).astype(np.intp)
        if j == 0:
            slot, first = k, k
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint16), (n, 1))
                order[rows, first] = 0
            slot = order[rows, k].astype(np.intp)
            order[rows, k] = order[:, j]
        np.minimum.at(sig, slot, value)
        if sig.max() < j + 1:
            break
    return sig


def sketch(elements: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Sixteen bits of each slot, and a key of each band."""
    bits = textkit.mix(superminhash(elements).view(_U))
    key = np.zeros(BANDS, _U)
    for column in bits[: BANDS * ROWS].reshape(-1, ROWS).T:
        key = textkit.mix(key * _U(31) + column)
    key = textkit.mix(key + np.arange(len(key), dtype=_U))
    return (bits >> _U(48)).astype("<u2").tobytes(), key.view(np.int64)


def _signer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, sigs, bands = [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                have = textkit.shingle_set(text.as_py() or b"", width)
                digest = np.frombuffer(xxhash.xxh3_128_digest(have.tobytes()), np.int64)
                sig, keys = sketch(have) if len(have) else (b"", None)
                n.append(len(have)), k1.append(int(digest[0])), k2.append(int(digest[1])), sigs.append(sig), bands.append(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "th", "n", "k1", "k2", "sig", "bands"])

    return run


def _setter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [textkit.shingle_set(t.as_py() or b"", width).astype("<u8").tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "elements"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


@F.pandas_udf(DoubleType())
def agreement(a, b):  # noqa: ANN001, ANN201
    """Share of equal slots of two signatures."""
    x = np.frombuffer(b"".join(a), "<u2").reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), "<u2").reshape(len(b), -1)
    import pandas as pd

    return pd.Series((x == y).mean(axis=1)) if len(a) else pd.Series([], dtype=float)


def _pairs(percent: int):
    """Links (a, b) of which the full sets (columns x, y) are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            kept = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=["a", "b"])

    return run


def block_links(node: list, comp: list, n: np.ndarray, outer: np.ndarray, inner: np.ndarray, sig: np.ndarray, sets: list, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a block: each row of ``outer`` with the rows of ``inner``; a pair once."""
    up = {c: c for c in comp}

    def find(c):  # noqa: ANN001, ANN202
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    out = []
    both = {int(i) for i in outer} & {int(i) for i in inner}
    for i in outer.tolist():
        at = inner[inner > i] if both and i in both else inner
        at = at[(100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i]))]
        if not len(at):
            continue
        near = (sig[at] == sig[i]).mean(axis=1)
        # the likeliest first: once joined, a component needs no more tests
        for k in at[np.argsort(-near, kind="stable")][: int((near >= LEAST_AGREEMENT).sum())].tolist():
            a, b = find(comp[i]), find(comp[k])
            if a != b and similar(sets(i), sets(k), percent):
                up[a] = b
                out.append((max(node[i], node[k]), min(node[i], node[k])))
    return out


def _blocks(percent: int):
    """Rows sorted by (bucket, bi, bj); a block's rows may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept, out = groups(table if kept is None else pa.concat_tables([kept, table]), last=False)
            yield told(out)
        if kept is not None:
            yield told(groups(kept, last=True)[1])

    def told(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    def groups(table: pa.Table, last: bool) -> tuple[pa.Table, list[tuple[int, int]]]:
        if not table.num_rows:
            return table, []
        col = lambda c: table.column(c).to_numpy()
        key, bi, bj = col("bucket"), col("bi"), col("bj")
        ends = (np.flatnonzero((key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1).tolist() + ([len(key)] if last else [])
        begin, out = 0, []
        for end in ends:
            if end - begin > 1:
                part = table.slice(begin, end - begin)
                node, comp = part.column("node").to_pylist(), part.column("comp").to_pylist()
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(len(node), -1)
                role = part.column("role").to_numpy()
                elements = part.column("elements")
                sets = lambda i, e=elements: np.frombuffer(e[i].as_py(), "<u8")
                one_block = bi[begin] == bj[begin]
                outer = np.flatnonzero(role == 0)
                inner = outer if one_block else np.flatnonzero(role == 1)
                out += block_links(node, comp, part.column("n").to_numpy(), outer, inner, sig, sets, percent)
            begin = end
        return table.slice(begin), out

    return run


def _sets_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, elements) of the wanted nodes, made again from the one text that stands for each."""
    named = cut(nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "th"), "named")
    some = sieved(texts, "th", named, "th")
    found = some.join(named, some.doc_id.eqNullSafe(named.doc_id) & (some.th == named.th)).select("node", "text").dropDuplicates(["node"])
    return cut(found.mapInArrow(_setter(width), "node long, elements binary"), "sets")


def _open_blocks(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, bi, bj, role, node, comp of the buckets that hold several components.

    The rows outside a bucket's largest component are dealt in blocks 0..m-1,
    those inside in blocks m..m+g-1. Blocks (i, j), i <= j, with i < m meet:
    rows of i have role 0 and those of j role 1.
    """
    placed = shared.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp"))
    held = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    sizes = held.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("big"), F.sum("c").alias("members"), F.count("*").alias("comps")).where("comps > 1")
    rows = placed.join(sizes.select("bucket", F.col("big.comp").alias("largest"), F.col("big.c").alias("g"), (F.col("members") - F.col("big.c")).alias("m")), "bucket")
    nm, ng = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil(F.col("g") / BLOCK).cast("int")
    inside = F.col("comp") == F.col("largest")
    own = F.when(inside, F.col("nm") + F.pmod(F.xxhash64("node"), F.col("ng")).cast("int")).otherwise(F.pmod(F.xxhash64("node"), F.col("nm")).cast("int"))
    rows = rows.withColumn("nm", nm).withColumn("ng", ng).withColumn("own", own)
    others = F.when(inside, F.sequence(F.lit(0), F.col("nm") - 1)).otherwise(F.sequence(F.lit(0), F.col("nm") + F.col("ng") - 1))
    met = rows.withColumn("other", F.explode(others))
    return met.select("bucket", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("role"), "node", "comp")


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, th (hash of the text)."""
    require(docs, "doc_id", "text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    table = cut(texts.mapInArrow(_signer(width), _SIGNED), "signed")
    full = table.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "n", "sig", "bands")).alias("r")
    nodes = cut(full.groupBy("k1", "k2").agg(first).select("k1", "k2", "r.doc_id", "r.th", "r.n", "r.sig", "r.bands").withColumn("node", F.monotonically_increasing_id()), "nodes")

    banded = nodes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    ends = banded.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    wanted = cut(ends.select("bucket"), "buckets")
    shared = cut(sieved(banded, "bucket", wanted, "bucket").join(wanted, "bucket").select("bucket", "node"), "shared")
    fame = shared.groupBy("node").agg(F.count("*").alias("fame"))
    hubs = shared.join(fame, "node").groupBy("bucket").agg(F.max_by("node", F.struct("fame", -F.col("node"))).alias("hub"))
    spokes = shared.join(hubs, "bucket").where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    slim = nodes.select("node", "n", "sig")
    sided = spokes.join(slim.toDF("a", "na", "sa"), "a").join(slim.toDF("b", "nb", "sb"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    links = cut(sided.where(agreement("sa", "sb") >= LEAST_AGREEMENT).select("a", "b"), "links")
    # sets of all classes that share a bucket serve both passes
    sets = _sets_of(shared.select("node").distinct(), nodes, texts, width)
    both = links.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    found = cut(both.mapInArrow(_pairs(percent), "a long, b long"), "kept")
    roots = cut(components(found), "roots")
    met = _open_blocks(shared, roots).join(slim, "node").join(sets, "node").select("bucket", "bi", "bj", "role", "node", "comp", "n", "sig", "elements")
    more = cut(met.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "role", "node").mapInArrow(_blocks(percent), "a long, b long"), "more")
    if not more.isEmpty():
        before, roots = roots, cut(components(found.union(more)), "roots")
        drop(before)
    drop(wanted, shared, links, sets, found, more)
    placed = nodes.join(roots, "node", "left").select("k1", "k2", "doc_id", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked"))
    # a class without a link is its own component; only the others meet by root
    least = placed.where("linked").groupBy("root").agg(F.min("doc_id").alias("least_id"))
    of_class = placed.join(least, "root", "left").select("k1", "k2", F.when(F.col("linked"), F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))
    joined = full.join(of_class, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "th")
    alone = table.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "th")
    return joined.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "th")


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, as they came: one of each group, the one with the least doc_id (one of repeated rows)."""
    require(docs, "doc_id", "text")
    ident = F.xxhash64("doc_id", F.col("doc_id").isNull())
    stay = classes(docs, width, percent).where("kept").select(ident.alias("__id"), F.col("th").alias("__th")).distinct()
    packed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("__row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull()).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th"))
    rows = packed.join(stay, ["__id", "__th"], "left_semi")
    # rows of one doc_id and text lie together after the join: numbering them moves nothing
    once = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__th").orderBy("__id"))).where("__n = 1")
    return once.select("__row.*")
