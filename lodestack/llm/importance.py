"""Importance resampling towards a target distribution (hashed n-gram features), in Spark SQL.

1. Each text's words become n-grams, each n-gram a bucket (crc32 modulo
   ``buckets``). The bucket lists are written once; nothing reads texts again.
2. Exploded lists are counted by bucket, for the corpus and for the target:
   at most ``buckets`` rows each. A bucket's gain is the floored thousandfold
   log ratio of its smoothed shares.
3. The gain table, of at most ``buckets`` rows, is broadcast to the exploded
   lists, and gains are summed by document. All of a document's features are
   in one task, so what is shuffled is a row a document.
4. Scores are weights plus Gumbel noise seeded by doc_id, so the highest
   scores are a draw without replacement in proportion to exp(weight / 1000).
   Rows are sorted by range over all tasks and written with their place in
   their partition; a row's rank is that place plus the rows of the
   partitions before, a table with a row a partition.

Nulls and empty texts have no feature: weight 0, never drawn (unless
``min_words`` is 0). A null doc_id is hashed as an empty one and sorts last
among ties. Repeated rows are told apart by nothing and each get a row; they
share score and weight and take ranks next to each other. Very long texts are
one row's array of integers. With an empty target every gain is that of an
unseen feature; an empty corpus gives an empty result. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import cut, require

#: A word once A-Z are lower-cased: digits, a-z and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: monotonically_increasing_id() has the partition above this many bits and the place in it below.
PLACE_BITS = 33


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def _run_from(words: Column, k: int) -> Callable[[Column], Column]:
    return lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])


def _runs(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words, joined by a space."""
    found = words
    for k in range(2, longest + 1):
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
        # single items, for slice() would copy all words for each run
        found = F.concat(found, F.transform(starts, _run_from(words, k)))
    return found


def _bucketed(df: DataFrame, text: str, longest: int, buckets: int, *keys: Column) -> DataFrame:
    """``keys``, the number of words, and the bucket of every feature."""
    words = df.select(*keys, terms(F.col(text)).alias("__words"))
    codes = F.transform(_runs(F.col("__words"), longest), lambda g: F.pmod(F.crc32(g.cast("binary")), F.lit(buckets)).cast("int"))
    return words.select(*words.columns[:-1], F.size("__words").alias("words"), codes.alias("codes"))


def _counts(bucketed: DataFrame, name: str) -> DataFrame:
    return bucketed.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(code, gain) of each bucket that the corpus or the target has: ``buckets`` rows at most."""
    both = _counts(corpus, "s").join(_counts(target, "t"), "code", "full").na.fill(0, ["s", "t"])
    whole = Window.partitionBy()  # over at most `buckets` rows
    share = both.select("code", *[F.col(c).cast("double").alias(c) for c in "st"], *[F.sum(c).over(whole).cast("double").alias(f"all_{c}") for c in "st"])
    ratio = ((F.col("t") + 1) * (F.col("all_s") + float(buckets))) / ((F.col("s") + 1) * (F.col("all_t") + float(buckets)))
    return share.select("code", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from 32 bits of a hash of seed and doc_id."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``docs``."""
    require(docs, doc_id, text)
    require(target, text)
    # two chained hashes stand for the text: equal texts of one id have equal features, so they are summed together and dealt out again
    key = [F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")]
    corpus = cut(_bucketed(docs, text, longest, buckets, *key), "features")
    gain = F.broadcast(cut(gains(corpus, _bucketed(target, text, longest, buckets), buckets), "gains"))

    each = corpus.select("doc_id", "a", "b", "words", F.posexplode_outer("codes").alias("place", "code")).join(gain, "code", "left")
    summed = each.groupBy("doc_id", "a", "b").agg(
        F.max("words").alias("words"), F.count("code").alias("features"), F.sum("gain").alias("gain"), F.count_if(F.coalesce(F.col("place"), F.lit(0)) == 0).alias("copies")
    )
    one = summed.select("doc_id", "a", "b", "words", F.expr("features div copies").alias("n"), F.expr("gain div copies").alias("gain"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    weight = F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) div n")).otherwise(F.lit(0)).cast("long")
    scored = one.select("doc_id", "a", "b", F.col("n").cast("long").alias("n_features"), weight.alias("weight"), (F.col("words") >= min_words).alias("fit"))
    scored = scored.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))

    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("a"), F.asc("b")]
    ranked = cut(scored.orderBy(*order).select("doc_id", "n_features", "weight", "score", "fit", F.monotonically_increasing_id().alias("mid")), "ranked")
    part = F.shiftright("mid", PLACE_BITS)
    sizes = ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("fit").alias("fits"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("fits").over(Window.partitionBy()).alias("fits"))
    placed = ranked.withColumn("part", part).join(F.broadcast(offsets), "part")
    rank = F.col("offset") + F.col("mid").bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")) + 1
    drawn = F.col("fit") & (rank <= F.expr(f"({percent} * fits) div 100"))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, rank).cast("long").alias("rank"))
