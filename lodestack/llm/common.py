"""Pieces shared by the training-data operators.

Materialisation goes to the folder named by ``spark.checkpoint.dir`` (shared by
driver and executors), never to a machine-local folder on a cluster.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Spark's own setting for removing a job's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A sieve has at most 2**SIEVE words of 64 bits, SIEVE_WORDS of them in a row, whatever it is made from.
SIEVE, SIEVE_WORDS = 20, 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="lodestack-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # a default is no value of the session's: get() with one would tell that the setting isn't there
    before = spark.conf.get(CLEANUP) if spark.conf.isModifiable(CLEANUP) else None
    if before is not None:
        # once the table is written nothing reads the shuffles behind it: their files go with the job, not with some later collection
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestack_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables made by :func:`cut` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_lodestack_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def _place(key: Column) -> tuple[Column, Column, Column]:
    """Row, word in the row and bit of a 64-bit hash in a sieve."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(key, SIEVE).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    word = key.bitwiseAND(F.lit(SIEVE_WORDS - 1).cast("long")).cast("int")
    row = F.shiftright(key.bitwiseAND(F.lit((1 << SIEVE) - 1).cast("long")), SIEVE_WORDS.bit_length() - 1)
    return row, word, bit


def _sieve_of(keys: DataFrame, key: str) -> DataFrame:
    """A row holds many words: what is broadcast, and held by the driver, is hardly more than its bits."""
    row, word, bit = _place(F.col(key))
    words = [F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")) for i in range(SIEVE_WORDS)]
    return F.broadcast(keys.groupBy(row.alias("__row")).agg(F.array(*words).alias("__bits")))


def sieved(df: DataFrame, key: str, keys: DataFrame, of: str) -> DataFrame:
    """Rows of ``df`` whose hash ``key`` may be among ``keys.of``; none that is is lost.

    What is broadcast is a bit set of fixed size, so the bound holds at any
    size of ``keys``: with very many of them it merely lets more rows through,
    and the join that follows decides.
    """
    row, word, bit = _place(F.col(key))
    made = df.withColumn("__row", row).join(_sieve_of(keys, of), "__row")
    return made.where(F.get("__bits", word).bitwiseAND(bit) != 0).drop("__row", "__bits")


def marked(df: DataFrame, key: str, keys: DataFrame, of: str, name: str) -> DataFrame:
    """All rows of ``df`` with a column ``name``: whether :func:`sieved` would let them through."""
    row, word, bit = _place(F.col(key))
    made = df.withColumn("__row", row).join(_sieve_of(keys, of), "__row", "left")
    return made.withColumn(name, F.coalesce(F.get("__bits", word).bitwiseAND(bit) != 0, F.lit(False))).drop("__row", "__bits")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null; JVM only."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP, -1)
    size = F.size(parts)
    edge = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((size > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (size - edge).cast("long")


def words_of(data: bytes) -> list[bytes]:
    """bytes.split() splits on exactly the white space of GAP."""
    return data.split()


def pack_row(df: DataFrame, name: str = "__row") -> DataFrame:
    """All columns in one struct, so that helper columns can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def sf_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def safe_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", text)
