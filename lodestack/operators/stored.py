"""Files of a stored structure: written once, closed by a manifest, checked when opened, hashed when verified.

The manifest is written last, so a build that broke off is told from a whole
one. Listing and hashing are Spark scans of the folder (any file system that
Spark reads); nothing is opened by a local path.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"
#: Spark's own setting for removing a job's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class StoredError(ValueError):
    """A stored structure that is incomplete, changed or not the one expected."""


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: that of checkpoints, else the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/lodestack-store"


def tidily[T](spark: SparkSession, write: Callable[[], T]) -> T:
    """Runs ``write``; its shuffles' files go with the job, for nothing reads them once the table is written."""
    # a default is no value of the session's: get() with one would tell that the setting isn't there
    if not spark.conf.isModifiable(CLEANUP):
        return write()
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return write()
    finally:
        spark.conf.set(CLEANUP, before)


def scratch(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes ``df`` to the shared folder (in folders ``by`` some columns) and reads it back: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    tidily(spark, lambda: (writer.partitionBy(*by) if by else writer).parquet(path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame, folder: str | None = None) -> None:
    """Removes what :func:`scratch` wrote for ``df``, or one folder of it, which no later plan may read."""
    fs, target = _path(df.sparkSession, df._scratch_path + (f"/{folder}" if folder else ""))
    fs.delete(target, True)


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def there(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def _relative(root: str) -> Column:
    """Path below ``root``, whatever scheme either is written with."""
    bare = root.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    bare = "/" + bare.split("/", 1)[-1] if "://" in root else bare
    return F.substring_index("path", bare + "/", -1)


def files(spark: SparkSession, root: str, hashed: bool = False) -> DataFrame:
    """(file, length[, sha256]) of the data files below ``root``, the manifest's own left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    told = found.select(_relative(root).alias("file"), "length", *([F.sha2("content", 256).alias("sha256")] if hashed else []))
    return told.where(~F.col("file").startswith(f"{MANIFEST}/"))


def close(spark: SparkSession, root: str, header: dict[str, object]) -> None:
    """Writes the manifest: every file with its digest, and the header as one row of strings."""
    # files are hashed where they are read; only their digests meet in one task
    files(spark, root, hashed=True).repartition(1).write.mode("errorifexists").parquet(f"{root}/{MANIFEST}/files")
    spark.createDataFrame([(k, str(v)) for k, v in header.items()], "key string, value string").coalesce(1).write.mode("errorifexists").parquet(f"{root}/{MANIFEST}/header")


def exists(spark: SparkSession, root: str) -> bool:
    return there(spark, f"{root}/{MANIFEST}/header/_SUCCESS")


def header(spark: SparkSession, root: str) -> dict[str, str]:
    if not exists(spark, root):
        raise StoredError(f"{root} has no manifest: not built, or broken off")
    return {r.key: r.value for r in spark.read.schema("key string, value string").parquet(f"{root}/{MANIFEST}/header").collect()}


def faults(spark: SparkSession, root: str, hashed: bool = False) -> DataFrame:
    """(file, fault): files that are missing, unknown, of another length or, if ``hashed``, of other content."""
    told = spark.read.parquet(f"{root}/{MANIFEST}/files").select("file", F.struct("length", "sha256").alias("told"))
    held = files(spark, root, hashed)
    both = told.join(held.select("file", F.struct(*[c for c in held.columns if c != "file"]).alias("held")), "file", "full_outer")
    fault = F.when(F.col("held").isNull(), "missing").when(F.col("told").isNull(), "unknown").when(F.col("told.length") != F.col("held.length"), "length")
    if hashed:
        fault = fault.when(F.col("told.sha256") != F.col("held.sha256"), "content")
    return both.select("file", fault.alias("fault")).where("fault is not null")


def require_whole(spark: SparkSession, root: str, hashed: bool = False) -> None:
    bad = faults(spark, root, hashed).orderBy("file").limit(5).collect()
    if bad:
        raise StoredError(f"{root}: " + ", ".join(f"{r.file} ({r.fault})" for r in bad))
