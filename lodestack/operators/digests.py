"""A tree of digests over the tables of a generation: file, table, generation.

A file's digest is that of its bytes, a table's that of its files in order of
their names, the generation's that of its tables. The tree is stored with each
file's length and time, so

* ``at_start`` compares names, lengths and times with the tree and the tree with
  itself: no byte of data is read;
* ``after_update`` reads the files that are new or whose length or time has
  changed, and takes all others from the tree;
* ``full`` reads everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEAVES = "table string, file string, length long, at timestamp, sha256 string"



def _listed(spark: SparkSession, root: str, content: bool) -> DataFrame:
    """(table, file, length, at[, sha256]) of the data files of a generation, each table a folder or file below ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    name = root.rstrip("/").rsplit("/", 1)[-1]
    told = found.select(F.substring_index("path", f"/{name}/", -1).alias("file"), "length", F.col("modificationTime").alias("at"), *([F.sha2("content", 256).alias("sha256")] if content else []))
    return told.select(F.substring_index("file", "/", 1).alias("table"), *told.columns)


def tables_of(leaves: DataFrame) -> DataFrame:
    """(table, files, bytes, digest): a table's digest is that of its files' names and digests in order."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("file", "sha256"))), lambda x: F.concat_ws(":", x["file"], x["sha256"]))
    return leaves.groupBy("table").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(told, "\n"), 256).alias("digest"))


def root_of(tables: DataFrame) -> DataFrame:
    """(tables, files, bytes, digest) of the generation: one row, made of one row a table."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("table", "digest"))), lambda x: F.concat_ws(":", x["table"], x["digest"]))
    return tables.agg(F.count("*").alias("tables"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(told, "\n"), 256).alias("digest"))


@dataclass(frozen=True)
class Verified:
    digest: str
    files: int
    files_read: int
    bytes_read: int
    faults: tuple[tuple[str, str], ...]


class DigestTree:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.leaves = spark.read.schema(_LEAVES).parquet(f"{path}/leaves")
        self.told = spark.read.parquet(f"{path}/root").first().digest

    @classmethod
    def build(cls, spark: SparkSession, root: str, path: str) -> DigestTree:
        """Reads every file of ``root`` once, in as many tasks as there are files."""
        _listed(spark, root, True).write.parquet(f"{path}/leaves")
        root_of(tables_of(spark.read.schema(_LEAVES).parquet(f"{path}/leaves"))).write.parquet(f"{path}/root")
        return cls(spark, path)

    def tables(self) -> DataFrame:
        return tables_of(self.leaves)

    def _compared(self, root: str) -> DataFrame:
        now = _listed(self.spark, root, False).select("file", F.struct("length", "at").alias("now"))
        both = self.leaves.select("file", F.struct("length", "at", "sha256").alias("told")).join(now, "file", "full_outer")
        state = F.when(F.col("told").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("told.length") != F.col("now.length"), "length").when(F.col("told.at") != F.col("now.at"), "time").otherwise("same")
        return both.select("file", "told", "now", state.alias("state"))

    def _own_faults(self) -> list[tuple[str, str]]:
        return [] if root_of(self.tables()).first().digest == self.told else [("", "the tree contradicts its root")]

    def at_start(self, root: str) -> Verified:
        """Without reading data: the listing against the tree, the tree against its root."""
        seen = self._compared(root)
        bad = [(r.file, r.state) for r in seen.where("state <> 'same'").select("file", "state").orderBy("file").limit(100).collect()]
        return Verified(self.told, seen.count(), 0, 0, tuple(self._own_faults() + bad))

    def after_update(self, root: str, path: str) -> tuple[DigestTree, Verified]:
        """The tree of ``root`` as it is now, at ``path``: of unchanged files nothing but name, length and time is read."""
        seen = self._compared(root)
        changed = [r.file for r in seen.where("state in ('new', 'length', 'time')").select("file").collect()]
        kept = seen.where("state = 'same'").select(F.substring_index("file", "/", 1).alias("table"), "file", "now.length", "now.at", "told.sha256")
        fresh = None
        if changed:
            # by their paths: other files aren't opened
            read = self.spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{f}" for f in changed])
            name = root.rstrip("/").rsplit("/", 1)[-1]
            fresh = read.select(F.substring_index("path", f"/{name}/", -1).alias("file"), "length", F.col("modificationTime").alias("at"), F.sha2("content", 256).alias("sha256"))
            fresh = fresh.select(F.substring_index("file", "/", 1).alias("table"), "file", "length", "at", "sha256")
        leaves = kept.unionByName(fresh) if fresh is not None else kept
        leaves.write.parquet(f"{path}/leaves")
        tree_leaves = self.spark.read.schema(_LEAVES).parquet(f"{path}/leaves")
        root_of(tables_of(tree_leaves)).write.parquet(f"{path}/root")
        tree = DigestTree(self.spark, path)
        read_bytes = tree_leaves.where(F.col("file").isin(changed)).agg(F.sum("length")).first()[0] if changed else 0
        return tree, Verified(tree.told, tree_leaves.count(), len(changed), read_bytes or 0, ())

    def full(self, root: str) -> Verified:
        """Every file read and held against the tree."""
        now = _listed(self.spark, root, True).select("file", "length", F.col("sha256").alias("now"))
        both = self.leaves.select("file", "sha256").join(now, "file", "full_outer")
        fault = F.when(F.col("sha256").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("sha256") != F.col("now"), "content")
        seen = both.agg(F.count("now").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
        bad = [(r.file, r.fault) for r in both.select("file", fault.alias("fault")).where("fault is not null").orderBy("file").limit(100).collect()]
        return Verified(self.told, seen.n, seen.n, seen.bytes, tuple(self._own_faults() + bad))
