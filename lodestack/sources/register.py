"""The store of a legislation register: a committed state, an inventory, and documents filed by their digests.

* ``state``: one JSON row (schema_version, records), written last;
* ``inventory``: JSON lines (native_id, payload_hash, canonical_url);
* ``documents/prefix=XX``: JSON lines, filed by the first two digits of their hash.

A document belongs to an inventory row if all that both tell agrees; otherwise
it is told with its fault. Links to other documents of the register are turned
into references to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.stored import StoredError, there
from lodestack.sources import acquire, normalise

VERSION = 3
_STATE = "schema_version int, records long"
_INVENTORY = "native_id string, payload_hash string, canonical_url string"
_DOCUMENT = "source string, native_id string, content_hash string, canonical_url string, title string, html string"
#: What a document's hash is made of, in this order.
HASHED = ("native_id", "canonical_url", "title", "html")


def write(documents: DataFrame, source: str, path: str) -> None:
    """A store of ``documents`` (native_id, canonical_url, title, html); ``path`` must not exist."""
    spark = documents.sparkSession
    made = documents.select(F.lit(source).alias("source"), "native_id", "canonical_url", "title", "html", acquire.content_hash(*[F.col(c) for c in HASHED]).alias("content_hash"))
    made.withColumn("prefix", F.substring("content_hash", 1, 2)).repartition("prefix").write.partitionBy("prefix").json(f"{path}/documents")
    inventory = made.select("native_id", F.col("content_hash").alias("payload_hash"), "canonical_url")
    inventory.write.json(f"{path}/inventory")
    spark.createDataFrame([(VERSION, spark.read.schema(_INVENTORY).json(f"{path}/inventory").count())], _STATE).coalesce(1).write.json(f"{path}/state")


def read(spark: SparkSession, path: str, source: str) -> DataFrame:
    """native_id, canonical_url, title, html and fault (null: sound) of every inventory row.

    A store without a committed state, of another version, empty or with
    another number of rows than its state tells is an error.
    """
    if not there(spark, f"{path}/state/_SUCCESS"):
        raise StoredError(f"{path} has no committed state")
    state = spark.read.schema(_STATE).json(f"{path}/state").first()
    inventory = spark.read.schema(_INVENTORY).json(f"{path}/inventory")
    n = inventory.count()
    if state.schema_version != VERSION or not n or n != state.records:
        raise StoredError(f"{path}: version {state.schema_version}, {n} of {state.records} records")
    held = spark.read.schema(f"{_DOCUMENT}, prefix string").json(f"{path}/documents")
    again = acquire.content_hash(*[F.col(f"d.{c}") for c in HASHED])
    both = inventory.join(held.select(F.col("content_hash").alias("payload_hash"), F.struct("*").alias("d")), "payload_hash", "left")
    fault = (
        F.when(F.col("d").isNull(), "document is missing")
        .when(F.col("d.source") != source, "document of another source")
        .when((F.col("d.native_id") != F.col("native_id")) | (F.col("d.canonical_url") != F.col("canonical_url")), "document does not match its inventory row")
        .when(F.col("d.prefix") != F.substring("payload_hash", 1, 2), "document is filed elsewhere")
        .when(again != F.col("payload_hash"), "document differs from its hash")
    )
    told = both.select("native_id", "canonical_url", F.col("d.title").alias("title"), F.col("d.html").alias("html"), fault.alias("fault"))
    addresses = inventory.select(F.col("canonical_url").alias("url"), F.col("native_id").alias("target")).distinct()
    linked = normalise.with_internal_links(told.where("fault is null").select("native_id", "html"), addresses, "native_id")
    return told.drop("html").join(linked.withColumnRenamed("native_id", "__id"), F.col("native_id") == F.col("__id"), "left").drop("__id")
