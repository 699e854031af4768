"""Command line: ``python -m lodestack VERB ROOT ...``; each verb prints JSON lines.

ROOT is a folder of generations (see :mod:`lodestack.plans.generation`). Rows
that are printed are bounded by the verb: a top-k, one row a source or a count.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import incremental, retrieval
from lodestack.operators.search import Engine, SearchOptions
from lodestack.plans.generation import Store
from lodestack.session import session

TABLES = ("sources", "documents", "chunks", "chunk_embeddings", "definitions", "citations")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestack")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *names: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for n in ("root", *names):
            v.add_argument(n)
        return v

    verb("build", "tables").add_argument("--model", default="")
    verb("verify").add_argument("--generation")
    verb("stats").add_argument("--generation")
    search = verb("search", "query")
    search.add_argument("--source", required=True)
    search.add_argument("--generation")
    search.add_argument("-k", type=int, default=SearchOptions.k)
    search.add_argument("--sort-by", default="relevance")
    search.add_argument("--type", action="append", default=[])
    define = verb("get-definition", "term")
    define.add_argument("--generation")
    verb("activate", "generation")
    verb("deactivate", "generation")
    verb("rollback")
    verb("prune-generations").add_argument("--keep", type=int, default=2)
    for name in ("snapshot-reduce", "scrape-diff"):
        verb(name, "new").add_argument("--key", default="canonical_id")
    return p


def _told(df: DataFrame) -> list[dict]:
    return [json.loads(x.value) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).collect()]


def run(spark: SparkSession, argv: list[str]) -> list[dict]:
    """The lines that a command prints."""
    a = parser().parse_args(argv)
    if a.verb == "snapshot-reduce":
        old, new = (spark.read.parquet(x) for x in (a.root, a.new))
        return _told(incremental.reconcile(old, new, a.key, "content_hash").groupBy("action").agg(F.count("*").alias("n")).orderBy("action"))
    if a.verb == "scrape-diff":
        feed, done = spark.read.parquet(a.new), spark.read.parquet(a.root)
        return [{"open": incremental.feed_diff(feed, done, a.key, "status", ("done", "gone")).count()}]
    store = Store(spark, a.root)
    if a.verb == "build":
        tables = {n: spark.read.parquet(f"{a.tables}/{n}.parquet") for n in TABLES if _there(spark, f"{a.tables}/{n}.parquet")}
        return [{"generation": store.build(tables, a.model)}]
    if a.verb == "activate":
        store.activate(a.generation)
        return [{"active": a.generation}]
    if a.verb == "deactivate":
        return [{"deactivated": store.deactivate(a.generation)}]
    if a.verb == "rollback":
        return [{"active": store.rollback()}]
    if a.verb == "prune-generations":
        return [{"removed": x} for x in store.prune(a.keep)]
    ident = a.generation or store.active()
    if not ident:
        raise ValueError("no generation is active")
    if a.verb == "verify":
        faults = store.verify(ident)
        return [{"generation": ident, "ok": not faults, "faults": faults}]
    names = set(store.manifest(ident).tables)

    def of(name: str) -> DataFrame:
        if name not in names:
            raise ValueError(f"this generation has no {name}")
        return store.table(ident, name)

    if a.verb == "stats":
        definitions = of("definitions") if "definitions" in names else of("documents").select("source_id").limit(0)
        vectors = of("chunk_embeddings") if "chunk_embeddings" in names else of("chunks").select("chunk_id").limit(0)
        return _told(retrieval.stats(of("documents"), of("chunks"), definitions, vectors).orderBy("source_id"))
    if a.verb == "search":
        engine = Engine.build(of("documents"), of("chunks"))
        return _told(engine.search(a.query, SearchOptions(a.source, a.k, "keyword", tuple(a.type), sort_by=a.sort_by)))
    return _told(retrieval.get_definition(of("definitions"), of("documents"), a.term))


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def main(argv: list[str] | None = None) -> int:
    spark = session()
    try:
        for line in run(spark, sys.argv[1:] if argv is None else argv):
            print(json.dumps(line, sort_keys=True))
    except ValueError as e:
        print(json.dumps({"error": str(e)}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
