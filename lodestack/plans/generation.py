"""Immutable generations: versioned folders of Parquet tables behind an atomically replaced pointer.

Paths go through Hadoop's file systems, so local folders and object stores work
alike. Only manifests and pointers (a few KB) are read by the driver.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schema
from lodestack.operators.corpus import table_digest
from lodestack.plans.runs import Folder

VERSION = 12
MAX_MANIFEST = 8 << 20
_KEYS = {"version", "sources", "tables", "model", "created_at"}


@dataclass
class Manifest:
    """What a generation holds: sources, and rows and digest of each table."""

    sources: list[str]
    tables: dict[str, dict[str, int]]
    model: str = ""
    created_at: str = ""
    version: int = VERSION
    extra: dict = field(default_factory=dict, repr=False)

    def ident(self) -> str:
        body = {k: v for k, v in asdict(self).items() if k in _KEYS - {"created_at"}}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()

    def dumps(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k in _KEYS}, sort_keys=True, indent=1)

    @classmethod
    def loads(cls, text: str) -> Manifest:
        if len(text.encode()) > MAX_MANIFEST:
            raise ValueError("manifest is too large")
        data = json.loads(text)
        if set(data) - _KEYS or not {"version", "sources", "tables"} <= set(data):
            raise ValueError(f"manifest keys {sorted(data)}")
        if data["version"] != VERSION:
            raise ValueError(f"manifest version {data['version']}")
        return cls(**data)


class Store:
    """Generations under one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _read(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """A reader finds the old text or the new one, never none."""
        Folder(self.spark, self.root).replace(name, text)

    def build(self, tables: dict[str, DataFrame], model: str = "", created_at: str = "") -> str:
        """Writes and checks all tables in a staging folder, then gives it its name; the id is the hash of the manifest."""
        staging = f"staging-{hashlib.sha256(repr(sorted(tables)).encode()).hexdigest()[:12]}"
        self._fs.delete(self._path(staging), True)
        for name, df in tables.items():
            part = ["source_id"] if "source_id" in df.columns else []
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*part).parquet(f"{self.root}/{staging}/{name}")
        manifest = Manifest(sorted(r.source_id for r in tables["sources"].select("source_id").collect()) if "sources" in tables else [], self._described(staging, list(tables)), model, created_at)
        faults = self._faults(staging, manifest)
        if faults:
            raise ValueError("; ".join(faults))
        ident = manifest.ident()
        self._write(f"{staging}/generation.json", manifest.dumps())
        if not self._fs.exists(self._path(ident)) and not self._fs.rename(self._path(staging), self._path(ident)):
            raise OSError("can't publish the generation")
        return ident

    def table(self, ident: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{ident}/{name}")

    def _described(self, folder: str, names: list[str]) -> dict[str, dict[str, int]]:
        out = {}
        for name in sorted(names):
            df = self.table(folder, name)
            # vectors and nested values count by their JSON spelling, bytes by their hexadecimal one
            spelled = [F.to_json(F.struct(c)).alias(c) if t.startswith(("array", "struct", "map")) else F.hex(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
            row = table_digest(df.select(*spelled, F.lit(1).alias("__all")), sorted(df.columns), ["__all"]).first()
            out[name] = {"rows": row.n if row else 0, "digest": row.digest if row else 0}
        return out

    def _faults(self, folder: str, manifest: Manifest) -> list[str]:
        """Broken keys, references and coverage."""
        out = []
        have = {n: self.table(folder, n) for n in manifest.tables}
        for name, keys in schema.KEYS.items():
            if name in have and not schema.duplicate_keys(have[name], keys).isEmpty():
                out.append(f"{name}: repeated keys")
        for child, ck, parent, pk in schema.FOREIGN_KEYS:
            if child in have and parent in have and not schema.orphans(have[child], ck, have[parent], pk).isEmpty():
                out.append(f"{child}: rows without {parent}")
        if "chunks" in have and "chunk_embeddings" in have and manifest.tables["chunks"]["rows"] != manifest.tables["chunk_embeddings"]["rows"]:
            out.append("chunks without embeddings")
        return out

    def manifest(self, ident: str) -> Manifest:
        text = self._read(f"{ident}/generation.json")
        if text is None:
            raise ValueError(f"no generation {ident}")
        return Manifest.loads(text)

    def verify(self, ident: str) -> list[str]:
        """All that is wrong with a generation: its name, its files, its rows."""
        manifest = self.manifest(ident)
        out = [] if manifest.ident() == ident else ["name and manifest differ"]
        there = {s.getPath().getName() for s in self._fs.listStatus(self._path(ident))}
        if there != {*manifest.tables, "generation.json"}:
            return [*out, f"files {sorted(there)}"]
        if self._described(ident, list(manifest.tables)) != manifest.tables:
            out.append("rows or digests differ from the manifest")
        return out + self._faults(ident, manifest)

    def active(self) -> str | None:
        text = self._read("active.json")
        return json.loads(text)["active"] if text else None

    def previous(self) -> str | None:
        text = self._read("active.json")
        return json.loads(text).get("previous") if text else None

    def activate(self, ident: str) -> None:
        faults = self.verify(ident)
        if faults:
            raise ValueError("; ".join(faults))
        self._write("active.json", json.dumps({"active": ident, "previous": self.active()}))

    def deactivate(self, expected: str) -> bool:
        """Clears the pointer only if it names ``expected``."""
        if self.active() != expected:
            return False
        self._fs.delete(self._path("active.json"), False)
        return True

    def rollback(self) -> str:
        before = self.previous()
        if not before:
            raise ValueError("no generation to go back to")
        self.activate(before)
        return before

    def prune(self, keep: int) -> list[str]:
        """Removes inactive generations but the ``keep`` newest; ties by name."""
        active = self.active()
        found = [(s.getModificationTime(), s.getPath().getName()) for s in self._fs.listStatus(self._path("")) if s.isDirectory() and len(s.getPath().getName()) == 64]
        idle = sorted((x for x in found if x[1] != active), key=lambda x: (-x[0], x[1]))
        for _, name in idle[keep:]:
            self._fs.delete(self._path(name), True)
        return [name for _, name in idle[keep:]]
