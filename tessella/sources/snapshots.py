"""Content-addressed snapshots of tables, with an atomic pointer, a previous version and garbage collection.

Paths go through the Hadoop file system, so a snapshot store can lie wherever Spark writes. Tables are written to a
staging folder, checked there, and renamed to the folder of their content's id.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        rows = self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect()
        return rows[0][0].strip() if rows else None

    def _write(self, name: str, text: str) -> None:
        """Write beside and rename over in one step of the file system: readers see the old or the new content."""
        jvm = self.spark.sparkContext._jvm
        part, final = self._path(f"{self.root}/{name}.part-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        qualified = self._fs.makeQualified(final)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(part), qualified, over)

    @staticmethod
    def digest(df: DataFrame) -> tuple[str, int]:
        """An order-free digest of a table and its row count, combined on the executors."""
        row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
        half = lambda at: F.expr(f"bit_xor(conv(substr(h, {at}, 15), 16, 10) :: bigint)")
        got = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), half(1).alias("a"), half(16).alias("b"), half(31).alias("c"), F.sum(F.expr("conv(substr(h, 46, 12), 16, 10) :: decimal(20, 0)")).alias("d")).first()
        return hashlib.sha256(json.dumps([str(x) for x in got]).encode()).hexdigest(), got["n"]

    def publish(self, tables: dict[str, DataFrame], version: str = "1", digests: bool = True) -> str:
        """Write the tables as a new snapshot and point to it; the pointer stays where the content is the current one.
        Every table is computed once: digests are taken from what was written. Returns the snapshot's id.

        Without `digests` contents are not hashed: the id is a new one, and the snapshot can be read without `verify` only."""
        staging = f"{self.root}/snapshots/.staging-{uuid.uuid4().hex}"
        marks = {}
        for name, df in sorted(tables.items()):
            df.write.parquet(f"{staging}/{name}")
            marks[name] = self.digest(self.spark.read.schema(df.schema).parquet(f"{staging}/{name}")) if digests else (uuid.uuid4().hex, None)
        found = hashlib.sha256(json.dumps([version, marks]).encode()).hexdigest()
        folder = self._path(f"{self.root}/snapshots/{found}")
        if self._read("current") == found and self._valid(found) is not None:
            self._fs.delete(self._path(staging), True)
            return found
        if self._fs.exists(folder):  # left by a crash, or damaged: set aside
            self._fs.rename(folder, self._path(f"{self.root}/snapshots/.quarantine-{uuid.uuid4().hex}"))
        self._fs.mkdirs(self._path(staging))
        self._fs.rename(self._path(staging), folder)
        schemas = {name: df.schema.jsonValue() for name, df in tables.items()}
        self._write(f"snapshots/{found}/manifest.json", json.dumps({"id": found, "version": version, "tables": {n: {"digest": d, "rows": k, "schema": schemas[n]} for n, (d, k) in marks.items()}}))
        if (before := self._read("current")) and before != found:
            self._write("previous", before)
        self._write("current", found)
        return found

    def current(self) -> str | None:
        """The id that the pointer names."""
        return self._read("current")

    def manifest(self, found: str | None) -> dict | None:
        manifest = json.loads(self._read(f"snapshots/{found}/manifest.json") or "null") if found else None
        return manifest if manifest and manifest["id"] == found else None

    def _valid(self, found: str | None, verify: bool = True) -> dict[str, DataFrame] | None:
        if (manifest := self.manifest(found)) is None:
            return None
        out = {}
        for name, mark in manifest["tables"].items():
            if not self._fs.exists(self._path(f"{self.root}/snapshots/{found}/{name}/_SUCCESS")):
                return None
            out[name] = self.spark.read.schema(StructType.fromJson(mark["schema"])).parquet(f"{self.root}/snapshots/{found}/{name}")
            if verify and self.digest(out[name]) != (mark["digest"], mark["rows"]):
                return None
        return out

    def read(self, verify: bool = True) -> tuple[str, dict[str, DataFrame]]:
        """(current or previous, tables): the current snapshot if it checks out, else the one before. Without `verify`
        only manifests and completeness are checked, not the contents."""
        for pointer in ("current", "previous"):
            if (tables := self._valid(self._read(pointer), verify)) is not None:
                return pointer, tables
        raise FileNotFoundError(f"no valid snapshot in {self.root}")

    def collect_garbage(self) -> list[str]:
        """Delete snapshots that no pointer names; nothing without a valid current pointer. Returns their ids."""
        live = {self._read("current"), self._read("previous")} - {None}
        if not live:
            return []
        gone = []
        for status in self._fs.listStatus(self._path(f"{self.root}/snapshots")):
            name = status.getPath().getName()
            if status.isDirectory() and name not in live and not name.startswith(".staging"):
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)
