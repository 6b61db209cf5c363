"""An inverted index in segments with tombstones: a change writes what changed, lookups equal a whole build.

Every change has a number. It writes one segment with the postings of new and changed documents, and tombstones for what
they replace and for what is deleted: a row of segment s is alive unless its document has a tombstone of a later number.
Totals (documents, lengths of fields) are kept in the manifest of each version, and document frequencies are counted from
the live postings that a lookup reads, so no statistic of unchanged terms is ever rewritten. When as many segments of one
size class have come together as the fan-out says, they are merged into one of the next class, so a document is rewritten
a logarithmic number of times and a lookup reads a logarithmic number of segments.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import index
from tessella.scratch import keep, place


#: Tombstones up to this number travel to the rows that they may bury.
CARRIED = 1_000_000


class Conflict(RuntimeError):
    """Another writer has taken the next version."""


class SegmentedIndex:
    """Segments, tombstones and manifests below `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, key: str, fields: Mapping[str, Column], tokenize=None, fanout: int = 8):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.root, self.key, self.fields, self.tokenize, self.fanout = spark, root.rstrip("/"), key, dict(fields), tokenize, fanout

    # Versions -----------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        where, files = place(self.spark, f"{self.root}/versions")
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict:
        """That of a version, or of the newest; an index without any is empty."""
        known = self.versions()
        if not known or version == 0:
            return {"version": 0, "segments": [], "tombstones": [], "documents": 0, "lengths": dict.fromkeys(self.fields, 0)}
        version = version or known[-1]
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:09d}.json", wholetext=True).first()[0])

    def _claim(self, version: int) -> None:
        """Only one writer gets a version: its claim is created where none exists, in one step of the file system."""
        where, files = place(self.spark, f"{self.root}/claims/{version:09d}")
        try:
            files.create(where, False).close()
        except Exception as e:
            raise Conflict(f"version {version} has been taken by another writer; release() drops claims that never ended") from e

    def release(self) -> None:
        """Drop claims of versions that were never written, left by writers that died."""
        where, files = place(self.spark, f"{self.root}/claims")
        newest = max(self.versions(), default=0)
        for s in files.listStatus(where) if files.exists(where) else []:
            if int(s.getPath().getName()) > newest:
                files.delete(s.getPath(), False)

    def _publish(self, manifest: dict) -> dict:
        """Written beside, then renamed: readers see whole manifests only."""
        final, files = place(self.spark, f"{self.root}/versions/{manifest['version']:09d}.json")
        part, _ = place(self.spark, f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = files.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not files.rename(part, final):
            raise Conflict(f"version {manifest['version']} exists")
        return manifest

    # Reading ------------------------------------------------------------------------------------------------------

    def _read(self, name: str, parts: list[dict], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{p['id']}" for p in parts])

    def _key_kind(self, manifest: dict) -> str:
        return manifest.get("key", "string")

    def _alive(self, rows: DataFrame, manifest: dict) -> DataFrame:
        """Rows without a later tombstone."""
        if not manifest["tombstones"]:
            return rows
        dead = self._read("tombstones", manifest["tombstones"], f"`{self.key}` {self._key_kind(manifest)}, dead long")
        dead = dead.groupBy(F.col(self.key).alias("_dead")).agg(F.max("dead").alias("_at"))
        if sum(t["documents"] for t in manifest["tombstones"]) <= CARRIED:
            dead = F.broadcast(dead)
        return rows.join(dead, (rows[self.key] == F.col("_dead")) & (F.col("seq") < F.col("_at")), "left_anti")

    def _rows(self, name: str, manifest: dict, segments: list[dict] | None = None) -> DataFrame:
        kind = self._key_kind(manifest)
        schema = {"postings": f"term string, `{self.key}` {kind}, field string, len long, tf long, first boolean, seq long", "documents": f"`{self.key}` {kind}, field string, len long, seq long"}[name]
        return self._alive(self._read(name, manifest["segments"] if segments is None else segments, schema), manifest)

    def documents(self, version: int | None = None) -> DataFrame:
        """(key, field, len) of all live documents."""
        return self._rows("documents", self.manifest(version)).drop("seq")

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """postings, terms and fields as of index.build(). A filter on the term reaches the scans of all of them: terms
        are counted from the postings, and grouping is by term. All live rows of a document are of one segment, so its first
        field that holds a term is known there; segments of before this was noted have their documents told apart."""
        manifest = self.manifest(version)
        postings = self._rows("postings", manifest).drop("seq")
        n = manifest["documents"]
        lengths = [(f, n, manifest["lengths"][f] / n if n else 0.0) for f in self.fields]
        fields = self.spark.createDataFrame(lengths, "field string, n long, avg_len double")
        noted = all(s.get("first") for s in manifest["segments"])
        df = index.document_frequencies(postings) if noted else postings.groupBy("term").agg(F.count_distinct(self.key).alias("df"))
        return {"postings": postings, "terms": df.select("term", "df", index.idf(F.lit(n), F.col("df")).alias("idf")), "fields": fields}

    # Writing ------------------------------------------------------------------------------------------------------

    def apply(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> dict:
        """Add or replace documents (key and the columns of the fields), delete others (key); the new version's manifest.

        A key that is both changed and deleted is changed. Null keys are left out; of rows that share a key one is taken,
        the first by its fields' texts. `changed` is read more than once, so it must give the same rows each time. Deleting what is not there does nothing. The version appears in one step; a
        writer that dies before leaves files that no version names."""
        base = self.manifest()
        seq = base["version"] + 1
        self._claim(seq)
        out = dict(base) | {"version": seq, "segments": list(base["segments"]), "tombstones": list(base["tombstones"]), "lengths": dict(base["lengths"])}
        for df in (changed, deleted):
            if df is not None:
                out["key"] = base.get("key") or df.schema[self.key].dataType.simpleString()
        ids, added = None, None
        if changed is not None:
            added = self._write_segment(changed, out, seq)
            ids = added.select(self.key).distinct()
        if deleted is not None:
            gone = deleted.select(self.key).where(F.col(self.key).isNotNull()).distinct()
            ids = gone if ids is None else ids.unionByName(gone).distinct()
        if ids is not None and base["segments"]:
            self._bury(ids, base, out, seq)
        return self._publish(self._merged(out))

    def _write_segment(self, changed: DataFrame, out: dict, seq: int) -> DataFrame:
        rows = changed.where(F.col(self.key).isNotNull()).select(self.key, *[c.cast("string").alias(f"_f{i}") for i, c in enumerate(self.fields.values())])
        texts = {f: F.col(f"_f{i}") for i, f in enumerate(self.fields)}
        twice = keep(rows.groupBy(self.key).count().where("count > 1").select(self.key), "twice")
        if not twice.isEmpty():  # only texts that share their key are shuffled
            one = rows.join(twice, self.key, "left_semi").groupBy(self.key).agg(F.min(F.struct(*texts.values())).alias("_r")).select(self.key, "_r.*")
            rows = rows.join(twice, self.key, "left_anti").unionByName(one)
        name, number = uuid.uuid4().hex, F.lit(seq).cast("long").alias("seq")
        index.by_term(index.counted(rows, self.key, texts, self.tokenize)).select("*", number).write.parquet(f"{self.root}/postings/{name}")
        found = self._read("postings", [{"id": name}], f"`{self.key}` {rows.schema[self.key].dataType.simpleString()}, field string, len long")
        held = found.groupBy(self.key, "field").agg(F.max("len").alias("len"))
        every = rows.select(self.key, F.explode(F.array(*map(F.lit, self.fields))).alias("field"))
        lengths = every.join(held, [self.key, "field"], "left").select(self.key, "field", F.coalesce("len", F.lit(0)).alias("len"), number)
        lengths.sortWithinPartitions(self.key).write.parquet(f"{self.root}/documents/{name}")
        added = self.spark.read.parquet(f"{self.root}/documents/{name}")
        sums = {r["field"]: r for r in added.groupBy("field").agg(F.sum("len").alias("len"), F.count(F.lit(1)).alias("n")).collect()}  # a row per field
        n = max((r["n"] for r in sums.values()), default=0)
        if n:
            out["segments"].append({"id": name, "seq": seq, "documents": n, "first": True})
        out["documents"] += n
        for f, r in sums.items():
            out["lengths"][f] += r["len"]
        return added

    def _bury(self, ids: DataFrame, base: dict, out: dict, seq: int) -> None:
        """Tombstones for those of the ids that are alive, and their share of the totals."""
        old = keep(self._rows("documents", base).join(ids, self.key, "left_semi"), "buried")
        sums = {r["field"]: r for r in old.groupBy("field").agg(F.sum("len").alias("len"), F.count(F.lit(1)).alias("n")).collect()}
        if not sums:
            return
        name = uuid.uuid4().hex
        dead = old.select(self.key).distinct().withColumn("dead", F.lit(seq).cast("long"))
        dead.repartitionByRange(self.key).write.parquet(f"{self.root}/tombstones/{name}")
        n = max(r["n"] for r in sums.values())
        out["tombstones"].append({"id": name, "seq": seq, "documents": n})
        out["documents"] -= n
        for f, r in sums.items():
            out["lengths"][f] -= r["len"]

    def _class(self, segment: dict) -> int:
        size, n = 0, segment["documents"]
        while n >= self.fanout:
            size, n = size + 1, n // self.fanout
        return size

    def _merged(self, out: dict) -> dict:
        """Merge segments of a class while there are as many as the fan-out; tombstones that are older than every segment
        left go. Classes hold live and dead documents alike, so a merge also takes the dead ones out."""
        while True:
            classes: dict[int, list[dict]] = {}
            for s in out["segments"]:
                classes.setdefault(self._class(s), []).append(s)
            full = next((c for _, c in sorted(classes.items()) if len(c) >= self.fanout), None)
            if full is None:
                break
            self._merge(full, out)
        oldest = min((s["seq"] for s in out["segments"]), default=out["version"])
        out["tombstones"] = [t for t in out["tombstones"] if t["seq"] > oldest] if out["segments"] else []
        return out

    def _merge(self, some: list[dict], out: dict) -> None:
        """One segment in place of some; it takes the latest of their numbers: what is alive now has no tombstone since its
        own, and those to come have later ones."""
        name, seq = uuid.uuid4().hex, max(s["seq"] for s in some)
        for table, order in (("postings", ["term", self.key]), ("documents", [self.key])):
            rows = self._rows(table, out, some).withColumn("seq", F.lit(seq).cast("long"))
            rows.repartitionByRange(order[0]).sortWithinPartitions(*order).write.parquet(f"{self.root}/{table}/{name}")
        n = self.spark.read.parquet(f"{self.root}/documents/{name}").select(self.key).distinct().count()
        out["segments"] = [s for s in out["segments"] if s not in some] + ([{"id": name, "seq": seq, "documents": n, "first": all(s.get("first") for s in some)}] if n else [])

    def compact(self) -> dict:
        """All segments in one, without tombstones, as a new version."""
        base = self.manifest()
        self._claim(base["version"] + 1)
        out = dict(base) | {"version": base["version"] + 1}
        if out["segments"]:
            self._merge(list(out["segments"]), out)
        return self._publish(out | {"tombstones": []})

    def collect_garbage(self, versions: int = 2) -> list[str]:
        """Delete manifests but for the newest ones, and files that none of these names; not while a writer is at work."""
        known = self.versions()
        stay, live = known[-versions:], set()
        for v in stay:
            m = self.manifest(v)
            live |= {p["id"] for p in m["segments"] + m["tombstones"]}
        gone = []
        for table in ("postings", "documents", "tombstones"):
            where, files = place(self.spark, f"{self.root}/{table}")
            for s in files.listStatus(where) if files.exists(where) else []:
                if stay and s.getPath().getName() not in live:
                    files.delete(s.getPath(), True)
                    gone.append(f"{table}/{s.getPath().getName()}")
        for v in known[:-versions]:
            where, files = place(self.spark, f"{self.root}/versions/{v:09d}.json")
            files.delete(where, False)
        return sorted(gone)

