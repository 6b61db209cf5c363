"""Resumable builds of embeddings: batches are committed as they are made, a restart asks only for the rest."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.classify import status_category
from tessella.scratch import keep, place

#: Texts of a request, tries of a request, and the first wait in seconds (doubled after each try).
BATCH, TRIES, WAIT = 32, 3, 0.2
#: Answers of a provider that are worth another try.
AGAIN = (429, 500, 502, 503, 504)


class ProviderError(RuntimeError):
    """An answer that is none; `status` as of HTTP."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"status {status} {message}".strip())
        self.status = status


def checked(vectors: list, n: int, dimensions: int | None) -> list[list[float]]:
    """The contract of a response: as many vectors as texts, all of one length (`dimensions`, if given), finite, not all
    zero."""
    import math

    if len(vectors) != n:
        raise ValueError(f"{len(vectors)} vectors for {n} texts")
    size = dimensions or (len(vectors[0]) if vectors else 0)
    for v in vectors:
        if len(v) != size or not size:
            raise ValueError(f"a vector of {len(v)} dimensions, not {size}")
        if not all(math.isfinite(x) for x in v) or not any(v):
            raise ValueError("a vector that is not finite, or zero")
    return vectors


def asked(embedder: Callable[[list[str]], list], texts: list[str], dimensions: int | None, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One request, tried again with growing waits where the provider was busy or failed; other errors are final."""
    for turn in range(TRIES):
        try:
            return checked(embedder(texts), len(texts), dimensions)
        except ProviderError as e:
            if e.status not in AGAIN or turn == TRIES - 1:
                raise
            sleep(WAIT * 2**turn)
    raise AssertionError


def content_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class VectorStore:
    """Vectors (doc_id, sha, vector) below `root`, of one provider, model and dimension (the header)."""

    SCHEMA = "doc_id string, sha string, vector array<float>"

    def __init__(self, spark: SparkSession, root: str, header: dict):
        self.spark, self.root, self.header = spark, root.rstrip("/"), header

    def _exists(self, name: str) -> bool:
        where, files = place(self.spark, f"{self.root}/{name}")
        return files.exists(where)

    def header_fits(self) -> bool:
        """Whether what is stored was made by this provider, model and dimension."""
        if not self._exists("header.json"):
            return False
        return json.loads(self.spark.read.text(f"{self.root}/header.json", wholetext=True).first()[0]) == self.header

    def _start(self) -> None:
        """An empty store with this header; what another header made goes."""
        where, files = place(self.spark, self.root)
        files.delete(where, True)
        out = files.create(place(self.spark, f"{self.root}/header.json")[0], True)
        out.write(bytearray(json.dumps(self.header).encode()))
        out.close()

    def stored(self) -> DataFrame:
        """All committed vectors; a document may have one for each text it has had."""
        if not self.header_fits() or not self._exists("vectors"):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/vectors")

    def current(self, corpus: DataFrame) -> DataFrame:
        """The vectors of a corpus (doc_id, text) as it is now: those of deleted documents and former texts are left out."""
        now = corpus.select(F.col("doc_id").cast("string").alias("doc_id"), content_key(F.col("text")).alias("sha"))
        return self.stored().join(now, ["doc_id", "sha"], "left_semi").dropDuplicates(["doc_id", "sha"])

    def pending(self, corpus: DataFrame) -> DataFrame:
        rows = corpus.select(F.col("doc_id").cast("string").alias("doc_id"), content_key(F.col("text")).alias("sha"), F.coalesce("text", F.lit("")).alias("text"))
        return rows.filter("doc_id is not null").dropDuplicates(["doc_id", "sha"]).join(self.stored().select("doc_id", "sha"), ["doc_id", "sha"], "left_anti")

    def build(self, corpus: DataFrame, embedder: Callable[[list[str]], list], commit_rows: int = 100_000, sleep: Callable[[float], None] = time.sleep) -> int:
        """Embed what is pending; the number of vectors made.

        Pending rows fall into slices by a hash of the document, about commit_rows each, and a slice is one job whose
        output Spark commits as a whole. A slice that fails ends the build; those before it stay, so the next build asks
        for the rest. A changed header makes a new store."""
        if not self.header_fits():
            self._start()
        todo = keep(self.pending(corpus), "pending")
        n = todo.count()
        slices = -(-n // commit_rows)
        dimensions = self.header.get("dimensions")

        def run(frames: Iterator) -> Iterator:
            import pandas as pd

            for pdf in frames:
                made: list = []
                for at in range(0, len(pdf), BATCH):
                    made += asked(embedder, pdf["text"].iloc[at : at + BATCH].tolist(), dimensions, sleep)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "sha": pdf["sha"], "vector": made})

        for i in range(slices):
            part = todo.filter(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == i)
            part.mapInPandas(run, self.SCHEMA).write.mode("append").parquet(f"{self.root}/vectors")
        return n


def channel_needed(config: Column) -> Column:
    """From the text of an embedding configuration: false where there is none, whether it is enabled, and true where it
    does not parse, so that the channel itself reports that."""
    parsed = F.try_parse_json(config)
    on = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.enabled", "variant")) == "BOOLEAN", F.lit(False)) & F.coalesce(F.try_variant_get(parsed, "$.enabled", "boolean"), F.lit(False))
    return F.when(config.isNull(), False).when(parsed.isNull(), True).otherwise(on)


def degraded(status: Column) -> Column:
    """The reason that a channel reports for a provider's status; null for success."""
    return F.when((status < 200) | (status > 299), status_category(status))
