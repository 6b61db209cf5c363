"""What surrounds a recall: read decisions, activation, caches, path resolvers and embedding adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.math import clamp

#: Which error texts call for a rebuild, in order.
REBUILD = [(r"(?i)checksum|sha256|digest", "checksum-mismatch"), (r"(?i)schema|version", "schema-mismatch"), (r"(?i)missing|no such file|not found", "missing-artifact"), (r"(?i)parse|json|syntax", "corrupt-artifact")]


def rebuild_trigger(message: Column) -> Column:
    """Why a failed index read calls for a rebuild; null for other errors."""
    out = F.lit(None).cast("string")
    for pattern, code in reversed(REBUILD):
        out = F.when(message.rlike(pattern), F.lit(code)).otherwise(out)
    return out


def read_decision(manifest_valid: Column, reader_version: Column, version: Column, checksum_ok: Column, rebuilt: Column) -> Column:
    """ready, rebuilt or markdown-fallback; rebuild where nothing was tried yet (rebuilt is null)."""
    good = F.coalesce(manifest_valid & (reader_version >= version) & checksum_ok, F.lit(False))
    return F.when(good, "ready").when(rebuilt.isNull(), "rebuild").when(rebuilt, "rebuilt").otherwise("markdown-fallback")


def activation(states: DataFrame, guard: DataFrame, requested: str, force: bool = False, confirm: bool = False, limit: float = 0.2) -> DataFrame:
    """One row, mode and reason: off, observe or weighted. Weighted needs fresh vectors (stale share at most `limit`) and a
    safe guard, or force with confirmation."""
    stale = F.count_if(F.col("state") != "fresh") / F.nullif(F.count(F.lit(1)), F.lit(0))
    row = states.agg((F.coalesce(stale, F.lit(1.0)) <= limit).alias("fresh")).crossJoin(guard.agg(F.coalesce(F.bool_and("safe"), F.lit(False)).alias("safe")))  # one row each
    ask = F.lit(requested)
    allowed = F.col("safe") | F.lit(force and confirm)
    mode = F.when(~ask.isin("observe", "weighted") | ~F.col("fresh"), "off").when((ask == "weighted") & allowed, "weighted").otherwise("observe")
    reason = F.when(~F.col("fresh"), "vectors-stale").when((ask == "weighted") & ~allowed, "guard-not-safe").when((ask == "weighted") & ~F.col("safe"), "forced")
    return row.select(mode.alias("mode"), reason.alias("reason"))


def missing_vectors(queries: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(cache_key, query) of queries whose vector is not in the cache (cache_key) yet."""
    keyed = queries.select(F.sha2(F.concat_ws("\n", F.lit(model), F.sha2(F.lower(F.trim("query")), 256)), 256).alias("cache_key"), "query").dropDuplicates(["cache_key"])
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def newest(rows: DataFrame, key: list[str], touched: str, tie: str, most: int) -> DataFrame:
    """LRU caps: the `most` rows of each key that were touched last."""
    order = Window.partitionBy(*key).orderBy(F.desc(touched), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def safe_path(path: Column) -> Column:
    """Relative, without parent steps, drive letters, back slashes or control characters."""
    return F.coalesce((F.length(path) > 0) & ~path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|[\x00-\x1f]"), F.lit(False))


def tool_query(tool: Column, path: Column) -> Column:
    """The path that a file tool is about to touch is the query; null for other tools or unsafe paths."""
    return F.when(F.lower(tool).isin("edit", "write", "multiedit", "read") & safe_path(path), path)


def opened_topic(path: Column, folder: str) -> Column:
    """The topic that a read of `<folder>/<topic>.md` opens; null for catalogs and other files."""
    name = F.regexp_extract(path, rf"(?:^|/){folder.strip('/')}/([a-z0-9]+(?:_[a-z0-9]+)*)\.md$", 1)
    return F.nullif(name, F.lit(""))


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An offline embedder: signed feature hashing of words and their trigrams, at length one."""
    import hashlib
    import math

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimensions
            for word in (text or "").lower().split():
                for part in [word, *(word[i : i + 3] for i in range(len(word) - 2))]:
                    h = int.from_bytes(hashlib.sha256(part.encode()).digest()[:8], "big")
                    v[h % dimensions] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out

    return embed


def embed(rows: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """(key, vector) with a provider's callable, in batches; a wrong number of vectors is an error."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            made: list = []
            for at in range(0, len(pdf), batch):
                part = pdf[text].iloc[at : at + batch].tolist()
                got = embedder(part)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                made += got
            yield pd.DataFrame({key: pdf[key], "vector": made})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<float>")


def invalid_candidates(candidates: DataFrame, most: int = 100) -> DataFrame:
    """Adapter responses (query_id, position, doc_id, score): rows that break the contract, with a code: score outside
    0..1, not in falling order, doc_id twice, or beyond `most`."""
    order = Window.partitionBy("query_id").orderBy("position")
    twice = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("position")) > 1
    code = F.when(F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 1), "score-range").when(F.col("score") > F.lag("score").over(order), "not-sorted").when(twice, "duplicate").when(F.row_number().over(order) > most, "too-many")
    return candidates.withColumn("code", code).filter("code is not null")


def embedding_lane(candidates: DataFrame) -> DataFrame:
    """(query_id, doc_id, cosine) as a lane: score = clamp((cosine + 1) / 2)."""
    return candidates.withColumn("score", clamp((F.col("cosine") + 1) / 2)).drop("cosine")
