"""Vectors: cosine top-k over blocks, staleness and reconciliation of stored embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.math import clamp, ratio


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where one of the vectors has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector at length one (a zero vector stays)."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


#: Vectors of a group at most (about), and fewest where there are cores to spare.
GROUP, FEWEST = 32_768, 1_024


def cosine_top_k(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, vector) against all (doc_id, vector): the best k by score = clamp((cosine + 1) / 2), then id.

    Both sides stay in the cluster: queries and rows fall into groups by a hash of their ids, and a task gets one group of
    each, so every pair of groups meets once in an equi-join on the two group numbers. A task keeps the best k of its rows
    for each of its queries. Exact; rows without a vector take no part, and a vector of zeros has cosine 0."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()
    left, right = (df.filter("vector is not null").select(i, unit(F.col("vector")).alias("v")) for df, i in ((queries, "query_id"), (docs, "doc_id")))
    n, m = left.count(), right.count()
    g = -(-n // GROUP) or 1
    h = max(-(-m // GROUP), min(spark.sparkContext.defaultParallelism, -(-m // FEWEST))) or 1
    number = lambda i, of: F.pmod(F.xxhash64(i), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = left.withColumn("g", number("query_id", g)).withColumn("h", every(h))
    right = right.withColumn("h", number("doc_id", h)).withColumn("g", every(g))

    def best(a, b):
        import numpy as np
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": a["query_id"][:0], "doc_id": b["doc_id"][:0], "score": np.zeros(0)})
        b = b.sort_values("doc_id")
        x, ids = np.stack(b["v"].to_numpy()), b["doc_id"].to_numpy()
        out = []
        for lo in range(0, len(a), 256):
            part = a[lo : lo + 256]
            score = np.clip((np.stack(part["v"].to_numpy()) @ x.T + 1) / 2, 0, 1)
            shown = np.round(score, 9)
            least = np.partition(shown, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
            row, col = np.nonzero(shown >= least[:, None])
            order = np.lexsort((col, -shown[row, col], row))  # ties go to the smaller id
            row, col = row[order], col[order]
            first = np.searchsorted(row, np.arange(len(part)))
            top = np.arange(len(row)) - first[row] < k
            row, col = row[top], col[top]
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "doc_id": ids[col], "score": score[row, col]}))
        return pd.concat(out)

    met = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(best, f"query_id {qkind}, doc_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def reconcile(corpus: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, sha) against stored (doc_id, sha): state fresh, pending (new or changed) or deleted."""
    both = corpus.select("doc_id", F.col("sha").alias("now")).join(stored.select("doc_id", F.col("sha").alias("then")), "doc_id", "full_outer")
    return both.select("doc_id", F.when(F.col("now").isNull(), "deleted").when(F.col("then").isNull() | (F.col("now") != F.col("then")), "pending").otherwise("fresh").alias("state"))


def staleness(states: DataFrame, limit: float = 0.2) -> DataFrame:
    """One row: total, stale, ratio (null over nothing) and whether the channel degrades, as it does over nothing."""
    stale = F.count_if(F.col("state") != "fresh")
    share = ratio(stale, F.count(F.lit(1)))
    return states.agg(F.count(F.lit(1)).alias("total"), stale.alias("stale"), F.round(share, 6).alias("stale_ratio"), F.coalesce(share > limit, F.lit(True)).alias("degraded"))


def allowed(states: DataFrame, stored: DataFrame, dimensions: int) -> DataFrame:
    """(doc_id) that an embedding channel may answer with: fresh documents whose stored vector (doc_id, dimensions) has as
    many dimensions as the queries' vectors."""
    fit = stored.filter(F.col("dimensions") == dimensions).select("doc_id").distinct()
    return states.filter("state = 'fresh'").select("doc_id").join(fit, "doc_id")


def outside(answers: DataFrame, allowed_ids: DataFrame) -> DataFrame:
    """Answers (query_id, doc_id, ...) with documents that are not allowed: their channel degrades."""
    return answers.join(allowed_ids.select("doc_id"), "doc_id", "left_anti")


def similarity(score: Column) -> Column:
    return clamp((score + 1) / 2)
