"""Incremental maintenance: source diffs, invalidation over dependencies, compile digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.scratch import keep


def source_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, sha) before and after: new, deleted, changed; unchanged paths are left out."""
    both = old.select("path", F.col("sha").alias("was")).join(new.select("path", F.col("sha").alias("now")), "path", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", state.alias("state")).filter("state is not null")


def closure(changed: DataFrame, depends: DataFrame) -> DataFrame:
    """All ids that the changed ones (id) reach over depends (id, on), with their least depth; cycles are walked once.

    A recursive CTE would walk every path of a diamond; here each round joins the new frontier only. Every frontier is
    written once to the shared folder, so lineage stays short and lost executors cost one round; what was seen is the
    union of these tables and is never written again."""
    edge = keep(changed.select("id", F.lit(0).alias("depth")).distinct(), "frontier")
    seen, depth = edge, 0
    while True:
        depth += 1
        step = depends.join(edge.select(F.col("id").alias("on")), "on").select("id").distinct().join(seen, "id", "left_anti")
        edge = keep(step.select("id", F.lit(depth).alias("depth")), "frontier")
        if edge.isEmpty():
            return seen
        seen = seen.unionByName(edge)


def digest(*parts: Column) -> Column:
    """Stable sha-256 of columns: nulls and separators cannot be confused with values."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("n")) for p in parts]), 256)


def plan(current: DataFrame, prior: DataFrame, affected: DataFrame) -> DataFrame:
    """(id, digest) now and before, and the ids that a changed dependency affects: reuse, compile, invalidated, delete."""
    both = current.select("id", F.col("digest").alias("now")).join(prior.select("id", F.col("digest").alias("was")), "id", "full_outer").join(affected.select("id", F.lit(True).alias("hit")), "id", "left")
    state = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull() | (F.col("was") != F.col("now")), "compile").when(F.col("hit"), "invalidated").otherwise("reuse")
    return both.select("id", state.alias("action"))


def inverse_mismatches(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) that only one side of a forward and a reverse (dst, src, kind) list holds."""
    back = reverse.select("src", "dst", "kind")
    a = forward.select("src", "dst", "kind").exceptAll(back).withColumn("missing_in", F.lit("reverse"))
    return a.unionByName(back.exceptAll(forward.select("src", "dst", "kind")).withColumn("missing_in", F.lit("forward")))
