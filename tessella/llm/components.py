"""Connected components with DataFrames: alternate large stars and small stars until the edges stand still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._scale import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node at the smallest of them (the node itself counts): larger neighbours in a large
    star, the node and its smaller ones in a small star."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    if large:  # only here a node can have very many neighbours
        least = keep(least, "least")
    joined = near.join(least, "a")
    out = joined.filter("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.filter("a <> m").select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of the edges (a, b: long) with the smallest node that it is connected to.

    Edges may repeat, point either way or be loops (a node with loops only is left out). Each round is written to the
    shared folder; a hub's edges are combined before the shuffle and split by skew joins after it."""
    state = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
    before = sign(state)
    while before[0]:
        state = keep(_star(_star(state, True), False), "edges")
        after = sign(state)
        if after == before:
            break
        before = after
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
