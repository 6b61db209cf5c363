"""Substring joins: which values hold a whole query, for query sets of any size and values of any length.

Every query owns the runs of g characters in it (g: the largest of SIZES that fits), and a value that holds the query
holds each of these. Values are cut into their runs once and only runs that some query owns are kept; a map of bounded
size tells most others apart before anything is shuffled. Each query meets the values that hold its rarest run; those are
verified by the whole query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.scratch import keep

#: Characters of a run, by the length of the query.
SIZES = (1, 2, 4, 8, 16)
#: Characters of the pieces in which a long value is cut into runs: a task holds one piece's runs at a time.
PIECE = 1024
#: Words of 64 bits in the map of runs that some query owns: it is sent to all tasks, and never larger than this.
WORDS = 1 << 20


def pieces(text: Column, piece: int = PIECE) -> Column:
    """Pieces of a text that overlap by the longest run less one, so that each run lies within one of them."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{piece + SIZES[-1] - 1}}})).{{1,{piece}}}"), F.lit(1))


def runs(text: Column, size: int) -> Column:
    """The runs of `size` characters of a text, one from each place."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _place(run: Column) -> tuple[Column, Column]:
    """Word and bit of a run in the map."""
    h = F.xxhash64(run)
    return F.pmod(h, F.lit(WORDS)).cast("int"), F.pmod(F.shiftright(h, 24), F.lit(64)).cast("int")


def _perhaps(each: DataFrame, owned: DataFrame) -> DataFrame:
    """Rows whose _run may be one of `owned`, before anything is shuffled: a map of WORDS words, whatever the number of
    runs. It keeps every run that is owned, and others by chance."""
    word, bit = _place(F.col("_run"))
    marks = owned.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask"))
    placed = each.withColumn("_word", word).withColumn("_bit", bit)
    return placed.join(F.broadcast(marks), "_word").filter(F.expr("shiftright(_mask, _bit) & 1L") == 1).drop("_word", "_bit", "_mask")  # WORDS rows at most


def run_size(query: Column) -> Column:
    out = F.lit(SIZES[0])
    for size in SIZES[1:]:
        out = F.when(F.length(query) >= size, F.lit(size)).otherwise(out)
    return out


def holding(values: DataFrame, value: str, queries: DataFrame, query: str) -> DataFrame:
    """The columns of values and queries, one row for each pair where the value holds the query. Null values hold
    nothing; null and empty queries are held by nothing; repeated rows stay repeated. The two sides share no column name.

    Equal values and equal queries meet once. A run that very many values hold costs a row for each of these values, and
    is asked for only by queries whose every run is as frequent; the candidates of such a run are joined by its name, in
    partitions that AQE splits where they are large."""
    asked = keep(queries.filter(F.length(query) > 0).select(F.col(query).alias("_q")).distinct().withColumn("_size", run_size(F.col("_q"))), "asked-texts")
    sizes = sorted(r["_size"] for r in asked.select("_size").distinct().collect())  # five at most
    if not sizes:
        return values.join(queries, F.lit(False))
    own = F.lit(None).cast("array<string>")
    for size in sizes:
        own = F.when(F.col("_size") == size, runs(F.col("_q"), size)).otherwise(own)
    owned = keep(asked.select("_q", F.explode(F.array_distinct(own)).alias("_run")), "owned-runs")
    # Equal values share a key; what two unlike values of one key have in common is verified like all else.
    cut = values.select(F.xxhash64(value).alias("_v"), F.explode(pieces(F.col(value))).alias("_piece"))
    each = cut.select("_v", F.explode(F.concat(*[runs(F.col("_piece"), size) for size in sizes])).alias("_run"))
    # An inner join with distinct runs: the optimizer would move a semi join below the distinct, and shuffle every place.
    held = keep(_perhaps(each, owned).distinct().join(owned.select("_run").distinct(), "_run"), "held-runs")
    met = owned.join(held.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")), "_run", "left")
    rarest = met.groupBy("_q").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_run").alias("run"))).alias("_least"))
    rarest = rarest.filter("_least.n > 0").select("_q", F.col("_least.run").alias("_run"))
    candidates = held.join(rarest, "_run").select("_v", "_q")
    pairs = values.withColumn("_v", F.xxhash64(value)).join(candidates, "_v").filter(F.contains(F.col(value), F.col("_q")))
    return pairs.join(queries, F.col("_q") == F.col(query)).select(*[F.col(f"`{c}`") for c in (*values.columns, *queries.columns)])
