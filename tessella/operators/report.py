"""Usage analytics over an append-only log of recall events.

The log has one row per event: event, recorded_at, trace_id, and for recalls surface, execution, shape, abstained,
total_ms and returned (topics). Ratios over nothing are null. Everything is one pass of partial aggregation where the
definition allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.math import distribution, percentile, ratio


def counts_by(events: DataFrame, *keys: str) -> DataFrame:
    """Rows per key."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def channel_rollup(events: DataFrame, channels: str) -> DataFrame:
    """Per channel of a map column: the sum of its values and the number of rows where it is positive."""
    flat = events.select(F.explode(channels).alias("channel", "found"))
    return flat.groupBy("channel").agg(F.sum("found").alias("candidates"), F.count_if(F.col("found") > 0).alias("hits"))


def latency(events: DataFrame, value: str, *keys: str) -> DataFrame:
    """Nearest-rank distribution by key (of everything without keys)."""
    return events.groupBy(*keys).agg(*distribution(value))


def cohorts(recalls: DataFrame, keys: Sequence[str] = ("surface", "execution", "shape")) -> DataFrame:
    """Samples, latency and abstain rate of each cohort."""
    abstained = F.count_if("abstained")
    return recalls.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), abstained.alias("abstained"), F.round(ratio(abstained, F.count(F.lit(1))), 6).alias("abstain_rate"), percentile("total_ms", 0.5).alias("p50"), percentile("total_ms", 0.95).alias("p95"))


def abstain_rates(recalls: DataFrame, key: str = "surface") -> DataFrame:
    """Abstain rate by key with one blended row (key null)."""
    n, k = F.count(F.lit(1)), F.count_if("abstained")
    return recalls.groupingSets([[key], []], key).agg(n.alias("attempts"), k.alias("abstained"), F.round(ratio(k, n), 6).alias("abstain_rate"))


def latest(events: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], tie: str) -> DataFrame:
    """The values of the newest row per key; of several, of that with the largest tie column."""
    row = F.max_by(F.struct(*values), F.struct(at, tie)).alias("_last")
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), row).select(*keys, "n", "_last.*")


def funnel(recalls: DataFrame, delivered: DataFrame, consumed: DataFrame) -> DataFrame:
    """One row: produced (recalls with results), delivered and opened traces, and their rates."""
    produced = recalls.filter(~F.col("abstained"))
    traces = produced.select("trace_id").distinct()
    reached = traces.join(delivered.select("trace_id").distinct(), "trace_id", "left_semi")
    opened = reached.join(consumed.select("trace_id").distinct(), "trace_id", "left_semi")
    row = produced.agg(F.count(F.lit(1)).alias("produced")).crossJoin(reached.agg(F.count(F.lit(1)).alias("delivered"))).crossJoin(opened.agg(F.count(F.lit(1)).alias("opened")))  # one row each
    return row.select("*", F.round(ratio(F.col("delivered"), F.col("produced")), 6).alias("delivery_rate"), F.round(ratio(F.col("opened"), F.col("delivered")), 6).alias("open_rate"))


def orphans(recalls: DataFrame, delivered: DataFrame, consumed: DataFrame) -> DataFrame:
    """Deliveries without a recall, and consumptions without a delivery: kind, trace_id, n."""
    lost = delivered.join(recalls.select("trace_id").distinct(), "trace_id", "left_anti").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    early = consumed.join(delivered.select("trace_id").distinct(), "trace_id", "left_anti").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    return lost.select(F.lit("delivery-without-recall").alias("kind"), "trace_id", "n").unionByName(early.select(F.lit("open-without-delivery").alias("kind"), "trace_id", "n"))


def adoption(recalls: DataFrame, consumed: DataFrame) -> DataFrame:
    """One row: eligible recalls, those consumed, and in how many a returned (the first returned) topic was opened."""
    opened = consumed.groupBy("trace_id").agg(F.array_distinct(F.flatten(F.collect_list("topics"))).alias("opened"))
    eligible = recalls.filter(~F.col("abstained") & (F.size("returned") > 0)).join(opened, "trace_id", "left")
    used = F.col("opened").isNotNull()
    n = F.count_if(used)
    any_, top = F.count_if(used & F.arrays_overlap("returned", "opened")), F.count_if(used & F.array_contains("opened", F.col("returned")[0]))
    return eligible.agg(F.count(F.lit(1)).alias("eligible"), n.alias("consumed"), any_.alias("adopted"), top.alias("adopted_top1"), F.round(ratio(any_, n), 6).alias("adoption_rate"), F.round(ratio(top, n), 6).alias("top1_rate"))


def pair_as_of(opens: DataFrame, recalls: DataFrame, hours: int = 2) -> DataFrame:
    """Each open (open_id, at, session, topic) with the recall (recall_id, at, session, topic) it came from: at most
    `hours` earlier and with the same topic; the same session first, then the newest, then the largest id.

    The range join is an equi-join on topic and time bucket: a recall serves its own bucket and the next one."""
    width = hours * 3600
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    left = opens.select("open_id", F.col("at").alias("open_at"), F.col("session").alias("open_session"), "topic", F.floor(at("at") / (width * 10**6)).alias("bucket"))
    right = recalls.select("recall_id", F.col("at").alias("recall_at"), F.col("session").alias("recall_session"), "topic", F.floor(at("at") / (width * 10**6)).alias("b"))
    right = right.withColumn("bucket", F.explode(F.array(F.col("b"), F.col("b") + 1))).drop("b")
    gap = at("open_at") - at("recall_at")
    found = left.join(right, ["topic", "bucket"]).filter((gap >= 0) & (gap <= width * 10**6))
    same = F.coalesce((F.col("open_session") == F.col("recall_session")).cast("int"), F.lit(0))
    best = F.max(F.struct(same.alias("same"), at("recall_at").alias("t"), "recall_id")).alias("best")
    return left.join(found.groupBy("open_id").agg(best), "open_id", "left").select("open_id", F.col("best.recall_id").alias("recall_id"), (F.col("best.same") == 1).alias("same_session"))


def period_over_period(events: DataFrame, value: str, as_of: Column, days: int, *keys: str) -> DataFrame:
    """Count and mean of the window that ends at as_of, and of the equal window before it, with their change."""
    t = F.col("recorded_at")
    window = F.when((t > as_of - F.make_dt_interval(F.lit(days))) & (t <= as_of), "now").when((t > as_of - F.make_dt_interval(F.lit(2 * days))) & (t <= as_of - F.make_dt_interval(F.lit(days))), "before")
    tagged = events.withColumn("_w", window).filter("_w is not null")
    now, before = F.col("_w") == "now", F.col("_w") == "before"
    out = tagged.groupBy(*keys).agg(F.count_if(now).alias("n_now"), F.count_if(before).alias("n_before"), F.round(F.avg(F.when(now, F.col(value))), 6).alias("mean_now"), F.round(F.avg(F.when(before, F.col(value))), 6).alias("mean_before"))
    return out.withColumn("growth", F.round(ratio(F.col("n_now") - F.col("n_before"), F.col("n_before")), 6))


def constant_fields(payloads: DataFrame, event: str, fields: Sequence[str], least: int = 30) -> DataFrame:
    """Fields with a single value (null is one) over all events of a type with at least `least` events."""
    long = payloads.select(event, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(event, "x.*")
    out = long.groupBy(event, "field").agg(F.count(F.lit(1)).alias("samples"), (F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("values"), F.min("value").alias("value"))
    return out.filter((F.col("samples") >= least) & (F.col("values") == 1)).drop("values")


def components_seen(events: DataFrame, expected: Sequence[str], component: str) -> DataFrame:
    """Expected components that are silent, and seen ones that are not expected."""
    wanted = events.sparkSession.createDataFrame([(c,) for c in expected], f"{component} string")
    seen = events.select(component).distinct()
    silent = wanted.join(seen, component, "left_anti").select(component, F.lit("silent").alias("state"))
    return silent.unionByName(seen.join(wanted, component, "left_anti").select(component, F.lit("unexpected").alias("state")))


def first_in_session(events: DataFrame, session: str, epoch: str, topic: str, at: str, tie: str) -> DataFrame:
    """A topic's first delivery in a session; a new epoch (snapshot) starts anew."""
    order = Window.partitionBy(session, epoch, topic).orderBy(at, tie)
    return events.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def sessions(events: DataFrame, user: str, at: str, tie: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions of a user: a gap longer than gap_minutes ends one. user, session (from 1), start, end, n."""
    order = Window.partitionBy(user).orderBy(at, tie)
    t = F.unix_micros(F.col(at).cast("timestamp"))
    marked = events.withColumn("_new", (t - F.lag(t).over(order) > gap_minutes * 60 * 10**6).cast("int"))
    marked = marked.withColumn("session", F.coalesce(F.sum("_new").over(order), F.lit(0)) + 1)
    return marked.groupBy(user, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n"))


def tumbling(events: DataFrame, at: str, width: str, *keys: str) -> DataFrame:
    """Counts by tumbling window (its start)."""
    return events.groupBy(F.window(F.col(at).cast("timestamp"), width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def sliding(events: DataFrame, at: str, width: str, slide: str, *keys: str) -> DataFrame:
    """Counts by sliding window (its start)."""
    return events.groupBy(F.window(F.col(at).cast("timestamp"), width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def newest_within(rows: DataFrame, key: Sequence[str], at: str, tie: str, size: str, cap: int) -> DataFrame:
    """Retention: the newest rows per key whose sizes add up to at most `cap`; stops at the first overflow."""
    order = Window.partitionBy(*key).orderBy(F.desc(at), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(order)).filter(F.col("running") <= cap)


def islands(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Merge overlapping or touching spans of a key: key, start, end, n."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(start) > before).cast("int"), F.lit(1))
    marked = spans.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"))
