"""Events as they come into being: recalls, deliveries, consumptions, builds and feedback as lines of the log, and the
append that lets only valid lines in.

Trace ids are derived from what the event is about, so a task that runs twice writes the same line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import jsonschema
from tessella.scratch import keep
from tessella.sources import event_schema, logs

#: Most topics of an event, the reasons of an abstention, and the codes of failed builds.
TOPICS = 20
REASONS = ("no-trusted-candidate", "below-threshold", "budget-empty", "all-candidates-excluded")
BUILD_CODE, NO_BUILD_CODE = "^[A-Z0-9_-]{1,64}$", "REBUILD_FAILED"


@dataclass(frozen=True)
class Log:
    """What all lines of a log share."""

    schema: str
    at: Column
    runtime_version: str
    version: str


def trace_id(*parts: Column) -> Column:
    """A trace id in the form of a random UUID, from a digest of the parts."""
    h = F.sha2(F.concat_ws("\n", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def amount(value: Column) -> Column:
    """A time or number as events hold it: three digits; 0 for missing, negative, infinite or undefined ones."""
    v = value.cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
    return F.when(good, F.round(v, 3)).otherwise(0.0)


def count(value: Column) -> Column:
    """A whole number, 0 for anything else."""
    v = value.cast("double")
    return F.when(v.isNotNull() & (v >= 0) & (v == F.floor(v)), value.cast("long")).otherwise(F.lit(0).cast("long"))


def component(mode: Column, status: Column) -> Column:
    """Which part answered: the snapshot, the one before it, or the Markdown itself."""
    return F.when(~F.coalesce(mode == "snapshot", F.lit(False)), "memory-recall-fallback").when(status == "previous", "memory-recall-previous").otherwise("memory-recall-snapshot")


def line(log: Log, event: str, trace: Column, snapshot: Column, part: Column, payload: list[Column], optional: dict[str, Column] | None = None) -> Column:
    """A line of the log as JSON. Nulls are written, but a member of `optional` is left out where it is null."""
    at = F.date_format(log.at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    process = F.struct(F.lit("node").alias("runtime"), F.lit(log.runtime_version).alias("runtime_version"), part.alias("component"), F.lit(log.version).alias("component_version"))

    def written(members: list[Column], rest: list[tuple[str, Column]]) -> Column:
        if rest:
            (name, value), *others = rest
            return F.when(value.isNull(), written(members, others)).otherwise(written([*members, value.alias(name)], others))
        body = F.struct(F.lit(log.schema).alias("schema"), F.lit(event).alias("event"), at.alias("recorded_at"), trace.alias("trace_id"), snapshot.alias("snapshot_id"), process.alias("process"), F.struct(*members).alias("payload"))
        return F.to_json(body, {"ignoreNullFields": "false"})

    return written(payload, list((optional or {}).items()))


def lane_counts(lanes: DataFrame, channels) -> DataFrame:
    """(query_id, channels: a count for each channel, zeros included, candidates: distinct documents) of a plan's lanes
    (query_id, channel, doc_id)."""
    each = lanes.groupBy("query_id").pivot("channel", list(channels)).agg(F.count(F.lit(1)))
    each = each.select("query_id", F.struct(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in channels]).alias("channels"))
    return each.join(lanes.groupBy("query_id").agg(F.count_distinct("doc_id").alias("candidates")), "query_id")


def recalls(log: Log, asks: DataFrame, lanes: DataFrame, answers: DataFrame, abstentions: DataFrame, key: str, channels, surface: str = "cli", eligible: bool = True) -> DataFrame:
    """(query_id, trace_id, value): a completed recall for each query of a batch.

    asks: (query_id, query, classes, and measures: total_ms, load_ms, plan_ms, rank_ms, context_ms, estimated_tokens,
    dropped_topics, truncated, hot, mode, status, snapshot_id, embedding: struct or null); lanes: (query_id, channel,
    doc_id); answers: (query_id, position, doc_id) of which the first TOPICS count; abstentions: (query_id, reason).

    A query abstains where it is among the abstentions; its reason is `no-trusted-candidate` where it is none of REASONS. A query
    without a class is `natural`, a plan without candidates has zeros. Only its keyed digest stands for the query."""
    zeros = F.struct(*[F.lit(0).cast("long").alias(c) for c in channels])
    first = answers.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).filter(F.col("_n") <= TOPICS)
    topics = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("doc_id").cast("string").alias("topic")))), lambda x: x["topic"]).alias("topics"))
    gone = abstentions.select("query_id", F.when(F.col("reason").isin(*REASONS), F.col("reason")).otherwise(REASONS[0]).alias("reason"))
    rows = asks.join(lane_counts(lanes, channels), "query_id", "left").join(topics, "query_id", "left").join(gone, "query_id", "left")
    rows = rows.withColumn("topics", F.coalesce("topics", F.array().cast("array<string>"))).withColumn("channels", F.coalesce("channels", zeros))
    abstained = F.col("reason").isNotNull()
    payload = [
        F.lit("claude-hook" if surface == "claude-hook" else "cli").alias("surface"),
        (F.lit(eligible) & ~abstained & (F.size("topics") > 0)).alias("consumption_eligible"),
        logs.query_id(key, F.col("query")).alias("query_id"),
        F.when(F.size("classes") > 0, F.col("classes")).otherwise(F.array(F.lit("natural"))).alias("query_class"),
        F.when(F.col("hot"), "hot").otherwise("cold").alias("execution"),
        amount(F.col("total_ms")).alias("total_ms"),
        F.struct(*[amount(F.col(f"{s}_ms")).alias(s) for s in ("load", "plan", "rank", "context")]).alias("stage_ms"),
        F.col("channels"),
        F.coalesce("candidates", F.lit(0)).alias("rrf_candidates"),
        abstained.alias("abstained"),
        F.col("reason").alias("abstain_reason"),
        F.col("topics").alias("returned_topics"),
        count(F.round("estimated_tokens")).alias("estimated_tokens"),
        F.lit(None).cast("boolean").alias("cache_hit"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
        count(F.col("dropped_topics")).alias("dropped_topics"),
    ]
    trace = trace_id(F.lit("recall"), log.at, F.col("query_id"))
    return rows.select("query_id", trace.alias("trace_id"), line(log, "recall.completed", trace, F.col("snapshot_id"), component(F.col("mode"), F.col("status")), payload, {"embedding": F.col("embedding")}).alias("value"))


def _told(rows: DataFrame) -> DataFrame:
    """Rows with a trace and at least one topic; each topic once."""
    return rows.withColumn("topics", F.array_distinct("topics")).filter(F.col("trace_id").isNotNull() & (F.size("topics") > 0))


def deliveries(log: Log, rows: DataFrame, surface: str = "claude-hook", part: str = "memory-hook") -> DataFrame:
    """(trace_id, value) of what was shown: (trace_id, snapshot_id, topics). Rows without a trace or a topic tell nothing and
    are left out."""
    payload = [F.lit(surface).alias("surface"), F.col("topics")]
    return _told(rows).select("trace_id", line(log, "recall.delivered", F.col("trace_id"), F.col("snapshot_id"), F.lit(part), payload).alias("value"))


def consumptions(log: Log, rows: DataFrame, part: str = "memory-hook") -> DataFrame:
    """(trace_id, value) of what was opened: (trace_id, snapshot_id, topics, via, match), null via and match being
    `claude-hook` and `recent`. An open does not tell whether its authority was followed."""
    payload = [F.col("topics"), F.lit(None).cast("boolean").alias("authority_followed"), F.coalesce("via", F.lit("claude-hook")).alias("via"), F.coalesce("match", F.lit("recent")).alias("match")]
    return _told(rows).select("trace_id", line(log, "recall.consumed", F.col("trace_id"), F.col("snapshot_id"), F.lit(part), payload).alias("value"))


def builds(log: Log, rows: DataFrame) -> DataFrame:
    """(build_id, trace_id, value) of index builds: (build_id, snapshot_id, mode, changed, compiled, reused, deleted, bytes,
    duration_ms, error, previous_used). A failed build (error is not null) falls back and has a code."""
    failed = F.col("error").isNotNull()
    upper = F.upper("error")
    payload = [
        F.when(F.col("mode") == "incremental", "incremental").otherwise("full").alias("mode"),
        *[count(F.col(c)).alias(n) for c, n in (("changed", "changed_files"), ("compiled", "compiled_topics"), ("reused", "reused_topics"), ("deleted", "deleted_topics"))],
        amount(F.col("duration_ms")).alias("duration_ms"),
        count(F.col("bytes")).alias("snapshot_bytes"),
        (~failed).alias("success"),
        (failed | F.coalesce("previous_used", F.lit(False))).alias("fallback"),
        F.lit(None).cast("double").alias("previous_snapshot_age_ms"),
        F.when(failed, F.when(upper.rlike(BUILD_CODE), upper).otherwise(NO_BUILD_CODE)).alias("error_code"),
    ]
    trace = trace_id(F.lit("build"), log.at, F.col("build_id"))
    return rows.select("build_id", trace.alias("trace_id"), line(log, "index.build", trace, F.col("snapshot_id"), F.lit("memory-compile"), payload).alias("value"))


def append(values: DataFrame, folder: str, schema_id: str, events: tuple[str, ...] = logs.EVENTS) -> DataFrame:
    """Append lines (value) to a folder of days (day=...), as JSON lines; lines that break the schema stay out and are
    returned with their violations. `events`: those that the batch may hold; fewer of them make a smaller plan.

    Lines are validated once; what is written is a table of checked lines, so a lost task repeats only itself."""
    checked = keep(values.select("value", jsonschema.violations(F.col("value"), event_schema.schema(schema_id, events)).alias("violations")), "checked-lines")
    day = F.substring(F.get_json_object("value", "$.recorded_at"), 1, 10)
    checked.filter("size(violations) = 0").select("value", day.alias("day")).write.mode("append").partitionBy("day").text(folder)
    return checked.filter("size(violations) > 0")
