"""Event analytics over the `events` table, read as a recall log: view = recall, click = delivery, purchase = open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import report
from tessella.session import table


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", k)
        .select(
            "event_id",
            F.col("ts").alias("recorded_at"),
            "user_id",
            F.col("event_type").alias("event"),
            F.col("value").alias("total_ms"),
            "k",
            F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("trace_id"),
            F.element_at(F.array(F.lit("cli"), F.lit("hook"), F.lit("stdio")), F.col("k") % 3 + 1).alias("surface"),
            F.when(F.col("k") % 2 == 1, "warm").otherwise("cold").alias("execution"),
            F.when(F.col("k") < 30, "path").when(F.col("k") < 60, "natural").otherwise("mixed").alias("shape"),
            (F.col("k") % 5 == 0).alias("abstained"),
            F.array(F.concat(F.lit("t"), (F.col("k") % 10).cast("string")), F.concat(F.lit("t"), (F.col("k") % 7).cast("string"))).alias("returned"),
            F.array(F.concat(F.lit("t"), (F.col("k") % 10).cast("string"))).alias("topics"),
        )
    )


def kind(name: str):
    return lambda spark, sf_dir: log(spark, sf_dir).filter(F.col("event") == name)


recalls, delivered, consumed = kind("view"), kind("click"), kind("purchase")

LOG = """with log as (select event_id, ts as recorded_at, user_id, event_type as event, value as total_ms, k,
    cast(user_id as varchar) || '-' || strftime(ts, '%Y%m%d') as trace_id,
    case k % 3 when 0 then 'cli' when 1 then 'hook' else 'stdio' end as surface,
    case when k % 2 = 1 then 'warm' else 'cold' end as execution,
    case when k < 30 then 'path' when k < 60 then 'natural' else 'mixed' end as shape,
    k % 5 = 0 as abstained, ['t' || (k % 10), 't' || (k % 7)] as returned, ['t' || (k % 10)] as topics
  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)),
recalls as (select * from log where event = 'view'), delivered as (select * from log where event = 'click'),
consumed as (select * from log where event = 'purchase')
"""
P = "round(quantile_disc({v}, {p}), 3)"


def event_counts(spark, sf_dir):
    return report.counts_by(log(spark, sf_dir), "event", "surface")


def channel_rollup(spark, sf_dir):
    maps = log(spark, sf_dir).select(F.create_map(F.lit("exact"), F.col("k") % 4, F.lit("bm25f"), F.col("k") % 50, F.lit("graph"), F.lit(0)).alias("channels"))
    return report.channel_rollup(maps, "channels")


def latency_distribution(spark, sf_dir):
    return report.latency(recalls(spark, sf_dir), "total_ms", "surface")


def cohort_latency(spark, sf_dir):
    return report.cohorts(recalls(spark, sf_dir))


def surface_abstain_rate(spark, sf_dir):
    return report.abstain_rates(recalls(spark, sf_dir))


def latest_row(spark, sf_dir):
    return report.latest(log(spark, sf_dir), ["user_id", "event"], "recorded_at", ["event_id", "total_ms"], "event_id")


def null_safe_ratio(spark, sf_dir):
    from tessella.functions.math import ratio

    rows = log(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event") == "click").alias("clicks"), F.count_if((F.col("event") == "error") & (F.col("k") > 90)).alias("errors"))
    return rows.select("user_id", "clicks", "errors", F.round(ratio(F.col("clicks"), F.col("errors")), 6).alias("clicks_per_error"))


def delivery_funnel(spark, sf_dir):
    return report.funnel(recalls(spark, sf_dir), delivered(spark, sf_dir), consumed(spark, sf_dir))


def orphan_events(spark, sf_dir):
    return report.orphans(recalls(spark, sf_dir), delivered(spark, sf_dir), consumed(spark, sf_dir))


def adoption_left_join(spark, sf_dir):
    return report.adoption(recalls(spark, sf_dir), consumed(spark, sf_dir))


def asof_pairing(spark, sf_dir):
    opens = consumed(spark, sf_dir).select(F.col("event_id").alias("open_id"), F.col("recorded_at").alias("at"), F.col("user_id").alias("session"), F.col("topics")[0].alias("topic"))
    shown = recalls(spark, sf_dir).select(F.col("event_id").alias("recall_id"), F.col("recorded_at").alias("at"), F.col("user_id").alias("session"), F.col("topics")[0].alias("topic"))
    return report.pair_as_of(opens, shown)


def period_over_period(spark, sf_dir):
    return report.period_over_period(log(spark, sf_dir), "total_ms", F.to_timestamp_ntz(F.lit("2024-01-29 00:00:00")), 7, "event")


def constant_fields(spark, sf_dir):
    rows = log(spark, sf_dir).select("event", "k", "surface", F.lit("v1").alias("schema"), F.when(F.col("event") == "view", "recall").when(F.col("k") >= 0, F.col("surface")).alias("component"), F.lit(None).cast("string").alias("note"))
    return report.constant_fields(rows, "event", ["k", "surface", "schema", "component", "note"])


def silent_components(spark, sf_dir):
    return report.components_seen(log(spark, sf_dir).withColumn("component", F.concat_ws("/", "surface", "execution")), ["cli/warm", "cli/cold", "hook/warm", "daemon/warm"], "component")


def session_dedup(spark, sf_dir):
    rows = delivered(spark, sf_dir).withColumn("epoch", F.date_trunc("week", F.col("recorded_at")).cast("timestamp_ntz")).withColumn("topic", F.col("topics")[0])
    return report.first_in_session(rows, "user_id", "epoch", "topic", "recorded_at", "event_id").select("user_id", "epoch", "topic", "event_id")


def session_windows(spark, sf_dir):
    return report.sessions(log(spark, sf_dir), "user_id", "recorded_at", "event_id")


def tumbling_counts(spark, sf_dir):
    return report.tumbling(log(spark, sf_dir), "recorded_at", "1 day", "event")


def sliding_counts(spark, sf_dir):
    return report.sliding(log(spark, sf_dir), "recorded_at", "6 hours", "2 hours", "event")


def retention_running_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.octet_length("props") + 40).alias("bytes"))
    return report.newest_within(rows, ["user_id"], "ts", "event_id", "bytes", 1500).select("user_id", "event_id", F.col("running").cast("long").alias("running"))


def island_merge(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("start", F.unix_micros(F.col("recorded_at").cast("timestamp")).cast("long")).withColumn("stop", F.col("start") + (F.col("total_ms") * 60 * 10**6).cast("long"))
    return report.islands(rows.select("user_id", "start", "stop"), "user_id", "start", "stop").drop("island")


def context_cost(spark, sf_dir):
    rows = recalls(spark, sf_dir).withColumn("tokens", F.col("k") * 7 + 20)
    return rows.groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) within group (order by tokens)").alias("p50_tokens"), F.round(F.count_if(F.col("tokens") > 400) / F.count(F.lit(1)), 6).alias("truncated_rate"), F.sum(F.greatest(F.col("tokens") - 400, F.lit(0))).cast("long").alias("dropped_tokens"))


def gate_counts(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("status", F.when(F.col("k") % 4 == 0, "failed").otherwise("passed"))
    return rows.groupBy(F.col("event").alias("gate")).pivot("status", ["passed", "failed"]).agg(F.count(F.lit(1))).join(rows.groupBy(F.col("event").alias("gate")).agg(F.sum(F.col("k") % 3).cast("long").alias("errors")), "gate").select("gate", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("failed", F.lit(0)).alias("failed"), "errors")


QUERIES = {f.__name__: f for f in (event_counts, channel_rollup, latency_distribution, cohort_latency, surface_abstain_rate, latest_row, null_safe_ratio, delivery_funnel, orphan_events, adoption_left_join, asof_pairing, period_over_period, constant_fields, silent_components, session_dedup, session_windows, tumbling_counts, sliding_counts, retention_running_bytes, island_merge, context_cost, gate_counts)}

DIST = ", ".join(f"{P.format(v='total_ms', p=p)} as p{round(p * 100)}" for p in (0.5, 0.95, 0.99))
ORACLES = {
    "event_counts": LOG + "select event, surface, count(*) as n from log group by event, surface",
    "channel_rollup": LOG + "select channel, cast(sum(found) as bigint) as candidates, count(*) filter (where found > 0) as hits from (select 'exact' as channel, k % 4 as found from log union all select 'bm25f', k % 50 from log union all select 'graph', 0 from log) group by channel",
    "latency_distribution": LOG + f"select surface, count(total_ms) as n, {DIST} from recalls group by surface",
    "cohort_latency": LOG + f"select surface, execution, shape, count(*) as attempts, count(*) filter (where abstained) as abstained, round(count(*) filter (where abstained) / cast(count(*) as double), 6) as abstain_rate, {P.format(v='total_ms', p=0.5)} as p50, {P.format(v='total_ms', p=0.95)} as p95 from recalls group by surface, execution, shape",
    "surface_abstain_rate": LOG + "select surface, count(*) as attempts, count(*) filter (where abstained) as abstained, round(count(*) filter (where abstained) / cast(count(*) as double), 6) as abstain_rate from recalls group by grouping sets ((surface), ())",
    "latest_row": LOG + "select user_id, event, n, event_id, total_ms from (select *, count(*) over (partition by user_id, event) as n, row_number() over (partition by user_id, event order by recorded_at desc, event_id desc) as r from log) where r = 1",
    "null_safe_ratio": LOG + "select user_id, clicks, errors, round(clicks / nullif(cast(errors as double), 0), 6) as clicks_per_error from (select user_id, count(*) filter (where event = 'click') as clicks, count(*) filter (where event = 'error' and k > 90) as errors from log group by user_id)",
    "delivery_funnel": LOG + ", e as (select * from recalls where not abstained), d as (select distinct trace_id from e where trace_id in (select trace_id from delivered)), o as (select * from d where trace_id in (select trace_id from consumed)), s as (select (select count(*) from e) as produced, (select count(*) from d) as delivered, (select count(*) from o) as opened) select *, round(delivered / nullif(cast(produced as double), 0), 6) as delivery_rate, round(opened / nullif(cast(delivered as double), 0), 6) as open_rate from s",
    "orphan_events": LOG + "select 'delivery-without-recall' as kind, trace_id, count(*) as n from delivered where trace_id not in (select trace_id from recalls) group by trace_id union all select 'open-without-delivery', trace_id, count(*) from consumed where trace_id not in (select trace_id from delivered) group by trace_id",
    "adoption_left_join": LOG + ", o as (select trace_id, list_distinct(flatten(list(topics))) as opened from consumed group by trace_id), e as (select r.*, o.opened from recalls r left join o on r.trace_id = o.trace_id where not abstained), s as (select count(*) as eligible, count(*) filter (where opened is not null) as consumed, count(*) filter (where opened is not null and list_has_any(returned, opened)) as adopted, count(*) filter (where opened is not null and list_contains(opened, returned[1])) as adopted_top1 from e) select *, round(adopted / nullif(cast(consumed as double), 0), 6) as adoption_rate, round(adopted_top1 / nullif(cast(consumed as double), 0), 6) as top1_rate from s",
    "asof_pairing": LOG + "select open_id, recall_id, case when recall_id is null then null else same end as same_session from (select c.event_id as open_id, r.event_id as recall_id, c.user_id = r.user_id as same, row_number() over (partition by c.event_id order by (c.user_id = r.user_id) desc, r.recorded_at desc, r.event_id desc) as n from consumed c left join recalls r on c.topics[1] = r.topics[1] and r.recorded_at <= c.recorded_at and r.recorded_at >= c.recorded_at - interval 2 hour) where n = 1",
    "period_over_period": LOG + ", w as (select *, case when recorded_at > timestamp '2024-01-22' and recorded_at <= timestamp '2024-01-29' then 'now' when recorded_at > timestamp '2024-01-15' and recorded_at <= timestamp '2024-01-22' then 'before' end as w from log), s as (select event, count(*) filter (where w = 'now') as n_now, count(*) filter (where w = 'before') as n_before, round(avg(total_ms) filter (where w = 'now'), 6) as mean_now, round(avg(total_ms) filter (where w = 'before'), 6) as mean_before from w where w is not null group by event) select *, round((n_now - n_before) / nullif(cast(n_before as double), 0), 6) as growth from s",
    "constant_fields": LOG + ", p as (select event, cast(k as varchar) as k, surface, 'v1' as schema, case when event = 'view' then 'recall' else surface end as component, cast(null as varchar) as note from log), l as (select event, 'k' as field, k as value from p union all select event, 'surface', surface from p union all select event, 'schema', schema from p union all select event, 'component', component from p union all select event, 'note', note from p) select event, field, count(*) as samples, min(value) as value from l group by event, field having count(*) >= 30 and count(distinct value) + max(case when value is null then 1 else 0 end) = 1",
    "silent_components": LOG + ", s as (select distinct surface || '/' || execution as component from log), w as (select unnest(['cli/warm', 'cli/cold', 'hook/warm', 'daemon/warm']) as component) select component, 'silent' as state from w where component not in (select component from s) union all select component, 'unexpected' from s where component not in (select component from w)",
    "session_dedup": LOG + "select user_id, epoch, topic, event_id from (select *, row_number() over (partition by user_id, epoch, topic order by recorded_at, event_id) as n from (select *, cast(date_trunc('week', recorded_at) as timestamp) as epoch, topics[1] as topic from delivered)) where n = 1",
    "session_windows": LOG + ", m as (select *, case when recorded_at - lag(recorded_at) over (partition by user_id order by recorded_at, event_id) > interval 30 minute then 1 else 0 end as fresh from log), s as (select *, cast(sum(fresh) over (partition by user_id order by recorded_at, event_id) + 1 as bigint) as session from m) select user_id, session, min(recorded_at) as start, max(recorded_at) as \"end\", count(*) as n from s group by user_id, session",
    "tumbling_counts": LOG + "select time_bucket(interval 1 day, recorded_at, timestamp '1970-01-01') as start, event, count(*) as n from log group by 1, 2",
    "sliding_counts": LOG + "select start - interval (o) hour as start, event, count(*) as n from (select time_bucket(interval 2 hour, recorded_at, timestamp '1970-01-01') as start, event, unnest([0, 2, 4]) as o from log) group by 1, 2",
    "retention_running_bytes": "select user_id, event_id, running from (select user_id, event_id, cast(sum(strlen(props) + 40) over (partition by user_id order by ts desc, event_id desc rows unbounded preceding) as bigint) as running from events) where running <= 1500",
    "island_merge": LOG + ", s as (select user_id, epoch_us(recorded_at) as start, epoch_us(recorded_at) + cast(trunc(total_ms * 60 * 1000000) as bigint) as stop from log), m as (select *, case when start > max(stop) over (partition by user_id order by start, stop rows between unbounded preceding and 1 preceding) then 1 when row_number() over (partition by user_id order by start, stop) = 1 then 1 else 0 end as fresh from s), g as (select *, sum(fresh) over (partition by user_id order by start, stop rows unbounded preceding) as island from m) select user_id, min(start) as start, max(stop) as \"end\", count(*) as n from g group by user_id, island",
    "context_cost": LOG + ", t as (select *, k * 7 + 20 as tokens from recalls) select surface, count(*) as n, quantile_disc(tokens, 0.5) as p50_tokens, round(count(*) filter (where tokens > 400) / cast(count(*) as double), 6) as truncated_rate, cast(sum(greatest(tokens - 400, 0)) as bigint) as dropped_tokens from t group by surface",
    "gate_counts": LOG + "select event as gate, count(*) filter (where k % 4 <> 0) as passed, count(*) filter (where k % 4 = 0) as failed, cast(sum(k % 3) as bigint) as errors from log group by event",
}
