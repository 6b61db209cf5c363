"""The usage report over the `events` table, read as a typed log: view = recall, click = delivery, purchase = opening, signup =
feedback, error = builds, maintenance and gates by their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import usage
from tessella.session import table

VERSION = "r2"
#: Columns of the log: name, SQL that Spark and DuckDB both take, over event_id, ts, user_id, event_type, value, k.
COLUMNS = {
    "event": "case event_type when 'view' then 'recall.completed' when 'click' then 'recall.delivered' when 'purchase' then 'recall.consumed' when 'signup' then 'feedback.recorded' else case k % 3 when 0 then 'index.build' when 1 then 'maintenance.completed' else 'gate.completed' end end",
    "component": "case k % 7 when 0 then 'old-recall' when 1 then 'memory-recall-previous' when 2 then 'memory-recall-fallback' else 'memory-recall-snapshot' end",
    "version": "case when k % 4 = 0 then 'r1' else 'r2' end",
    "surface": "case k % 5 when 0 then null when 1 then 'stdio' when 2 then 'claude-hook' else 'cli' end",
    "consumption_eligible": "k % 6 <> 0",
    "execution": "case when k % 2 = 1 then 'hot' else 'cold' end",
    "total_ms": "value",
    "abstained": "k % 5 = 0 or k % 11 = 0",
    "abstain_reason": "case when k % 10 = 0 then 'all-candidates-excluded' when k % 5 = 0 then 'below-threshold' end",
    "has_abstain_reason": "k % 11 <> 0",
    "estimated_tokens": "k * 7 + 20",
    "truncated": "k > 80",
    "dropped_topics": "case when k % 3 <> 0 then greatest(k - 90, 0) end",
    "cache_hit": "case when k % 8 = 0 then k % 16 = 0 end",
    "embedding_mode": "case k % 9 when 0 then 'observe' when 1 then 'weighted' end",
    "embedding_ms": "value * 2",
    "embedding_degraded": "case when k % 27 = 0 then 'timeout' when k % 45 = 1 then 'quota' end",
    "authority_followed": "case k % 3 when 0 then true when 1 then false end",
    "verdict": "case k % 3 when 0 then 'correct' when 1 then 'wrong' else 'miss' end",
    "expected_in_top_k": "case when k % 4 <> 0 then k % 2 = 0 end",
    "success": "k % 12 <> 0",
    "fallback": "k % 15 = 0",
    "duration_ms": "value",
    "snapshot_bytes": "k * 1000",
    "proposals": "k % 4",
    "conflicts": "k % 3",
    "orphans": "k % 5",
    "drift": "k % 2",
    "gate": "case when k < 50 then 'schema' else 'quota' end",
    "status": "case when k % 4 = 0 then 'failed' else 'passed' end",
    "errors": "k % 3",
    "warnings": "k % 5",
}


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    topic = lambda m: F.concat(F.lit("t"), (F.col("k") % m).cast("string"))
    shape = F.when(F.col("k") < 30, F.array(F.lit("path"))).when(F.col("k") < 60, F.array(F.lit("natural"))).when(F.col("k") < 80, F.array(F.lit("identifier"), F.lit("mixed"))).otherwise(F.array(F.lit("error")))
    return rows.select(
        "event_id", F.col("ts").alias("recorded_at"), "user_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("trace_id"), *[F.expr(sql).alias(c) for c, sql in COLUMNS.items()],
        shape.alias("query_class"), F.when(F.expr(COLUMNS["abstained"]), F.array().cast("array<string>")).otherwise(F.array(topic(10), topic(7))).alias("returned"), F.array(topic(10)).alias("topics"),
    )


def recalls(spark, sf_dir):
    return usage.of(log(spark, sf_dir), usage.RECALL)


def usage_performance(spark, sf_dir):
    return usage.performance(recalls(spark, sf_dir), "version")


def usage_cohorts(spark, sf_dir):
    return usage.cohorts(recalls(spark, sf_dir).filter(F.col("version") == VERSION))


def usage_by_surface(spark, sf_dir):
    return usage.by_surface(recalls(spark, sf_dir))


def usage_abstain_reasons(spark, sf_dir):
    return usage.abstain_reasons(recalls(spark, sf_dir))


def usage_embedding(spark, sf_dir):
    return usage.embedding(recalls(spark, sf_dir))


def usage_embedding_reasons(spark, sf_dir):
    return usage.embedding_reasons(recalls(spark, sf_dir))


def usage_degradation(spark, sf_dir):
    return usage.degradation(recalls(spark, sf_dir))


def usage_cache(spark, sf_dir):
    return usage.cache(recalls(spark, sf_dir))


def usage_delivery(spark, sf_dir):
    return usage.delivery(log(spark, sf_dir), VERSION)


def usage_adoption(spark, sf_dir):
    return usage.adoption(log(spark, sf_dir))


def usage_context(spark, sf_dir):
    return usage.context(recalls(spark, sf_dir))


def usage_feedback(spark, sf_dir):
    return usage.feedback(log(spark, sf_dir))


def usage_maintenance(spark, sf_dir):
    return usage.maintenance(log(spark, sf_dir))


def usage_gates(spark, sf_dir):
    return usage.gates(log(spark, sf_dir))


def usage_points(spark, sf_dir):
    """The newest 600 recalls (a report's series)."""
    return usage.points(log(spark, sf_dir), VERSION).drop("place", "trace_id")


def usage_gaps(spark, sf_dir):
    return usage.gaps(usage.metrics(log(spark, sf_dir), VERSION, "observe", invalid_events=2))


def usage_recommendations(spark, sf_dir):
    return usage.recommendations(usage.metrics(log(spark, sf_dir), VERSION, "observe"))


def usage_report(spark, sf_dir):
    """The whole report as JSON by part; no SQL twin: every part has one."""
    row = usage.report(log(spark, sf_dir), VERSION, mode="observe")
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.to_json(c).alias("json")) for c in row.columns])).alias("p")).select("p.*")


def query_shapes(spark, sf_dir):
    rows = recalls(spark, sf_dir).select(usage.query_shape(F.col("query_class")).alias("shape"), usage.component_of(F.when(F.col("execution") == "hot", "snapshot"), F.when(F.col("cache_hit"), "previous")).alias("component"))
    return rows.groupBy("shape", "component").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (usage_performance, usage_cohorts, usage_by_surface, usage_abstain_reasons, usage_embedding, usage_embedding_reasons, usage_degradation, usage_cache, usage_delivery, usage_adoption, usage_context, usage_feedback, usage_maintenance, usage_gates, usage_points, usage_gaps, usage_recommendations, usage_report, query_shapes)}

LOG = f"""with log as (select event_id, ts as recorded_at, user_id, cast(user_id as varchar) || '-' || strftime(ts, '%Y%m%d') as trace_id, k, {", ".join(f"{sql} as {c}" for c, sql in COLUMNS.items())},
  case when k < 30 then ['path'] when k < 60 then ['natural'] when k < 80 then ['identifier', 'mixed'] else ['error'] end as query_class, case when {COLUMNS['abstained']} then [] else ['t' || (k % 10), 't' || (k % 7)] end as returned, ['t' || (k % 10)] as topics
  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)),
r as (select * from log where event = 'recall.completed'), d as (select * from log where event = 'recall.delivered'), c as (select * from log where event = 'recall.consumed'),
el as (select * from r where not abstained and len(returned) > 0), cur as (select * from r where version = '{VERSION}')"""
SHARE = "round({a} / nullif(cast({b} as double), 0), 6)"
Q = lambda v, p, f="": f"round(quantile_disc({v}, {p}){f}, 3)"
THREE = lambda v, n="", f="": ", ".join([f"count({v}){f} as {n}samples", *[f"{Q(v, p, f)} as {n}p{round(p * 100)}" for p in (0.5, 0.95, 0.99)]])
HOT, COLD = (f" filter (where execution = '{x}')" for x in ("hot", "cold"))
WORSE = "count(*) filter (where component <> 'memory-recall-snapshot')"
EMBEDDED = ", ".join(f"{Q('embedding_ms', p)} as p{round(p * 100)}" for p in (0.5, 0.95, 0.99))
OBS = "coalesce(consumption_eligible and surface in ('cli', 'claude-hook'), false)"
ATT = "coalesce(abstain_reason, '') <> 'all-candidates-excluded' and (not abstained or has_abstain_reason)"
SHAPE = "case when len(query_class) = 1 and query_class[1] = 'path' then 'pure-path' when len(query_class) = 1 and query_class[1] in ('natural', 'decision') then 'natural-only' when list_contains(query_class, 'mixed') or len(query_class) > 1 then 'mixed' else 'other' end"
DELIVERY = f"""dl as (select el.*, el.trace_id in (select trace_id from d) as sent, o.opened from el left join (select trace_id, list_distinct(flatten(list(topics))) as opened from c group by trace_id) o on o.trace_id = el.trace_id where version = '{VERSION}'),
dv as (select (select count(*) from dl) as produced, (select count(distinct trace_id) from dl where sent) as delivered, (select count(distinct trace_id) from dl where sent and opened is not null) as opened, (select count(*) from dl where sent and list_contains(opened, returned[1])) as top1,
  (select count(*) from d where trace_id not in (select trace_id from r)) as orphan_deliveries, (select count(*) from c where trace_id in (select trace_id from cur) and trace_id not in (select trace_id from dl where sent)) as opened_without_delivery)"""
ADOPTION = f"""us as (select trace_id, list_distinct(flatten(list(topics))) as opened, max(cast(authority_followed as int)) as authority from c group by trace_id), ae as (select el.*, us.opened, us.authority from el left join us on us.trace_id = el.trace_id),
ad as (select count(*) as eligible, count(*) filter (where {OBS}) as observable, count(*) filter (where opened is not null) as consumed, count(*) filter (where opened is not null and {OBS}) as observable_consumed, count(*) filter (where list_has_any(returned, opened)) as adopted, count(*) filter (where list_contains(opened, returned[1])) as top1, count(*) filter (where opened is not null and authority is not null) as authority_observed, count(*) filter (where opened is not null and authority = 1) as authority_followed from ae)"""
CONTEXT = f"""cx as (select count(*) as samples, {Q('estimated_tokens', 0.5)} as p50, {Q('estimated_tokens', 0.95)} as p95, count(*) filter (where truncated) as truncated, {SHARE.format(a='count(*) filter (where truncated)', b='count(*)')} as truncation_rate, count(dropped_topics) as dropped_observed, count(*) filter (where dropped_topics > 0) as dropping, cast(coalesce(sum(dropped_topics), 0) as bigint) as dropped, {SHARE.format(a='count(*) filter (where dropped_topics > 0)', b='count(*)')} as dropping_rate from el where {OBS})"""
SAID = f"""fb as (select count(*) as total, count(*) filter (where verdict = 'correct') as correct, count(*) filter (where verdict = 'wrong') as wrong, count(*) filter (where verdict = 'miss') as miss, {SHARE.format(a="count(*) filter (where verdict <> 'correct')", b='count(*)')} as wrong_miss_rate, {SHARE.format(a='count(*) filter (where expected_in_top_k)', b='count(expected_in_top_k)')} as expected_in_top_k_rate from log where event = 'feedback.recorded')"""
LAST = lambda col, ev: f"(select {col} from log where event = '{ev}' order by recorded_at desc, trace_id desc limit 1)"
KEPT = f"""mt as (select (select count(*) from log where event = 'index.build') as builds, (select count(*) from log where event = 'index.build' and not success) as failed_builds, (select count(*) from log where event = 'index.build' and fallback) as fallback_builds, {LAST('success', 'index.build')} as latest_succeeded, {LAST('fallback', 'index.build')} as latest_used_fallback, {LAST('snapshot_bytes', 'index.build')} as latest_snapshot_bytes, (select {Q('duration_ms', 0.5)} from log where event = 'index.build') as build_p50, (select count(*) from log where event = 'maintenance.completed') as runs, {", ".join(f"{LAST(x, 'maintenance.completed')} as {x}" for x in ('proposals', 'conflicts', 'orphans', 'drift'))})"""
METRICS = f"""ms as (select (select count(*) from r) as recalls, (select count(*) from cur) as current_recalls, (select count(*) from r where abstained and not has_abstain_reason) as unclassified_abstains, (select count(embedding_mode) from r) as embedding_samples, (select count(*) from cur where embedding_mode = 'observe') as state_samples,
  (select count(*) from cur where embedding_mode = 'observe' and embedding_degraded is not null) / nullif((select count(*) from cur where embedding_mode = 'observe')::double, 0) as state_degradation, (select count(*) from r where surface is null and cache_hit is not null) as legacy_cache, (select count(*) from cur where execution = 'hot') as current_hot_samples, (select {Q('total_ms', 0.95)} from cur where execution = 'hot') as current_hot_p95,
  fb.total as feedback, fb.wrong_miss_rate, ad.eligible, ad.observable, ad.consumed, dv.orphan_deliveries, dv.opened_without_delivery, mt.latest_succeeded, mt.latest_used_fallback, mt.orphans, mt.drift, cx.dropping_rate, 'observe' as mode, false as health_failed from fb, ad, dv, mt, cx)"""
ALL = f"{LOG}, {DELIVERY}, {ADOPTION}, {CONTEXT}, {SAID}, {KEPT}, {METRICS}"
ORACLES = {
    "usage_performance": LOG + f" select version, count(*) as recalls, min(recorded_at) as observed_from, max(recorded_at) as observed_to, {THREE('total_ms')}, {THREE('total_ms', 'hot_', HOT)}, {THREE('total_ms', 'cold_', COLD)} from r group by version",
    "usage_cohorts": LOG + f", x as (select *, coalesce(surface, 'unknown') as s, {SHAPE} as shape, coalesce(abstain_reason, '') = 'all-candidates-excluded' as dd from cur) select s as surface, execution, shape, {THREE('total_ms')}, count(*) filter (where not dd) as attempts, count(*) filter (where not dd and abstained) as abstained, {SHARE.format(a='count(*) filter (where not dd and abstained)', b='count(*) filter (where not dd)')} as abstain_rate, count(*) filter (where dd) as deduplicated from x group by s, execution, shape",
    "usage_by_surface": LOG + f", x as (select abstained, coalesce(surface, 'unknown') as surface from r where {ATT}) select surface, count(*) as attempts, count(*) filter (where abstained) as abstained, {SHARE.format(a='count(*) filter (where abstained)', b='count(*)')} as abstain_rate from x group by grouping sets ((surface), ())",
    "usage_abstain_reasons": LOG + " select coalesce(abstain_reason, 'unrecorded') as reason, count(*) as n from r where abstained group by 1",
    "usage_embedding": LOG + f" select embedding_mode, count(*) as samples, count(*) filter (where embedding_degraded is null) as successful, count(embedding_degraded) as degraded, {SHARE.format(a='count(embedding_degraded)', b='count(*)')} as degradation_rate, {EMBEDDED}, max(recorded_at) filter (where embedding_degraded is not null) as last_degraded from r where embedding_mode is not null group by grouping sets ((embedding_mode), ())",
    "usage_embedding_reasons": LOG + " select embedding_degraded as reason, count(*) as n from r where embedding_mode is not null and embedding_degraded is not null group by 1",
    "usage_degradation": LOG + f" select count(*) as observed, count(*) filter (where component = 'memory-recall-snapshot') as snapshot, count(*) filter (where component = 'memory-recall-previous') as previous, count(*) filter (where component = 'memory-recall-fallback') as fallback, {SHARE.format(a=WORSE, b='count(*)')} as rate from r where starts_with(component, 'memory-')",
    "usage_cache": LOG + f" select count(*) as observed, {SHARE.format(a='count(*) filter (where cache_hit)', b='count(*)')} as hit_rate from r where {OBS} and cache_hit is not null",
    "usage_delivery": f"{LOG}, {DELIVERY} select produced, delivered, {SHARE.format(a='delivered', b='produced')} as delivery_rate, opened, {SHARE.format(a='opened', b='delivered')} as open_rate, {SHARE.format(a='top1', b='opened')} as top1_open_share, orphan_deliveries, opened_without_delivery from dv",
    "usage_adoption": f"{LOG}, {ADOPTION} select *, {SHARE.format(a='observable_consumed', b='observable')} as coverage_rate, {SHARE.format(a='adopted', b='consumed')} as adoption_rate, {SHARE.format(a='top1', b='consumed')} as top1_rate, {SHARE.format(a='authority_followed', b='authority_observed')} as authority_rate from ad",
    "usage_context": f"{LOG}, {CONTEXT} select * from cx",
    "usage_feedback": f"{LOG}, {SAID} select * from fb",
    "usage_maintenance": f"{LOG}, {KEPT} select * from mt",
    "usage_gates": LOG + " select gate, count(*) filter (where status = 'passed') as passed, count(*) filter (where status = 'failed') as failed, cast(sum(errors) as bigint) as errors, cast(sum(warnings) as bigint) as warnings from log where event = 'gate.completed' group by gate",
    "usage_points": LOG + " select recorded_at, coalesce(surface, 'unknown') as surface, execution, total_ms, abstained, len(returned) as returned, (select count(*) from cur) > 600 as truncated_series from cur order by recorded_at desc, trace_id desc limit 600",
    "usage_gaps": f"{ALL}, m as (select *, 2 as invalid_events from ms), g as (" + " union all ".join(f"select {i} as o, '{code}' as code from m where coalesce({c}, false)" for i, (code, c) in enumerate(usage.GAPS)) + ") select cast(row_number() over (order by o) as int) as place, code from g",
    "usage_recommendations": f"{ALL}, m as (select *, 0 as invalid_events from ms), g as (" + " union all ".join(f"select '{x[0]}' as code, {x[1]} as priority, '{x[2]}' as impact, '{x[3]}' as cost from m where coalesce({x[4]}, false)" for x in usage.RECOMMENDATIONS) + ") select cast(row_number() over (order by priority desc) as int) as rank, code, priority, impact, cost from g order by priority desc limit 3",
    "query_shapes": LOG + f" select {SHAPE} as shape, case when execution <> 'hot' then 'memory-recall-fallback' when cache_hit then 'memory-recall-previous' else 'memory-recall-snapshot' end as component, count(*) as n from r group by 1, 2",
}
