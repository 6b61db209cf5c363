"""The usage report over a typed event log.

The log has one row per event and a column for each payload field (null where the event has none): event, recorded_at,
trace_id, component, version; of recalls surface, consumption_eligible, query_class, execution, total_ms, channels,
abstained, abstain_reason, has_abstain_reason (the key is present), returned, estimated_tokens, truncated, dropped_topics,
cache_hit, embedding_mode (null: inactive), embedding_ms, embedding_degraded; of deliveries and openings topics,
authority_followed (null: not observable), via; of feedback verdict, expected_in_top_k; of builds success, fallback,
duration_ms, snapshot_bytes; of maintenance proposals, conflicts, orphans, drift; of gates gate, status, errors, warnings.

Ratios over nothing are null. `version` names the current runtime; other versions count as history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.math import percentile, ratio

#: Events, components by degradation, surfaces whose use can be observed, the reason of deduplicated recalls.
RECALL, DELIVERED, CONSUMED, FEEDBACK, BUILD, MAINTENANCE, GATE = "recall.completed", "recall.delivered", "recall.consumed", "feedback.recorded", "index.build", "maintenance.completed", "gate.completed"
COMPONENTS = ("memory-recall-snapshot", "memory-recall-previous", "memory-recall-fallback")
OBSERVABLE = ("cli", "claude-hook")
EXCLUDED = "all-candidates-excluded"
#: Fixed value: fewer samples than this say nothing.
SMALL = 20


def component_of(mode: Column, status: Column) -> Column:
    """Which level of degradation answered: anything but a snapshot is the fallback, a previous one is named so."""
    return F.when(F.coalesce(mode != "snapshot", F.lit(True)), COMPONENTS[2]).when(status == "previous", COMPONENTS[1]).otherwise(COMPONENTS[0])


def query_shape(classes: Column) -> Column:
    """pure-path, natural-only, mixed or other."""
    one = F.size(classes) == 1
    return F.when(one & (classes[0] == "path"), "pure-path").when(one & classes[0].isin("natural", "decision"), "natural-only").when(F.array_contains(classes, "mixed") | (F.size(classes) > 1), "mixed").otherwise("other")


def of(log: DataFrame, event: str) -> DataFrame:
    return log.filter(F.col("event") == event)


def is_eligible() -> Column:
    """A recall that returned something."""
    return ~F.col("abstained") & (F.size("returned") > 0)


def is_observable() -> Column:
    """Its producer can tell whether it is used."""
    return F.coalesce(F.col("consumption_eligible") & F.col("surface").isin(*OBSERVABLE), F.lit(False))


def is_attempt() -> Column:
    """A retrieval: not one that session deduplication emptied, and no abstention of an old producer without a reason."""
    return ~F.coalesce(F.col("abstain_reason") == EXCLUDED, F.lit(False)) & (~F.col("abstained") | F.col("has_abstain_reason"))


def in_order(log: DataFrame) -> DataFrame:
    """The log's total order."""
    return log.orderBy("recorded_at", "trace_id", "event")


def _three(value: str, only: str | None = None) -> list[Column]:
    """Samples and nearest-rank percentiles of a column, of the rows that meet a condition."""
    name = "" if only is None else f"{only}_"
    chosen = value if only is None else f"case when execution = '{only}' then {value} end"
    return [F.count(F.expr(chosen)).alias(f"{name}samples"), *[percentile(chosen, p).alias(f"{name}p{round(p * 100)}") for p in (0.5, 0.95, 0.99)]]


def performance(recalls: DataFrame, *keys: str) -> DataFrame:
    """When and how many, and latency in all and of hot and cold recalls."""
    return recalls.groupBy(*keys).agg(F.count(F.lit(1)).alias("recalls"), F.min("recorded_at").alias("observed_from"), F.max("recorded_at").alias("observed_to"), *_three("total_ms"), *_three("total_ms", "hot"), *_three("total_ms", "cold"))


def cohorts(recalls: DataFrame) -> DataFrame:
    """By surface, execution and query shape: latency, attempts, abstentions and deduplicated recalls."""
    rows = recalls.withColumn("surface", F.coalesce("surface", F.lit("unknown"))).withColumn("shape", query_shape(F.col("query_class")))
    dedup = F.coalesce(F.col("abstain_reason") == EXCLUDED, F.lit(False))
    attempts, abstained = F.count_if(~dedup), F.count_if(~dedup & F.col("abstained"))
    return rows.groupBy("surface", "execution", "shape").agg(*_three("total_ms"), attempts.alias("attempts"), abstained.alias("abstained"), F.round(ratio(abstained, attempts), 6).alias("abstain_rate"), F.count_if(dedup).alias("deduplicated"))


def by_surface(recalls: DataFrame) -> DataFrame:
    """Attempts and abstentions by surface, and blended (surface null): the blend alone hides the split that matters."""
    rows = recalls.filter(is_attempt()).withColumn("surface", F.coalesce("surface", F.lit("unknown")))
    n, k = F.count(F.lit(1)), F.count_if("abstained")
    return rows.groupingSets([["surface"], []], "surface").agg(n.alias("attempts"), k.alias("abstained"), F.round(ratio(k, n), 6).alias("abstain_rate"))


def abstain_reasons(recalls: DataFrame) -> DataFrame:
    return recalls.filter("abstained").groupBy(F.coalesce("abstain_reason", F.lit("unrecorded")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def embedding(recalls: DataFrame) -> DataFrame:
    """Reliability of the embedding channel by mode and in all (mode null), with the last degradation."""
    rows = recalls.filter("embedding_mode is not null")
    bad = F.col("embedding_degraded").isNotNull()
    n, k = F.count(F.lit(1)), F.count_if(bad)
    return rows.groupingSets([["embedding_mode"], []], "embedding_mode").agg(n.alias("samples"), F.count_if(~bad).alias("successful"), k.alias("degraded"), F.round(ratio(k, n), 6).alias("degradation_rate"), *[percentile("embedding_ms", p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)], F.max(F.when(bad, F.col("recorded_at"))).alias("last_degraded"))


def embedding_reasons(recalls: DataFrame) -> DataFrame:
    return recalls.filter("embedding_mode is not null and embedding_degraded is not null").groupBy(F.col("embedding_degraded").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def degradation(recalls: DataFrame) -> DataFrame:
    """How many recalls the current snapshot, the previous one and the fallback answered; old producers do not say."""
    rows = recalls.filter(F.col("component").isin(*COMPONENTS))
    each = [F.count_if(F.col("component") == c) for c in COMPONENTS]
    n = F.count(F.lit(1))
    return rows.agg(n.alias("observed"), *[c.alias(x.rsplit("-", 1)[1]) for c, x in zip(each, COMPONENTS, strict=True)], F.round(ratio(each[1] + each[2], n), 6).alias("rate"))


def cache(recalls: DataFrame) -> DataFrame:
    """Cache hits where they can be observed."""
    rows = recalls.filter(is_observable() & F.col("cache_hit").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("observed"), F.round(ratio(F.count_if("cache_hit"), F.count(F.lit(1))), 6).alias("hit_rate"))


def _one_row(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # each has one row
    return out


def delivery(log: DataFrame, version: str) -> DataFrame:
    """The funnel of the current runtime: recalls that returned something, distinct traces of them that were delivered and
    opened, how often the first topic was opened; and events that fit nowhere."""
    recalls = of(log, RECALL)
    current = recalls.filter(F.col("version") == version)
    produced = current.filter(is_eligible())
    sent = of(log, DELIVERED).select("trace_id").distinct()
    opened = of(log, CONSUMED).groupBy("trace_id").agg(F.array_distinct(F.flatten(F.collect_list("topics"))).alias("opened"), F.count(F.lit(1)).alias("opens"))
    rows = produced.join(sent.withColumn("sent", F.lit(True)), "trace_id", "left").join(opened, "trace_id", "left")
    first = F.col("sent") & F.col("opened").isNotNull() & F.array_contains("opened", F.col("returned")[0])
    funnel = rows.agg(F.count(F.lit(1)).alias("produced"), F.count_distinct(F.when(F.col("sent"), F.col("trace_id"))).alias("delivered"), F.count_distinct(F.when(F.col("sent") & F.col("opened").isNotNull(), F.col("trace_id"))).alias("opened"), F.count_if(first).alias("top1"))
    orphans = of(log, DELIVERED).join(recalls.select("trace_id").distinct(), "trace_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_deliveries"))
    reached = rows.filter("sent").select("trace_id").distinct()
    early = of(log, CONSUMED).join(current.select("trace_id").distinct(), "trace_id", "left_semi").join(reached, "trace_id", "left_anti").agg(F.count(F.lit(1)).alias("opened_without_delivery"))
    out = _one_row(funnel, orphans, early)
    share = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 6)
    return out.select("produced", "delivered", share("delivered", "produced").alias("delivery_rate"), "opened", share("opened", "delivered").alias("open_rate"), share("top1", "opened").alias("top1_open_share"), "orphan_deliveries", "opened_without_delivery")


def adoption(log: DataFrame) -> DataFrame:
    """Of all recalls that returned something: which were opened, at what place, and whether authority was followed. The
    last has three states: traces whose producer cannot observe it are in no denominator."""
    authority = F.max(F.when(F.col("authority_followed").isNotNull(), F.col("authority_followed").cast("int")))
    used = of(log, CONSUMED).groupBy("trace_id").agg(F.array_distinct(F.flatten(F.collect_list("topics"))).alias("opened"), authority.alias("authority"))
    rows = of(log, RECALL).filter(is_eligible()).join(used, "trace_id", "left")
    hit = F.col("opened").isNotNull()
    n = F.count_if
    out = rows.agg(F.count(F.lit(1)).alias("eligible"), n(is_observable()).alias("observable"), n(hit).alias("consumed"), n(hit & is_observable()).alias("observable_consumed"), n(hit & F.arrays_overlap("returned", "opened")).alias("adopted"), n(hit & F.array_contains("opened", F.col("returned")[0])).alias("top1"), n(hit & F.col("authority").isNotNull()).alias("authority_observed"), n(hit & (F.col("authority") == 1)).alias("authority_followed"))
    share = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 6)
    return out.select("*", share("observable_consumed", "observable").alias("coverage_rate"), share("adopted", "consumed").alias("adoption_rate"), share("top1", "consumed").alias("top1_rate"), share("authority_followed", "authority_observed").alias("authority_rate"))


def context(recalls: DataFrame) -> DataFrame:
    """What answers cost: tokens, truncation, and whole topics that did not fit (where the producer tells)."""
    rows = recalls.filter(is_eligible() & is_observable())
    dropping = F.count_if(F.col("dropped_topics") > 0)
    return rows.agg(F.count(F.lit(1)).alias("samples"), percentile("estimated_tokens", 0.5).alias("p50"), percentile("estimated_tokens", 0.95).alias("p95"), F.count_if("truncated").alias("truncated"), F.round(ratio(F.count_if("truncated"), F.count(F.lit(1))), 6).alias("truncation_rate"), F.count("dropped_topics").alias("dropped_observed"), dropping.alias("dropping"), F.coalesce(F.sum("dropped_topics"), F.lit(0)).cast("long").alias("dropped"), F.round(ratio(dropping, F.count(F.lit(1))), 6).alias("dropping_rate"))


def feedback(log: DataFrame) -> DataFrame:
    """Verdicts, the share of wrong and missed, and whether what was expected stood among the results."""
    rows = of(log, FEEDBACK)
    bad, n = F.count_if(F.col("verdict").isin("wrong", "miss")), F.count(F.lit(1))
    return rows.agg(n.alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("correct", "wrong", "miss")], F.round(ratio(bad, n), 6).alias("wrong_miss_rate"), F.round(ratio(F.count_if("expected_in_top_k"), F.count("expected_in_top_k")), 6).alias("expected_in_top_k_rate"))


def maintenance(log: DataFrame) -> DataFrame:
    """Builds of the window and the state after the last; the backlog of the last run, null if there was none."""
    last = lambda c, at: F.max_by(c, at)
    at = F.struct("recorded_at", "trace_id")
    builds = of(log, BUILD).agg(F.count(F.lit(1)).alias("builds"), F.count_if(~F.col("success")).alias("failed_builds"), F.count_if("fallback").alias("fallback_builds"), last("success", at).alias("latest_succeeded"), last("fallback", at).alias("latest_used_fallback"), last("snapshot_bytes", at).alias("latest_snapshot_bytes"), percentile("duration_ms", 0.5).alias("build_p50"))
    runs = of(log, MAINTENANCE).agg(F.count(F.lit(1)).alias("runs"), *[last(c, at).alias(c) for c in ("proposals", "conflicts", "orphans", "drift")])
    return _one_row(builds, runs)


def gates(log: DataFrame) -> DataFrame:
    rows = of(log, GATE)
    return rows.groupBy("gate").agg(F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("errors").cast("long").alias("errors"), F.sum("warnings").cast("long").alias("warnings"))


def points(log: DataFrame, version: str, most: int = 600) -> DataFrame:
    """The newest recalls of the current runtime as a series, with their place from the newest and whether some are left
    out. The limit is applied before the shuffle."""
    rows = of(log, RECALL).filter(F.col("version") == version)
    cut = rows.orderBy(F.desc("recorded_at"), F.desc("trace_id")).limit(most + 1)
    order = Window.orderBy(F.desc("recorded_at"), F.desc("trace_id"))  # most + 1 rows
    out = cut.withColumn("place", F.row_number().over(order)).withColumn("truncated_series", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > most)
    return out.filter(F.col("place") <= most).select("place", "trace_id", "recorded_at", F.coalesce("surface", F.lit("unknown")).alias("surface"), "execution", "total_ms", "abstained", F.size("returned").alias("returned"), "truncated_series")


#: Gap codes in their order, and when they hold over metrics(). An unset mode is no mode.
GAPS = (
    ("no-recall-events", "recalls = 0"),
    ("few-recall-samples", f"recalls > 0 and recalls < {SMALL}"),
    ("no-consumed", "eligible > 0 and consumed = 0"),
    ("legacy-unpairable", "eligible > observable"),
    ("legacy-abstain-no-reason", "unclassified_abstains > 0"),
    ("no-current-stack-samples", "current_recalls = 0"),
    ("orphan-deliveries", "orphan_deliveries > 0"),
    ("consumed-without-delivery", "opened_without_delivery > 0"),
    ("no-feedback", "feedback = 0"),
    ("few-embedding-samples", f"embedding_samples > 0 and embedding_samples < {SMALL}"),
    ("few-embedding-state-samples", f"mode in ('observe', 'weighted') and state_samples < {SMALL}"),
    ("legacy-cache-placeholder", "legacy_cache > 0"),
    ("invalid-events", "invalid_events > 0"),
    ("health-read-failed", "health_failed"),
)
#: Recommendations with priority, impact and cost, and when they hold over metrics().
RECOMMENDATIONS = (
    ("fix-invalid-events", 100, "high", "low", "invalid_events > 0"),
    ("fix-builds", 95, "high", "medium", "not latest_succeeded or latest_used_fallback"),
    ("clear-maintenance", 85, "high", "medium", "orphans > 0 or drift > 0"),
    ("profile-hot-path", 75, "high", "medium", f"current_hot_samples >= {SMALL} and current_hot_p95 > 20"),
    ("check-provider-latency", 73, "high", "low", f"state_samples >= {SMALL} and state_degradation > 0.2"),
    ("review-feedback", 70, "high", "medium", "feedback > 0 and wrong_miss_rate > 0.1"),
    ("review-budget-tier", 60, "medium", "medium", "dropping_rate > 0.05"),
)
KEEP_COLLECTING = ("keep-collecting", 10, "unknown", "low", f"recalls < {SMALL}")


def metrics(log: DataFrame, version: str, mode: str | None = None, invalid_events: int = 0, health_failed: bool = False) -> DataFrame:
    """The one row that gaps and recommendations look at. `mode`: the embedding's current mode."""
    recalls = of(log, RECALL)
    now = F.col("version") == version
    state = now & (F.col("embedding_mode") == F.lit(mode))
    bad = state & F.col("embedding_degraded").isNotNull()
    counts = recalls.agg(
        F.count(F.lit(1)).alias("recalls"), F.count_if(now).alias("current_recalls"), F.count_if(F.col("abstained") & ~F.col("has_abstain_reason")).alias("unclassified_abstains"), F.count("embedding_mode").alias("embedding_samples"), F.count_if(F.coalesce(state, F.lit(False))).alias("state_samples"),
        ratio(F.count_if(F.coalesce(bad, F.lit(False))), F.count_if(F.coalesce(state, F.lit(False)))).alias("state_degradation"), F.count_if(F.col("surface").isNull() & F.col("cache_hit").isNotNull()).alias("legacy_cache"),
        F.count_if(now & (F.col("execution") == "hot")).alias("current_hot_samples"), percentile(f"case when version = '{version}' and execution = 'hot' then total_ms end", 0.95).alias("current_hot_p95"),
    )
    said = feedback(log).select(F.col("total").alias("feedback"), "wrong_miss_rate")
    used = adoption(log).select("eligible", "observable", "consumed")
    sent = delivery(log, version).select("orphan_deliveries", "opened_without_delivery")
    kept = maintenance(log).select("latest_succeeded", "latest_used_fallback", "orphans", "drift")
    cost = context(recalls).select("dropping_rate")
    return _one_row(counts, said, used, sent, kept, cost).withColumns({"mode": F.lit(mode).cast("string"), "invalid_events": F.lit(invalid_events), "health_failed": F.lit(health_failed)})


def gaps(found: DataFrame) -> DataFrame:
    """(place, code) of what the data cannot tell."""
    hit = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(code)) for code, c in GAPS]))
    return found.select(F.posexplode(hit).alias("place", "code")).select((F.col("place") + 1).alias("place"), "code")


def recommendations(found: DataFrame, most: int = 3) -> DataFrame:
    """(rank, code, priority, impact, cost): the most urgent; collecting goes on only where nothing else is to be done."""
    row = lambda r: F.struct(F.lit(r[1]).alias("priority"), F.lit(r[0]).alias("code"), F.lit(r[2]).alias("impact"), F.lit(r[3]).alias("cost"))
    hit = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(r[4]), F.lit(False)), row(r)) for r in RECOMMENDATIONS]))
    none = F.array_compact(F.array(F.when(F.expr(KEEP_COLLECTING[4]), row(KEEP_COLLECTING))))
    chosen = F.slice(F.sort_array(F.when(F.size(hit) > 0, hit).otherwise(none), asc=False), 1, most)
    return found.select(F.posexplode(chosen).alias("rank", "x")).select((F.col("rank") + 1).alias("rank"), "x.code", "x.priority", "x.impact", "x.cost")


def gate_health(corpus: DataFrame, quota: DataFrame, quality: DataFrame, quota_schemas: tuple[str, ...], quality_prefix: str) -> DataFrame:
    """(gate, healthy) of the static gates: no schema error (corpus: schema_errors, active_topics, active_bytes), a quota lock
    (schema, max_active_l3, max_active_bytes) of a known schema that the corpus keeps to, and a quality lock (schema). A
    missing lock (no row) is not healthy."""
    q = quota.agg(F.max("schema").alias("qs"), F.max("max_active_l3").alias("most"), F.max("max_active_bytes").alias("bytes"))
    one = _one_row(corpus, q, quality.agg(F.max("schema").alias("ls")))
    schema = F.col("schema_errors") == 0
    fits = F.col("qs").isin(*quota_schemas) & (F.col("active_topics") <= F.col("most")) & (F.col("active_bytes") <= F.col("bytes"))
    named = F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("healthy")) for n, c in (("schema", schema), ("quota", fits), ("quality_lock", F.startswith("ls", F.lit(quality_prefix))))])
    return one.select(F.explode(named).alias("g")).select("g.*")


def report(log: DataFrame, version: str, **options) -> DataFrame:
    """The whole report as one row of nested parts."""
    recalls = of(log, RECALL)
    found = metrics(log, version, **options)
    rows = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    one = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    parts = [
        rows(log.groupBy("event").agg(F.count(F.lit(1)).alias("n")), "samples"), one(delivery(log, version), "delivery"), one(adoption(log), "adoption"), one(performance(recalls), "performance"), one(performance(recalls.filter(F.col("version") == version)), "current_performance"),
        rows(cohorts(recalls.filter(F.col("version") == version)), "cohorts"), rows(by_surface(recalls), "retrieval"), rows(abstain_reasons(recalls), "abstain_reasons"), one(degradation(recalls), "snapshot_degradation"), one(cache(recalls), "cache"), rows(embedding(recalls), "embedding"),
        one(context(recalls), "context"), one(feedback(log), "feedback"), one(maintenance(log), "maintenance"), rows(gates(log), "gates"), rows(gaps(found), "gaps"), rows(recommendations(found), "recommendations"),
    ]
    return _one_row(*parts)


def formatted(row) -> str:
    """A report row as indented lines."""
    out = []
    for name, value in row.asDict(True).items():
        out.append(f"{name}:")
        for item in value if isinstance(value, list) else [value]:
            out.append("  " + ", ".join(f"{k}={'-' if v is None else v}" for k, v in item.items()))
    return "\n".join(out)
