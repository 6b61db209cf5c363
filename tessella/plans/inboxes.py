"""Inboxes, speech acts, evaluation and governance over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import classify
from tessella.operators import evaluate, governance, usage
from tessella.plans.retrieval import docs_of
from tessella.session import table
from tessella.sources import logs, receipts

#: Lines of inboxes as SQL that Spark and DuckDB both take, over doc_id, toxic and quality of `labels`; some are broken.
FEEDBACK = """case when doc_id % 19 = 0 then '{"schema":' when doc_id % 17 = 0 then '{"schema":"x/v9"}' else concat('{"schema":"recall-feedback/v1","verdict":"', case when doc_id % 13 = 0 then 'maybe' when toxic = 1 then 'wrong' when quality = 0 then 'miss' else 'correct' end, '","query":"', case when doc_id % 11 = 0 then ' ' else concat('q', cast(doc_id % 30 as string)) end, '","returned":', case when doc_id % 23 = 0 then '"a"' when doc_id % 5 = 0 then '[]' else '["a","b"]' end, case when doc_id % 3 = 0 then concat(',"expected":"src', cast(doc_id % 20 as string), '"') else '' end, '}') end"""
BACKFILL = """concat('{"schema":"trigger-backfill-receipt/v1","feedback_line":', case when doc_id % 13 = 0 then '0' when doc_id % 17 = 0 then '"7"' else cast(doc_id % 150 + 1 as string) end, ',"feedback_recorded_at":"2024-01-01T00:00:00.000Z","recorded_at":"', case when doc_id % 11 = 0 then 'soon' else '2024-01-02T00:00:00Z' end, '","target":"', case when doc_id % 23 = 0 then '' else 't' end, '","trigger":"x","query_sha256":"', sha256(cast(doc_id as string)), '"', case when doc_id % 19 = 0 then ',"more":1' else '' end, '}')"""
USAGE = """concat('{"schema":"recall-usage/v1","recordedAt":"', case when doc_id % 13 = 0 then 'never' else '2024-01-02T00:00:00Z' end, '","query_sha256":"', sha256(cast(doc_id as string)), '","abstained":', case when doc_id % 4 = 0 then 'true' else 'false' end, ',"returned":', case when doc_id % 4 = 0 and doc_id % 3 <> 0 then '[]' else '[{"name":"a","score":1.5}]' end, case when doc_id % 17 = 0 then ',"query":"raw"' else '' end, '}')"""


def _lines(spark, sf_dir, sql: str):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("line"), F.expr(sql.replace("sha256(cast(doc_id as string))", "sha2(cast(doc_id as string), 256)")).alias("value"))


def feedback_lines(spark, sf_dir):
    active = docs_of(spark, sf_dir).select(F.col("source").alias("name")).distinct().filter("name not in ('src6', 'src12')")
    return receipts.feedback_inbox(_lines(spark, sf_dir, FEEDBACK), active).withColumn("returned", F.size("returned")).withColumn("returned", F.when(F.col("returned") >= 0, F.col("returned")))


def backfill_lines(spark, sf_dir):
    return receipts.backfill_receipts(_lines(spark, sf_dir, BACKFILL)).select("line", "reject_reason")


def usage_log(spark, sf_dir):
    return receipts.usage_summary(receipts.usage_lines(_lines(spark, sf_dir, USAGE)))


def speech_acts(spark, sf_dir):
    """Every message of the conversations, and a list of messages that each rule takes."""
    said = ["memory report", "please review this", "he said remember the milk", "do you remember the port?", "got it.", "you'd better remember", "remember my password is x", "do not forget the milk", "forget what i said", "for now always use tabs", "today only use port 9", "remember this.", "please remember", "remember we deploy on Fridays", "always do that", "from now on use tabs", "save it in the password manager for later", "where is the port?", "I prefer dark mode"]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    more = spark.createDataFrame([(-1 - i, 0, s) for i, s in enumerate(said)], "conv_id long, turn long, text string")
    return rows.unionByName(more).select("conv_id", "turn", classify.speech_act(F.col("text")).alias("a")).select("conv_id", "turn", "a.action", "a.reason")


def _cases(spark, sf_dir):
    d = F.col("doc_id")
    rank = lambda m: F.when(d % m != 0, (d % 6 + 1 + F.when(d % (m + 4) == 0, 1).otherwise(0)).cast("int"))
    return table(spark, sf_dir, "labels").select(d.alias("case_id"), F.when(F.col("quality") == 1, "golden").otherwise("negative").alias("kind"), F.when(d % 5 == 0, "holdout").otherwise("regression").alias("partition"), rank(7).alias("rank_a"), rank(9).alias("rank_b"), (d % 3 == 0).alias("abstained_a"), (d % 3 != 1).alias("abstained_b"))


def ab_safe(spark, sf_dir):
    return evaluate.ab_safe(_cases(spark, sf_dir))


def negative_changes(spark, sf_dir):
    rows = _cases(spark, sf_dir).filter("kind = 'negative'")
    return evaluate.changes(rows.select("case_id", F.col("abstained_a").alias("abstained")), rows.select("case_id", F.col("abstained_b").alias("abstained")))


def negative_metrics(spark, sf_dir):
    rows = _cases(spark, sf_dir).filter("kind = 'negative'")
    return evaluate.negatives(rows.filter("not abstained_a"), rows, "partition")


def latency_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("value", "event_type", (F.col("user_id") % 4).cast("string").alias("bucket"))
    return evaluate.latencies(rows, "value", "event_type", "bucket")


def report_lookup(spark, sf_dir):
    """The A/B report that a channel's activation looks at, for each model."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), "p_partkey").alias("report_id"), F.lit("p").alias("provider"), F.concat(F.lit("m"), (F.col("p_partkey") % 3).cast("string")).alias("model"), F.when(F.col("p_partkey") % 4 == 0, "r1").otherwise("r2").alias("version"), F.lit("s1").alias("snapshot_id"), F.col("p_size").alias("weight"), (F.col("p_partkey") % 2 == 0).alias("safe"), F.col("p_retailprice").alias("modified"), F.concat(F.lit("f"), "p_partkey").alias("file"))
    out = None
    for m in ("m0", "m1", "m2", "m9"):
        one = evaluate.find_report(part, "p", m, "r2", "s1").select("model", "report_id", "weight", "safe")
        out = one if out is None else out.unionByName(one)
    return out


def golden_coverage(spark, sf_dir):
    topics = docs_of(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), F.array("lang", "source").alias("scopes"))
    return governance.golden_coverage(topics, table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("expected")))


def missing_evidence(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    docs = docs_of(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), F.concat_ws("/", "lang", (F.col("doc_id") % 1000).cast("string")).alias("path"))
    return governance.missing_evidence(docs, pages.select(path.alias("path")))


def broken_links(spark, sf_dir):
    """Links between documents by number, of which those beyond the table are broken."""
    rows = docs_of(spark, sf_dir).select("doc_id", F.concat(F.lit("see [["), (F.col("doc_id") + 3).cast("string"), F.lit("]] and [["), (F.col("doc_id") * 2).cast("string"), F.lit("]]")).alias("body"))
    return governance.broken_links(rows, "doc_id", "body", rows.select(F.col("doc_id").cast("string").alias("name")))


def topic_rules(spark, sf_dir):
    d = F.col("doc_id")
    none = F.array().cast("array<string>")
    rows = docs_of(spark, sf_dir).select(
        "doc_id", d.cast("string").alias("name"), F.when(d % 31 == 0, "x").otherwise(d.cast("string")).alias("file_stem"), F.element_at(F.array(F.lit("lesson"), F.lit("preference"), F.lit("decision-pointer")), (d % 3 + 1).cast("int")).alias("type"), (d % 7 != 0).alias("active"), F.when(d % 29 == 0, "y").alias("retired_by"), F.when(d % 37 == 0, "2024-02-30").otherwise("2024-01-01").alias("last_verified"), F.when(d % 11 == 0, "2023-01-01").alias("expires_at"), F.when(d % 5 == 0, "2023-06-01").alias("review_by"),
        F.when(d % 4 == 0, F.array(F.lit("one"))).otherwise(F.array(F.lit("two words"), F.lit("more words"))).alias("triggers"), F.when(d % 6 == 2, F.array("source")).otherwise(none).alias("authority_docs"), F.when(d % 12 == 2, F.array("source")).when(d % 41 == 0, F.array(F.lit("a b"))).otherwise(none).alias("history_docs"), F.array(F.when(d % 43 == 0, "../x").when(d % 47 == 0, "work-package/x").otherwise("src/a")).alias("evidence_paths"), F.to_date(F.lit("2024-06-01")).alias("as_of"),
    )
    return governance.violations(rows, "doc_id", governance.TOPIC_RULES)


def receipts_bootstrap(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    topics = docs.select(F.col("doc_id").cast("string").alias("name"), F.lit("2025-01-01").alias("review_by"), F.lit("2024-01-01").alias("last_verified"), governance.semantic_digest(F.col("lang"), F.col("text")).alias("content"))
    held = governance.bootstrap_receipts(topics.filter("length(name) = 1"), spark.createDataFrame([], "name string, review_by string, reviewed_on string, content string, source string, reason string, receipt_id string"), "first")
    return governance.bootstrap_receipts(topics, held).select("name", "review_by", "reviewed_on", "source", "reason", F.length("receipt_id").alias("id_length"), F.length("content").alias("content_length"))


def gate_health(spark, sf_dir):
    corpus = docs_of(spark, sf_dir).agg(F.count_if(F.col("n_chars") < 0).alias("schema_errors"), F.count(F.lit(1)).alias("active_topics"), F.sum(F.octet_length("text")).alias("active_bytes"))
    quota = spark.createDataFrame([("quota/v3", 10**9, 10)], "schema string, max_active_l3 long, max_active_bytes long")
    return usage.gate_health(corpus, quota, spark.createDataFrame([("quality/v1",)], "schema string"), ("quota/v2", "quota/v3"), "quality/")


def hmac_ids(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", logs.query_id("k" * 70, F.col("doc_id").cast("string")).alias("query_id"))


QUERIES = {f.__name__: f for f in (feedback_lines, backfill_lines, usage_log, speech_acts, ab_safe, negative_changes, negative_metrics, latency_groups, report_lookup, golden_coverage, missing_evidence, broken_links, topic_rules, receipts_bootstrap, gate_health, hmac_ids)}


def _acts() -> str:
    hit = lambda n: f"regexp_matches({'regexp_replace(t, ' + repr(classify.NOT_SENSITIVE) + ', ' + repr('') + ', ' + repr('g') + ')' if n == 'sensitive' else 't'}, '{classify.ACTS[n].replace(chr(39), chr(39) * 2)}')"
    when = lambda i: "case " + " ".join(f"when {' and '.join(hit(n) for n in a[0].split())} then '{a[i]}'" for a in classify.SPEECH_ACTS) + f" else '{classify.FALLBACK_ACT[i - 1]}' end"
    said = ["memory report", "please review this", "he said remember the milk", "do you remember the port?", "got it.", "you'd better remember", "remember my password is x", "do not forget the milk", "forget what i said", "for now always use tabs", "today only use port 9", "remember this.", "please remember", "remember we deploy on Fridays", "always do that", "from now on use tabs", "save it in the password manager for later", "where is the port?", "I prefer dark mode"]
    more = ", ".join(f"({-1 - i}, 0, '{s.replace(chr(39), chr(39) * 2)}')" for i, s in enumerate(said))
    return f"with m as (select conv_id, turn, trim(lower(coalesce(text, '')), ' ') as t from (select conv_id, turn, text from conversations union all select * from (values {more}) v(conv_id, turn, text))) select conv_id, turn, {when(1)} as action, {when(2)} as reason from m"


_SQL = lambda s: s.replace("as string", "as varchar")
_CASES = "c as (select doc_id as case_id, case when quality = 1 then 'golden' else 'negative' end as kind, case when doc_id % 5 = 0 then 'holdout' else 'regression' end as \"partition\", case when doc_id % 7 <> 0 then doc_id % 6 + 1 + case when doc_id % 11 = 0 then 1 else 0 end end as rank_a, case when doc_id % 9 <> 0 then doc_id % 6 + 1 + case when doc_id % 13 = 0 then 1 else 0 end end as rank_b, doc_id % 3 = 0 as abstained_a, doc_id % 3 <> 1 as abstained_b from labels)"


def _ab() -> str:
    part = {"g": "kind = 'golden' and \"partition\" <> 'holdout'", "h": "kind = 'golden' and \"partition\" = 'holdout'"}
    value = lambda m, s: {"r1": f"case when rank_{s} <= 1 then 1.0 else 0.0 end::double", "r5": f"case when rank_{s} <= 5 then 1.0 else 0.0 end::double", "mrr": f"coalesce(1.0::double / rank_{s}, 0)"}[m]
    each = ", ".join(f"round(coalesce(avg({value(m, s)}) filter (where {part[p]}), 0), 6) as {p}_{m}_{s}" for p in "gh" for m in ("r1", "r5", "mrr") for s in "ab")
    no_worse = lambda p: " and ".join(f"{p}_{m}_b >= {p}_{m}_a" for m in ("r1", "r5", "mrr"))
    return f"""with {_CASES}, x as (select count(*) filter (where {part['g']}) as golden, count(*) filter (where {part['h']}) as holdout, count(*) filter (where kind = 'negative') as negative, {each}, round(avg(cast(abstained_a as int)) filter (where kind = 'negative'), 6) as n_a, round(avg(cast(abstained_b as int)) filter (where kind = 'negative'), 6) as n_b from c),
y as (select golden, holdout, negative, n_b >= n_a as negative_not_worse, {no_worse('g')} as golden_not_worse, {no_worse('h')} as holdout_not_worse from x) select *, negative_not_worse and golden_not_worse and holdout_not_worse as safe from y"""


def _hmac() -> str:
    """HMAC by its definition over hex, for a key beyond a block: the key is its own digest."""
    import hashlib

    raw = hashlib.sha256(b"k" * 70).digest().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()
    return f"select doc_id, sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode(cast(doc_id as varchar))))) as query_id from labels"


ORACLES = {
    "feedback_lines": f"""with l as (select doc_id as line, {_SQL(FEEDBACK)} as value from labels), j as (select line, case when json_valid(value) then value end as v from l), p as (select line, v, json_extract_string(v, '$.schema') as s, json_extract_string(v, '$.verdict') as verdict, json_extract_string(v, '$.query') as query, nullif(json_extract_string(v, '$.expected'), '') as expected, json_type(v, '$.returned') as rt, json_array_length(v, '$.returned') as n from j),
c as (select *, case when v is null then 'invalid-json' when coalesce(s, '') <> 'recall-feedback/v1' then 'unsupported-schema' when coalesce(verdict, '') not in ('correct', 'wrong', 'miss') then 'invalid-verdict' when trim(coalesce(query, '')) = '' then 'empty-query' when coalesce(rt, '') <> 'ARRAY' then 'invalid-returned' when verdict <> 'correct' and expected is null then 'missing-expected' when expected is not null and expected not in (select source from documents where source not in ('src6', 'src12')) then 'inactive-expected' end as reject_reason from p)
select line, query, verdict, expected, case when rt = 'ARRAY' then cast(n as int) end as returned, reject_reason, reject_reason is null and row_number() over (partition by query, verdict, expected, reject_reason is null order by line) > 1 as duplicate from c""",
    "backfill_lines": f"""with l as (select doc_id as line, {_SQL(BACKFILL)} as v from labels), p as (select line, list_sort(json_keys(v)) as keys, json_type(v, '$.feedback_line') as t, json_extract_string(v, '$.feedback_line') as n, json_extract_string(v, '$.recorded_at') as at_, json_extract_string(v, '$.target') as target from l),
c as (select line, n, case when len(keys) <> 7 then 'wrong-keys' when t = 'VARCHAR' or n = '0' then 'invalid-line' when at_ = 'soon' or target = '' then 'invalid-fields' end as r from p) select line, case when r is null and row_number() over (partition by n, r is null order by line) > 1 then 'duplicate-receipt' else r end as reject_reason from c""",
    "usage_log": "with c as (select doc_id % 4 = 0 as abstained, doc_id % 13 <> 0 and doc_id % 17 <> 0 and (doc_id % 4 = 0) = (doc_id % 4 = 0 and doc_id % 3 <> 0) as valid from labels) select count(*) filter (where valid) as total, count(*) filter (where valid and abstained) as abstained, count(*) filter (where valid and not abstained) as with_hits, count(*) filter (where not valid) as invalid, round(count(*) filter (where valid and abstained) / cast(count(*) filter (where valid) as double), 6) as abstain_rate from c",
    "speech_acts": _acts(),
    "ab_safe": _ab(),
    "negative_changes": f"with {_CASES} select case_id, abstained_a, abstained_b, case when abstained_a = abstained_b then 'unchanged' when abstained_b then 'improved' else 'regressed' end as change from c where kind = 'negative'",
    "negative_metrics": f"with {_CASES} select \"partition\", count(*) as cases, count(*) filter (where abstained_a) as abstained, round(avg(cast(abstained_a as int)), 6) as abstain_rate from c where kind = 'negative' group by grouping sets ((\"partition\"), ())",
    "latency_groups": "with s as (select value, event_type, cast(user_id % 4 as varchar) as bucket from events) select case when grouping(event_type) = 0 then 'event_type' when grouping(bucket) = 0 then 'bucket' else 'all' end as metric, coalesce(event_type, bucket) as name, count(value) as n, round(quantile_disc(value, 0.5), 3) as p50, round(quantile_disc(value, 0.95), 3) as p95 from s group by grouping sets ((), (event_type), (bucket))",
    "report_lookup": "with p as (select 'r' || p_partkey as report_id, 'm' || (p_partkey % 3) as model, p_size as weight, p_partkey % 2 = 0 as safe, p_retailprice as modified, 'f' || p_partkey as file from part where p_partkey % 4 <> 0), b as (select * from (select *, row_number() over (partition by model order by modified desc, file) as n from p) where n = 1), x as (select p.* from p join b on b.model = p.model and b.safe and p.weight = b.weight and p.report_id <> b.report_id and not p.safe), y as (select * from (select *, row_number() over (partition by model order by modified desc, file) as n from x) where n = 1) select coalesce(y.model, b.model) as model, coalesce(y.report_id, b.report_id) as report_id, coalesce(y.weight, b.weight) as weight, coalesce(y.safe, b.safe) as safe from b left join y on y.model = b.model",
    "golden_coverage": "with t as (select doc_id, lang, source, doc_id in (select doc_id from labels where quality = 1) as hit from documents), e as (select unnest([lang, source]) as scope, hit from t), a as (select cast(null as varchar) as scope, count(*) as topics, count(*) filter (where hit) as evaluated from t union all select scope, count(*), count(*) filter (where hit) from e group by scope) select *, round(evaluated / cast(topics as double), 6) as coverage from a",
    "missing_evidence": "with d as (select distinct cast(doc_id as varchar) as name, lang || '/' || (doc_id % 1000) as path from documents) select name, path from d where path not in (select regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) from pages)",
    "broken_links": "with l as (select doc_id, unnest([cast(doc_id + 3 as varchar), cast(doc_id * 2 as varchar)]) as target from documents) select distinct doc_id, target from l where target not in (select cast(doc_id as varchar) from documents)",
    "topic_rules": """with t as (select doc_id, doc_id % 31 = 0 as r1, doc_id % 37 = 0 as r2, doc_id % 7 <> 0 as act, doc_id % 11 = 0 as ex, doc_id % 5 = 0 as rv, doc_id % 3 as ty, doc_id % 29 = 0 as re, doc_id % 4 = 0 as one, doc_id % 6 = 2 as au, doc_id % 12 = 2 as hi, doc_id % 41 = 0 as bad, doc_id % 43 = 0 as up, doc_id % 47 = 0 as wp from documents)
select doc_id, 'error' as level, 'name-file-mismatch' as code from t where r1 union all select doc_id, 'error', 'invalid-date' from t where r2 union all select doc_id, 'error', 'expired-topic' from t where act and ex union all select doc_id, 'error', 'review-overdue' from t where act and rv union all select doc_id, 'warning', 'unneeded-review-date' from t where rv and ty <> 1
union all select doc_id, 'error', 'retired-active' from t where act and re union all select doc_id, 'error', 'decision-without-document' from t where ty = 2 and not au union all select doc_id, 'warning', 'natural-triggers-too-few' from t where one union all select doc_id, 'warning', 'natural-triggers-identifiers-only' from t where one
union all select doc_id, 'error', 'invalid-doc-id' from t where bad and not hi union all select doc_id, 'error', 'conflicting-doc-role' from t where au and hi union all select doc_id, 'error', 'unsafe-evidence-path' from t where up union all select doc_id, 'error', 'work-package-reference' from t where wp and not up""",
    "receipts_bootstrap": "select cast(doc_id as varchar) as name, '2025-01-01' as review_by, '2024-01-01' as reviewed_on, 'baseline' as source, case when doc_id < 10 then 'first' else 'baseline of a migration; no new confirmation' end as reason, 24 as id_length, 64 as content_length from documents",
    "gate_health": "select 'schema' as gate, (select count(*) from documents where n_chars < 0) = 0 as healthy union all select 'quota', (select sum(strlen(text)) from documents) <= 10 union all select 'quality_lock', true",
    "hmac_ids": _hmac(),
}
