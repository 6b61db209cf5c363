"""Audit, feedback, health and incremental maintenance over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import governance, incremental
from tessella.session import table


def feedback_review(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents")
    rows = labels.join(docs, "doc_id", "left").select(F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 11 == 0, F.lit(" ")).otherwise(F.col("lang")).alias("query"), F.when(F.col("toxic") == 1, "wrong").when(F.col("quality") == 0, "miss").when(F.col("doc_id") % 13 == 0, "maybe").otherwise("correct").alias("verdict"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("expected"))
    active = docs.select(F.col("source").alias("name")).distinct().filter("name not in ('src7', 'src11')")
    checked = governance.feedback(rows, active, labels.filter("toxic = 1 and quality = 1").select(F.col("doc_id").alias("line")))
    return checked.select("line", "verdict", "expected", "reject_reason", "duplicate", "resolved")


def feedback_summary(spark, sf_dir):
    return governance.feedback_summary(feedback_review(spark, sf_dir))


def audit_routing(spark, sf_dir):
    """Every document is active and routed, some under another name, some twice."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    named = lambda m, tail: F.when(d % m == 0, F.concat(d.cast("string"), F.lit(tail))).otherwise(d.cast("string"))
    routes = docs.select(F.explode(F.array(named(7, "r"), F.when(d % 10 == 0, named(7, "r")).otherwise(F.concat(F.lit("x"), d.cast("string"))))).alias("name"))
    return governance.routing(docs.select(named(3, "a").alias("name")), routes)


TEXT_RULES = (
    governance.Rule("error", "topic-bytes", "octet_length(text) > 16384"),
    governance.Rule("error", "topic-empty", "length(trim(text)) = 0"),
    governance.Rule("warning", "too-few-words", "n_chars < 40"),
    governance.Rule("error", "license-line", "text like '%License%'"),
    governance.Rule("warning", "odd-language", "lang not in ('en', 'de')"),
)


def audit_rules(spark, sf_dir):
    return governance.violations(table(spark, sf_dir, "documents"), "doc_id", TEXT_RULES)


def audit_status(spark, sf_dir):
    return governance.audit_status(audit_rules(spark, sf_dir))


def quota_check(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    base = table(spark, sf_dir, "documents").filter("lang = 'en'").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("allowed"))
    return governance.quota(groups, base.filter("name <> 'src3'"), 30)


def upcoming_reviews(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("due"))
    return governance.upcoming_reviews(rows, "due", F.to_date(F.lit("1997-01-01")))


def review_states(spark, sf_dir):
    """Every document is a topic and has a receipt, some under another id, some of other content or date."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    topics = docs.select((d + F.when(d % 5 == 0, 10**9).otherwise(0)).alias("name"), F.sha2("text", 256).alias("content"), F.col("lang").alias("review_by"))
    receipts = docs.select((d + F.when(d % 4 == 0, 2 * 10**9).otherwise(0)).alias("name"), F.when(d % 3 == 0, "old").otherwise(F.sha2("text", 256)).alias("content"), F.when(d % 7 == 0, "xx").otherwise(F.col("lang")).alias("review_by"))
    return governance.review_state(topics, receipts)


def corpus_health(spark, sf_dir):
    return governance.health(table(spark, sf_dir, "documents").withColumn("size", F.octet_length("text")), "doc_id", "lang", "source", "size")


def source_diff(spark, sf_dir):
    """Every document before and after; some were moved, some edited."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), d)
    path = lambda m, folder: F.concat(F.when(d % m == 0, folder).otherwise("docs/"), d.cast("string")).alias("path")
    old = docs.select(path(9, "old/"), F.when(d % 8 == 0, "x").otherwise(F.col("sha")).alias("sha"))
    return incremental.source_diff(old, docs.select(path(14, "new/"), "sha"))


def _depends(spark, sf_dir):
    """part -> supplier -> nation -> region: what depends on what."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("id"), F.concat(F.lit("s"), "l_suppkey").alias("on"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("on"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("on"))
    return li.unionByName(s).unionByName(n).distinct()


def recursive_invalidation(spark, sf_dir):
    return incremental.closure(spark.createDataFrame([("r2",), ("s1",)], "id string"), _depends(spark, sf_dir))


def compile_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", incremental.digest(F.lit("compiler-1"), F.col("text"), F.col("lang"), F.col("source")).alias("digest"))


def compile_plan(spark, sf_dir):
    """Every document before and now; some were renamed, some edited, and those of one source depend on what changed."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(d, F.sha2("text", 256).alias("digest"), "source")
    now = docs.select((d + F.when(d % 10 == 0, 10**9).otherwise(0)).alias("id"), "digest")
    prior = docs.select((d + F.when(d % 6 == 0, 2 * 10**9).otherwise(0)).alias("id"), F.when(d % 5 == 0, "x").otherwise(F.col("digest")).alias("digest"))
    return incremental.plan(now, prior, docs.filter("source = 'src3'").select(d.alias("id")))


def edge_inverse_check(spark, sf_dir):
    """Every edge forward and back; some changed their kind on one side."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind")).distinct()
    changed = lambda c, m: li.withColumn("kind", F.when(F.col(c) % m == 0, F.concat("kind", F.lit("x"))).otherwise(F.col("kind")))
    return incremental.inverse_mismatches(changed("src", 37), changed("dst", 41))


QUERIES = {f.__name__: f for f in (feedback_review, feedback_summary, audit_routing, audit_rules, audit_status, quota_check, upcoming_reviews, review_states, corpus_health, source_diff, recursive_invalidation, compile_digest, compile_plan, edge_inverse_check)}

FEEDBACK = """with rows as (select l.doc_id as line, case when l.doc_id % 11 = 0 then ' ' else lang end as query, case when toxic = 1 then 'wrong' when quality = 0 then 'miss' when l.doc_id % 13 = 0 then 'maybe' else 'correct' end as verdict, case when l.doc_id % 3 = 0 then source end as expected from labels l left join documents d on l.doc_id = d.doc_id),
c as (select line, verdict, expected, case when query is null or trim(query) = '' then 'empty-query' when verdict not in ('correct', 'wrong', 'miss') then 'unknown-verdict' when verdict = 'miss' and expected is null then 'miss-without-expected' when expected in ('src7', 'src11') then 'unknown-topic' end as reject_reason, row_number() over (partition by query, verdict, expected order by line) > 1 as duplicate, line in (select doc_id from labels where toxic = 1 and quality = 1) as resolved from rows)
"""
RULES = "with v as (" + " union all ".join(f"select doc_id, '{r.level}' as level, '{r.code}' as code from documents where {r.condition.replace('octet_length(text)', 'strlen(text)')}" for r in TEXT_RULES) + ")"
ORACLES = {
    "feedback_review": FEEDBACK + "select * from c",
    "feedback_summary": FEEDBACK + "select count(*) filter (where reject_reason is null) as valid, count(*) filter (where reject_reason is not null) as invalid, count(*) filter (where reject_reason is null and duplicate) as duplicates, count(*) filter (where reject_reason is null and resolved) as resolved, count(*) filter (where reject_reason is null and verdict in ('wrong', 'miss') and not resolved) as actionable, round(count(*) filter (where reject_reason is null and verdict in ('wrong', 'miss')) / nullif(cast(count(*) filter (where reject_reason is null) as double), 0), 6) as wrong_rate from c",
    "audit_routing": "with a as (select case when doc_id % 3 = 0 then doc_id || 'a' else cast(doc_id as varchar) end as name from documents), r as (select unnest([case when doc_id % 7 = 0 then doc_id || 'r' else cast(doc_id as varchar) end, case when doc_id % 10 <> 0 then 'x' || doc_id when doc_id % 7 = 0 then doc_id || 'r' else cast(doc_id as varchar) end]) as name from documents), c as (select name, count(*) as n from r group by name) select name, 'unrouted' as code, cast(0 as bigint) as n from a where name not in (select name from r) union all select name, 'non-active', n from c where name not in (select name from a) union all select name, 'duplicate-route', n from c where n > 1",
    "audit_rules": RULES + " select * from v",
    "audit_status": RULES + " select count(*) filter (where level = 'error') as errors, count(*) filter (where level = 'warning') as warnings, case when count(*) filter (where level = 'error') > 0 then 'failed' else 'passed' end as status from v",
    "quota_check": "with g as (select source as name, count(*) as n from documents group by source), b as (select source as name, count(*) as allowed from documents where lang = 'en' and source <> 'src3' group by source) select g.name, n, greatest(30, coalesce(allowed, 0)) as cap, n > greatest(30, coalesce(allowed, 0)) as exceeded from g left join b on g.name = b.name",
    "upcoming_reviews": "select o_orderkey, cast(o_orderdate as date) as due, datediff('day', date '1997-01-01', cast(o_orderdate as date)) as days_left, cast(o_orderdate as date) < date '1997-01-01' as overdue from orders where datediff('day', date '1997-01-01', cast(o_orderdate as date)) <= 60",
    "review_states": "with t as (select doc_id + case when doc_id % 5 = 0 then 1000000000 else 0 end as name, sha256(text) as content, lang from documents), r as (select doc_id + case when doc_id % 4 = 0 then 2000000000 else 0 end as name, case when doc_id % 3 = 0 then 'old' else sha256(text) end as was, case when doc_id % 7 = 0 then 'xx' else lang end as due from documents) select coalesce(t.name, r.name) as name, case when was is null then 'missing' when content is null then 'stale' when content <> was or lang is distinct from due then 'mismatch' else 'confirmed' end as state from t full outer join r on t.name = r.name",
    "corpus_health": "select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' else 'all' end as metric, coalesce(lang, source) as name, count(*) as documents, cast(sum(strlen(text)) as bigint) as bytes from documents group by grouping sets ((), (lang), (source))",
    "source_diff": "with d as (select sha256(text) as sha, doc_id from documents), o as (select case when doc_id % 9 = 0 then 'old/' else 'docs/' end || doc_id as path, case when doc_id % 8 = 0 then 'x' else sha end as sha from d), n as (select case when doc_id % 14 = 0 then 'new/' else 'docs/' end || doc_id as path, sha from d), s as (select coalesce(o.path, n.path) as path, case when o.sha is null then 'new' when n.sha is null then 'deleted' when o.sha <> n.sha then 'changed' end as state from o full outer join n on o.path = n.path) select * from s where state is not null",
    "recursive_invalidation": "with recursive e as (select distinct 'p' || l_partkey as id, 's' || l_suppkey as dep from lineitem union select 's' || s_suppkey, 'n' || s_nationkey from supplier union select 'n' || n_nationkey, 'r' || n_regionkey from nation), w as (select id, 0 as depth from (values ('r2'), ('s1')) v(id) union select e.id, w.depth + 1 from e join w on e.dep = w.id) select id, min(depth) as depth from w group by id",
    "compile_digest": "select doc_id, sha256('vcompiler-1' || chr(31) || coalesce('v' || text, 'n') || chr(31) || coalesce('v' || lang, 'n') || chr(31) || coalesce('v' || source, 'n')) as digest from documents",
    "compile_plan": "with d as (select doc_id, sha256(text) as digest, source from documents), c as (select doc_id + case when doc_id % 10 = 0 then 1000000000 else 0 end as id, digest from d), p as (select doc_id + case when doc_id % 6 = 0 then 2000000000 else 0 end as id, case when doc_id % 5 = 0 then 'x' else digest end as digest from d) select coalesce(c.id, p.id) as id, case when c.digest is null then 'delete' when p.digest is null or p.digest <> c.digest then 'compile' when coalesce(c.id, p.id) in (select doc_id from d where source = 'src3') then 'invalidated' else 'reuse' end as action from c full outer join p on c.id = p.id",
    "edge_inverse_check": "with e as (select distinct l_partkey as src, l_suppkey as dst, l_returnflag as kind from lineitem), f as (select src, dst, case when src % 37 = 0 then kind || 'x' else kind end as kind from e), b as (select src, dst, case when dst % 41 = 0 then kind || 'x' else kind end as kind from e) select *, 'reverse' as missing_in from (select * from f except all select * from b) union all select *, 'forward' from (select * from b except all select * from f)",
}
