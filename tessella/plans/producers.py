"""Lines of the log that recalls, opens and builds produce, inboxes of resolutions, and what an embedding channel may answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import jsonschema
from tessella.functions.text import ascii_tokens
from tessella.operators import planner, producers, ranker, vectors
from tessella.plans import topics
from tessella.plans.inboxes import _lines
from tessella.plans.quality import STATES, TOK, _states
from tessella.session import table
from tessella.sources import event_schema, receipts

SCHEMA, KEY, AT = "events/v1", "k", "2026-01-02 00:00:00"


def _log():
    return producers.Log(SCHEMA, F.to_timestamp(F.lit(AT)), "22", "1")


def _member(path: str):
    return F.get_json_object("value", f"$.payload.{path}")


def _faults(event: str):
    return F.array_join(jsonschema.violations(F.col("value"), event_schema.schema(SCHEMA, (event,))), ",").alias("violations")


def recall_lines(spark, sf_dir):
    """The recalls of the asked queries as lines of the log, with what validation says of them; times are those of the
    queries' numbers."""
    asks, tables = planner.analyse(topics.asked(spark)), topics.tables_of(spark, sf_dir)
    lanes = planner.all_lanes(asks, tables)
    found = ranker.rank(topics.asked(spark), tables)
    gone = asks.select("query_id").join(found.groupBy("query_id").agg(F.bool_or("trusted").alias("any")), "query_id", "left").filter("any is null or not any")
    abstained = gone.select("query_id", F.when(F.col("any").isNull(), "no-trusted-candidate").otherwise("below-threshold").alias("reason"))
    q = F.col("query_id")
    ms = [(q - 5 + i).cast("double").alias(f"{s}_ms") for i, s in enumerate(("total", "load", "plan", "rank", "context"))]
    measured = asks.select("query_id", "query", "classes", *ms, F.length("query").alias("estimated_tokens"), (q % 3).alias("dropped_topics"), (q % 2 == 0).alias("truncated"), (q % 3 == 0).alias("hot"), F.lit("snapshot").alias("mode"), F.when(q % 4 == 0, "previous").alias("status"), F.lit("s1").alias("snapshot_id"), F.lit(None).cast("struct<active:boolean>").alias("embedding"))
    answers = found.filter("trusted").select("query_id", F.col("rank").alias("position"), "doc_id")
    out = producers.recalls(_log(), measured, lanes, answers, abstained, KEY, planner.CHANNELS)
    text = ("query_id", "query_class", "execution", "channels", "abstain_reason", "returned_topics")
    fields = [_member(t).alias("query_key" if t == "query_id" else t) for t in text] + [_member(t).cast("double").alias(t) for t in ("total_ms", "stage_ms.load", "rrf_candidates", "estimated_tokens", "dropped_topics")] + [_member(t).cast("boolean").alias(t) for t in ("abstained", "consumption_eligible", "truncated")]
    rows = out.select("query_id", "trace_id", F.get_json_object("value", "$.process.component").alias("component"), *fields, _faults("recall.completed"))
    return rows.withColumnRenamed("stage_ms.load", "load_ms")


def _turns(spark, sf_dir):
    """Each conversation as an open of the topics that its turns name by their roles and lengths."""
    named = F.concat(F.lower("role"), F.lit("_"), (F.length("text") % 5).cast("string"))
    turns = table(spark, sf_dir, "conversations").filter("role is not null and text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(named)).alias("topics"))
    c = F.col("conv_id")
    return turns.select("conv_id", F.when(c % 7 != 0, producers.trace_id(c)).alias("trace_id"), F.when(c % 2 == 0, "s1").alias("snapshot_id"), F.when(c % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("topics")).alias("topics"), F.when(c % 3 == 0, "cli").alias("via"), F.when(c % 5 == 0, "session").alias("match"))


def opened_lines(spark, sf_dir):
    """Deliveries and consumptions of all conversations as lines of the log."""
    rows = _turns(spark, sf_dir)
    shown = producers.deliveries(_log(), rows).withColumn("violations", _faults("recall.delivered"))
    opened = producers.consumptions(_log(), rows).withColumn("violations", _faults("recall.consumed"))
    return shown.unionByName(opened).select(F.get_json_object("value", "$.event").alias("event"), "trace_id", F.get_json_object("value", "$.snapshot_id").alias("snapshot_id"), _member("topics").alias("topics"), _member("surface").alias("surface"), _member("via").alias("via"), _member("match").alias("match"), "violations")


def build_lines(spark, sf_dir):
    """A build for each part, some of which failed or measured nonsense, as lines of the log."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("build_id"), F.lit("s1").alias("snapshot_id"), F.when(k % 2 == 0, "incremental").alias("mode"), (F.col("p_size") - 10).alias("changed"), F.col("p_size").alias("compiled"), (k % 4).alias("reused"), (k % 3).alias("deleted"), F.length("p_name").alias("bytes"), (F.col("p_size") - 20.5).alias("duration_ms"), F.when(k % 5 == 0, "enoent").when(k % 7 == 0, "what happened?").alias("error"), (k % 11 == 0).alias("previous_used"))
    fields = [_member(t).cast("double").alias(t) for t in ("changed_files", "compiled_topics", "reused_topics", "deleted_topics", "snapshot_bytes", "duration_ms")]
    return producers.builds(_log(), rows).select("build_id", _member("mode").alias("mode"), *fields, *[_member(t).cast("boolean").alias(t) for t in ("success", "fallback")], _member("error_code").alias("error_code"), _faults("index.build"))


#: Lines of the resolutions' inbox as SQL that Spark and DuckDB both take.
RESOLUTIONS = """case when doc_id % 19 = 0 then '[' when doc_id % 17 = 0 then '{"schema":"x/v1","feedback_line":3}' when doc_id % 13 = 0 then '{"feedback_line":4}' else concat('{"schema":"miss-resolution-receipt/v1","feedback_line":', cast(doc_id as string), '}') end"""


def resolution_lines(spark, sf_dir):
    return receipts.resolution_receipts(_lines(spark, sf_dir, RESOLUTIONS))


def upgraded_index(spark, sf_dir):
    """Postings of the first format, nested by term (a thousand documents a row at most), in the present one."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.struct(F.lit("lang").alias("field"), F.col("lang").alias("t")), F.struct(F.lit("body").alias("field"), F.col("text").alias("t")))).alias("x"))
    each = pages.select("doc_id", "x.field", F.explode(ascii_tokens(F.col("x.t"))).alias("term")).groupBy("term", "doc_id", "field").agg(F.count(F.lit(1)).alias("frequency"))
    by_doc = each.groupBy("term", "doc_id").agg(F.collect_list(F.struct("field", "frequency")).alias("fields"))
    nested = by_doc.groupBy("term", F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.collect_list(F.struct(F.col("doc_id").alias("document_id"), "fields")).alias("postings"))
    return receipts.upgraded_postings(nested)


def embedding_allowed(spark, sf_dir):
    """The documents that the embedding channel may answer with."""
    d = F.col("doc_id")
    stored = table(spark, sf_dir, "documents").select(F.when(d % 10 == 3, -d - 1).otherwise(d).alias("doc_id"), F.when(d % 6 == 0, 7).otherwise(8).alias("dimensions"))
    return vectors.allowed(_states(spark, sf_dir), stored, 8)


QUERIES = {f.__name__: f for f in (recall_lines, opened_lines, build_lines, resolution_lines, upgraded_index, embedding_allowed)}


def _trace(*parts: str) -> str:
    h = "sha256(" + " || chr(10) || ".join(parts) + ")"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def _hmac(text: str) -> str:
    key = KEY.encode().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({text}))))"


_LIST = "'[' || coalesce(array_to_string(list_transform({c}, lambda x: '\"' || x || '\"'), ','), '') || ']'"
_OPENS = f"""r as (select conv_id, list_sort(list_distinct(list(lower(role) || '_' || (length(text) % 5)))) as topics from conversations where role is not null and text is not null group by conv_id),
o as (select {_trace("cast(conv_id as varchar)")} as trace_id, case when conv_id % 2 = 0 then 's1' end as snapshot_id, {_LIST.format(c="topics")} as topics, case when conv_id % 3 = 0 then 'cli' else 'claude-hook' end as via, case when conv_id % 5 = 0 then 'session' else 'recent' end as match from r where conv_id % 7 <> 0 and conv_id % 11 <> 0)"""
_COUNTS = " || ',' || ".join(f"'\"{c}\":' || count(*) filter (where channel = '{c}')" for c in planner.CHANNELS)

ORACLES = {
    "recall_lines": f"""{topics._WITH}, {topics._lanes()}, {topics._rank()}, ch as (select query_id, '{{' || {_COUNTS} || '}}' as channels, count(distinct doc_id) as n from lanes group by query_id),
tp as (select query_id, list(doc_id order by rank)[1:20] as topics from sc where trusted group by query_id),
x as (select q.query_id, q.query, q.classes, ch.channels, coalesce(ch.n, 0) as n, tp.topics, case when q.query_id not in (select query_id from sc) then 'no-trusted-candidate' when tp.topics is null then 'below-threshold' end as reason from q left join ch using (query_id) left join tp using (query_id))
select query_id, {_trace("'recall'", f"'{AT}'", "cast(query_id as varchar)")} as trace_id, case when query_id % 4 = 0 then 'memory-recall-previous' else 'memory-recall-snapshot' end as component, {_hmac("query")} as query_key, {_LIST.format(c="classes")} as query_class, case when query_id % 3 = 0 then 'hot' else 'cold' end as execution,
coalesce(channels, '{{{",".join(f'"{c}":0' for c in planner.CHANNELS)}}}') as channels, reason as abstain_reason, {_LIST.format(c="topics")} as returned_topics, greatest(query_id - 5, 0)::double as total_ms, greatest(query_id - 4, 0)::double as load_ms, n::double as rrf_candidates, length(query)::double as estimated_tokens, (query_id % 3)::double as dropped_topics,
reason is not null as abstained, reason is null as consumption_eligible, query_id % 2 = 0 as truncated, '' as violations from x""",
    "opened_lines": f"with {_OPENS} select 'recall.delivered' as event, trace_id, snapshot_id, topics, 'claude-hook' as surface, cast(null as varchar) as via, cast(null as varchar) as match, '' as violations from o union all select 'recall.consumed', trace_id, snapshot_id, topics, null, via, match, '' from o",
    "build_lines": "with b as (select *, case when p_partkey % 5 = 0 then 'ENOENT' when p_partkey % 7 = 0 then 'REBUILD_FAILED' end as code from part) select p_partkey as build_id, case when p_partkey % 2 = 0 then 'incremental' else 'full' end as mode, greatest(p_size - 10, 0)::double as changed_files, p_size::double as compiled_topics, (p_partkey % 4)::double as reused_topics, (p_partkey % 3)::double as deleted_topics, length(p_name)::double as snapshot_bytes, greatest(p_size - 20.5, 0)::double as duration_ms, code is null as success, code is not null or p_partkey % 11 = 0 as fallback, code as error_code, '' as violations from b",
    "resolution_lines": "select doc_id as line, case when doc_id % 19 <> 0 then case when doc_id % 17 = 0 then 3 when doc_id % 13 = 0 then 4 else doc_id end end as feedback_line, case when doc_id % 19 = 0 then 'invalid-json' when doc_id % 17 = 0 or doc_id % 13 = 0 then 'unexpected-schema' end as reject_reason from labels",
    "upgraded_index": f"with p as (select doc_id, 'lang' as field, {TOK.format(c='lang')} as toks from documents union all select doc_id, 'body', {TOK.format(c='text')} from documents), e as (select doc_id, field, len(toks) as len, unnest(toks) as term from p) select term, doc_id, field, len, count(*) as tf from e group by term, doc_id, field, len",
    "embedding_allowed": f"with {STATES}, v as (select case when doc_id % 10 = 3 then -doc_id - 1 else doc_id end as doc_id from documents where doc_id % 6 <> 0) select s.doc_id from s join v using (doc_id) where s.state = 'fresh'",
}
