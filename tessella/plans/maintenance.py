"""Retrieval that keeps up with its collection: a segmented index after replacements, deletions and returns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import jsonschema
from tessella.functions.tokenizer import sql_tokens
from tessella.operators import index
from tessella.operators.segments import SegmentedIndex
from tessella.plans.retrieval import RANK, VALUES, WEIGHTS, _bm25_sql, _fields, queries_of
from tessella.scratch import place, scratch_dir
from tessella.session import table
from tessella.sources import event_schema


def changed_index(spark, sf_dir) -> SegmentedIndex:
    """All documents; then those labelled toxic get another text, those of low quality go, and those that are both come
    back as they were. Each step is one version; the fan-out of three makes the last one merge."""
    root = f"{scratch_dir(spark)}/segments-{uuid.uuid4().hex}"
    where, files = place(spark, root)
    files.deleteOnExit(where)
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    toxic, low = labels.filter("toxic = 1").select("doc_id"), labels.filter("quality = 0").select("doc_id")
    out = SegmentedIndex(spark, root, "doc_id", _fields(), fanout=3)
    out.apply(docs)
    out.apply(docs.join(toxic, "doc_id", "left_semi").withColumn("text", F.concat(F.lit("license withheld\n"), F.substring("text", 1, 100))))
    out.apply(deleted=low)
    out.apply(docs.join(toxic, "doc_id", "left_semi").join(low, "doc_id", "left_semi"))
    return out


def segment_terms(spark, sf_dir) -> DataFrame:
    return changed_index(spark, sf_dir).tables()["terms"].select("term", "df", F.round("idf", 6).alias("idf"))


def segment_search(spark, sf_dir) -> DataFrame:
    return index.top_k(index.bm25f_stored(changed_index(spark, sf_dir).tables(), "doc_id", WEIGHTS, queries_of(spark)), "doc_id", 10)


def event_violations(spark, sf_dir) -> DataFrame:
    """Every event as a line of the log, by its number in one of seven ways right or wrong, and what validation says."""
    e = table(spark, sf_dir, "events").select("event_id", F.md5(F.col("event_id").cast("string")).alias("h"), (F.col("event_id") % 7).alias("k"), F.col("value").cast("double").alias("v") if "value" in table(spark, sf_dir, "events").columns else F.lit(1.0).alias("v"))
    k = F.col("k")
    uuid4 = F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.concat(F.lit("4"), F.substring("h", 14, 3)), F.concat(F.lit("8"), F.substring("h", 18, 3)), F.substring("h", 21, 12))
    count = F.struct(F.lit("gate").alias("gate"), F.lit("passed").alias("status"), F.when(k == 2, -1).otherwise(1).alias("errors"), F.lit(0).alias("warnings"), F.abs("v").alias("duration_ms"), F.when(k == 3, 1).alias("more"))
    line = F.to_json(F.struct(F.when(k == 1, "old/v1").otherwise("events/v1").alias("schema"), F.when(k == 4, "gate.opened").otherwise("gate.completed").alias("event"), F.lit("2026-01-02T03:04:05.678Z").alias("recorded_at"), F.when(k == 5, F.col("h")).otherwise(uuid4).alias("trace_id"), F.col("h").alias("snapshot_id"), F.struct(F.lit("node").alias("runtime"), F.lit("22").alias("runtime_version"), F.lit("cli").alias("component"), F.lit("1").alias("component_version")).alias("process"), count.alias("payload")))
    line = event_schema.upgraded(F.when(k == 6, F.substring(line, 1, 40)).otherwise(line), {"old/v1": "events/v1"})
    return e.select("event_id", F.array_join(jsonschema.violations(line, event_schema.schema("events/v1", ("gate.completed",))), ",").alias("violations"))


QUERIES = {f.__name__: f for f in (segment_terms, segment_search, event_violations)}

NOW = """now as (select d.doc_id, case when t.doc_id is not null and q.doc_id is null then 'license withheld' || chr(10) || substr(d.text, 1, 100) else d.text end as text
  from documents d left join (select distinct doc_id from labels where toxic = 1) t on t.doc_id = d.doc_id left join (select distinct doc_id from labels where quality = 0) q on q.doc_id = d.doc_id
  where q.doc_id is null or t.doc_id is not null)"""

ORACLES = {
    "event_violations": "select event_id, case event_id % 7 when 2 then '$.payload.errors minimum' when 3 then '$.payload additionalProperties' when 4 then '$.event enum' when 5 then '$.trace_id pattern' when 6 then '$ json' else '' end as violations from events",
    "segment_terms": f"with {NOW}, t as (select distinct doc_id, unnest({sql_tokens('text')}) as term from now), d as (select term, count(*) as df from t group by term) select term, df, round(ln(1 + ((select count(*) from now) - df + 0.5) / (df + 0.5)), 6) as idf from d",
    "segment_search": f"with {NOW}, {_bm25_sql('bf', WEIGHTS).replace('from documents', 'from now')} select query_id, doc_id, round(score, 6) as score, matched, rank from (select *, {RANK.format(s='score')} as rank from bf) where rank <= 10",
}
