"""Which documents hold which sentences of the benchmark's passages, word for word."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import containment
from tessella.session import table


def passage_sentences(spark, sf_dir):
    """(item_id, pos, sentence, documents): in how many documents each sentence stands, without regard to case; all
    sentences of all passages against all texts."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.!?\n]")).alias("pos", "part"))
    asked = asked.select("item_id", "pos", F.btrim(F.lower("part"), F.lit(" ")).alias("sentence")).filter("sentence <> ''")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("value"))
    held = containment.holding(texts, "value", asked.select("sentence").distinct().withColumnRenamed("sentence", "query"), "query").groupBy("query").agg(F.count_distinct("doc_id").alias("documents"))
    return asked.join(held, F.col("query") == F.col("sentence"), "left").select("item_id", "pos", "sentence", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


QUERIES = {f.__name__: f for f in (passage_sentences,)}

ORACLES = {
    "passage_sentences": r"with p as (select item_id, string_split_regex(text, '[.!?\n]') as parts from benchmark), e as (select item_id, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as pos from p), s as (select item_id, pos, trim(lower(part), ' ') as sentence from e), q as (select distinct sentence from s where sentence <> ''), h as (select q.sentence, count(distinct d.doc_id) as documents from q join documents d on contains(lower(d.text), q.sentence) group by q.sentence) select item_id, pos, sentence, coalesce(documents, 0) as documents from s left join h using (sentence) where sentence <> ''",
}
