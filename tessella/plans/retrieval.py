"""Retrieval over `documents` from a stored index: statistics, BM25F, lanes, fusion.

The index is built by the first query that needs it whole and read by all others until the documents change; a batch that
finds none makes one of its own terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import ascii_tokens, first_line
from tessella.functions.tokenizer import sql_tokens
from tessella.operators import compile as compiler
from tessella.operators import fusion, index, lanes
from tessella.scratch import scratch_dir
from tessella.session import table

#: A batch of literal queries (query_id, query).
LITERALS = [(1, "the worthless trash of the nation"), (2, "released under the license version 3"), (3, "und die der ein nicht"), (4, "que de la para con"), (5, "contact email token password secret")]
WEIGHTS = {"title": (2.5, 0.35), "body": (1.0, 0.75)}


def queries_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LITERALS, "query_id int, query string")


def docs_of(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _fields():
    return {"title": first_line(F.col("text")), "body": F.col("text")}


def stored(spark, sf_dir) -> dict[str, DataFrame]:
    return compiler.open_index(spark, f"{scratch_dir(spark)}/documents", [f"{sf_dir}/documents.parquet"], index.makers(docs_of(spark, sf_dir), "doc_id", _fields()))


def _for(spark, sf_dir, queries):
    """The stored index, or where there is none one of the batch's terms."""
    return compiler.open_for(spark, f"{scratch_dir(spark)}/documents", [f"{sf_dir}/documents.parquet"], queries, docs_of(spark, sf_dir), "doc_id", _fields())


def tokens_tf(spark, sf_dir):
    return stored(spark, sf_dir)["postings"].filter("field = 'body'").select("doc_id", "term", "tf")


def field_lengths(spark, sf_dir):
    every = docs_of(spark, sf_dir).select("doc_id", F.explode(F.array(*map(F.lit, _fields()))).alias("field"))
    held = stored(spark, sf_dir)["postings"].groupBy("doc_id", "field").agg(F.sum("tf").alias("len"))
    return every.join(held, ["doc_id", "field"], "left").select("doc_id", "field", F.coalesce("len", F.lit(0)).alias("len"))


def term_df_idf(spark, sf_dir):
    return stored(spark, sf_dir)["terms"].withColumn("idf", F.round("idf", 6))


def _bm25(spark, sf_dir, queries=None):
    queries = queries or queries_of(spark)
    return index.bm25f_stored(_for(spark, sf_dir, queries), "doc_id", {"body": (1.0, 0.75)}, queries)


def _bm25f(spark, sf_dir):
    return index.bm25f_stored(_for(spark, sf_dir, queries_of(spark)), "doc_id", WEIGHTS, queries_of(spark))


def bm25_topk(spark, sf_dir):
    return index.top_k(_bm25(spark, sf_dir), "doc_id", 10)


def bm25f_two_fields(spark, sf_dir):
    return index.top_k(_bm25f(spark, sf_dir), "doc_id", 10)


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))


def _exact(spark, sf_dir):
    p = _paths(spark, sf_dir)
    kinds = {"path": F.col("path"), "basename": F.element_at(F.split("path", "/"), -1), "host": F.col("host")}
    entries = p.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in kinds.items()])).alias("e")).select("e.kind", "e.value", "doc_id").filter("value <> ''")
    return index.exact_map(entries)


def exact_map_build(spark, sf_dir):
    return _exact(spark, sf_dir).withColumn("documents", F.array_join("documents", ","))


def exact_anchor_match(spark, sf_dir):
    asked = _paths(spark, sf_dir).filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.explode(F.array(F.upper("path"), F.col("host"))).alias("anchor"))
    return lanes.exact_matches(asked, _exact(spark, sf_dir))


def path_suffix_join(spark, sf_dir):
    p = _paths(spark, sf_dir)
    asked = p.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.element_at(F.split("path", "/"), -1).alias("path"))
    return lanes.suffix_matches(asked, p.select("doc_id", "path"))


def trigger_containment(spark, sf_dir):
    triggers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("trigger_id"), F.array_join(F.slice(ascii_tokens(F.col("text")), 1, 3), " ").alias("trigger"))
    return lanes.trigger_matches(triggers, docs_of(spark, sf_dir), "doc_id", "text", 3)


def delimited_triggers(spark, sf_dir):
    """Every benchmark passage's first line and its first words, as triggers of any length, in every document."""
    text = F.lower("text")
    bench = table(spark, sf_dir, "benchmark")
    triggers = bench.select(F.explode(F.array(F.split_part(text, F.lit("\n"), F.lit(1)), F.substring(text, 1, 12), F.substring_index(text, " ", 2))).alias("normalized"))
    return lanes.delimited(docs_of(spark, sf_dir).select(F.col("doc_id").alias("query_id"), text.alias("normalized")), triggers)


def _part_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.array_union(F.split(F.lower("p_name"), " "), F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand")), " "))).alias("term")).distinct()


FRAGMENTS = ["widgets", "econmy", "smal", "brand#11", "blue-bolt", "promotional", "ringg", "standrad"]
WORDS = ["widgte", "econamy", "smalll", "brand#1", "bolts", "promotoin", "rign", "reed"]


def trigram_dice_join(spark, sf_dir):
    return lanes.trigram_matches(spark.createDataFrame([(f,) for f in FRAGMENTS], "fragment string"), _part_words(spark, sf_dir))


def fuzzy_edit_join(spark, sf_dir):
    return lanes.fuzzy_matches(spark.createDataFrame([(f,) for f in WORDS], "word string"), _part_words(spark, sf_dir))


def graph_two_hop(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    edges = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("supplies").alias("kind")).unionByName(o.join(li, o.o_orderkey == li.l_orderkey).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("buys").alias("kind")))
    return lanes.two_hops(edges.distinct(), spark.createDataFrame([("s1",), ("c7",)], "id string"))


def _lanes(spark, sf_dir):
    body = index.top_k(_bm25(spark, sf_dir), "doc_id", 50).select("query_id", F.lit("body").alias("channel"), "doc_id", "rank")
    title = index.top_k(index.bm25f_stored(_for(spark, sf_dir, queries_of(spark)), "doc_id", {"title": (1.0, 0.35)}, queries_of(spark)), "doc_id", 50)
    return body.unionByName(title.select("query_id", F.lit("title").alias("channel"), "doc_id", "rank"))


def _fused(spark, sf_dir):
    return fusion.rrf(_lanes(spark, sf_dir), {"body": 16, "title": 8}, "doc_id")


def rrf_fusion(spark, sf_dir):
    return index.top_k(_fused(spark, sf_dir).withColumn("channels", F.array_join("channels", ",")), "doc_id", 10, "rrf")


def multi_query_fusion(spark, sf_dir):
    ranked = index.top_k(_bm25(spark, sf_dir), "doc_id", 50).select(F.when(F.col("query_id") <= 2, 1).otherwise(2).alias("query"), F.col("query_id").alias("variant"), "doc_id", "rank")
    fused = fusion.fuse_variants(ranked.withColumnRenamed("query", "query_id"), "doc_id")
    return index.top_k(fused, "doc_id", 10)


def relative_score_cut(spark, sf_dir):
    return fusion.relative_cut(_bm25(spark, sf_dir).withColumn("matched", F.col("matched").cast("long"))).withColumn("score", F.round("score", 6))


def conflict_penalty(spark, sf_dir):
    ranked = index.top_k(_bm25(spark, sf_dir), "doc_id", 50).select("query_id", "doc_id")
    docs = docs_of(spark, sf_dir).select("doc_id", "source", "lang")
    older = docs.select(F.col("doc_id").alias("older"), F.col("source").alias("s"), F.col("lang").alias("l"))
    # A document supersedes the one before it in its source; same language or not gives two kinds.
    pairs = docs.withColumn("older", F.explode(F.array(F.col("doc_id") - 1, F.col("doc_id") - 2))).join(older, "older")
    kinds = pairs.select(F.col("doc_id").alias("newer"), "older", F.when(F.col("lang") == F.col("l"), "superseded").otherwise("authority-role").alias("kind"), F.when(F.col("lang") == F.col("l"), 0.25).otherwise(0.03).alias("penalty"))
    return fusion.conflicts(ranked, kinds, "doc_id")


def mmr_select(spark, sf_dir):
    ranked = index.top_k(_bm25(spark, sf_dir), "doc_id", 50).join(docs_of(spark, sf_dir).select("doc_id", F.array_distinct(ascii_tokens(F.col("text"))).alias("tokens")), "doc_id")
    return fusion.mmr(ranked, "doc_id").withColumn("similarity", F.round("similarity", 6))


QUERIES = {f.__name__: f for f in (tokens_tf, field_lengths, term_df_idf, bm25_topk, bm25f_two_fields, exact_map_build, exact_anchor_match, path_suffix_join, trigger_containment, delimited_triggers, trigram_dice_join, fuzzy_edit_join, graph_two_hop, rrf_fusion, multi_query_fusion, relative_score_cut, conflict_penalty, mmr_select)}

VALUES = ", ".join(f"({i}, '{q}')" for i, q in LITERALS)
TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"
TITLE = "split_part(coalesce(text, ''), chr(10), 1)"


def _bm25_sql(name: str, weights: dict[str, tuple[float, float]], asked: str | None = None, fields: dict[str, str] | None = None) -> str:
    """CTEs that end in {name}(query_id, doc_id, score, matched): BM25F over `weights` of an index of `fields` (name: SQL)."""
    fields = fields or {"title": TITLE, "body": "text"}
    rows = " union all ".join(f"select doc_id, '{f}' as field, {sql_tokens(c)} as tokens from documents" for f, c in fields.items())
    chosen = ", ".join(f"('{f}', {w}::double, {b}::double)" for f, (w, b) in weights.items())
    return f"""{name}_q as ({asked or f"select query_id, unnest(list_distinct({sql_tokens('query')})) as term from (values {VALUES}) v(query_id, query)"}),
{name}_t as ({rows}), {name}_w(field, w, b) as (values {chosen}), {name}_a as (select field, avg(len(tokens)) as avg_len from {name}_t group by field),
{name}_x as (select doc_id, field, len(tokens) as len, unnest(tokens) as term from {name}_t),
{name}_f as (select doc_id, field, len, term, count(*) as tf from {name}_x where term in (select term from {name}_q) group by all),
{name}_p as (select f.doc_id, f.term, sum(w.w * f.tf / greatest(1 - w.b + w.b * f.len / case when a.avg_len > 0 then a.avg_len else 1 end, 0.1)) as f from {name}_f f join {name}_a a on f.field = a.field join {name}_w w on w.field = f.field group by f.doc_id, f.term),
{name}_d as (select term, count(distinct doc_id) as df from {name}_f group by term),
{name} as (select q.query_id, p.doc_id, sum(ln(1 + ((select count(*) from documents) - d.df + 0.5) / (d.df + 0.5)) * p.f * 2.2 / (p.f + 1.2)) as score, count(*) as matched
  from {name}_p p join {name}_d d on p.term = d.term join {name}_q q on q.term = p.term group by q.query_id, p.doc_id)"""


BODY = _bm25_sql("bm", {"body": (1.0, 0.75)})
BOTH = _bm25_sql("bf", WEIGHTS)
HEAD = _bm25_sql("bt", {"title": (1.0, 0.35)})
RANK = "row_number() over (partition by query_id order by round({s}, 9) desc, doc_id)"
LANES = f"""lanes as (select query_id, 'body' as channel, doc_id, r from (select *, {RANK.format(s='score')} as r from bm) where r <= 50
  union all select query_id, 'title', doc_id, r from (select *, {RANK.format(s='score')} as r from bt) where r <= 50),
fused as (select query_id, doc_id, sum(case channel when 'body' then 16.0 else 8.0 end::double / (10 + r)) / (24.0::double / 11) as rrf, list_sort(list(distinct channel)) as channels from lanes group by query_id, doc_id)"""
PATHS = "paths as (select page_id as doc_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) as path, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host from pages)"
EXACT = PATHS + ", entries as (select 'path' as kind, path as value, doc_id from paths union all select 'basename', string_split(path, '/')[-1], doc_id from paths union all select 'host', host, doc_id from paths), exact as (select kind, lower(value) as normalized, min(value) as value, list_sort(list(distinct doc_id)) as documents from entries where value <> '' group by kind, lower(value))"
PART_WORDS = "words as (select distinct unnest(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) as term from part)"
GRAMS = "list_distinct(list_transform(range(1, greatest(len({x}) - 1, 1)), lambda i: {x}[i:i+2]))"

ORACLES = {
    "tokens_tf": f"select doc_id, term, count(*) as tf from (select doc_id, unnest({sql_tokens('text')}) as term from documents) group by doc_id, term",
    "field_lengths": f"select doc_id, 'title' as field, cast(len({sql_tokens(TITLE)}) as bigint) as len from documents union all select doc_id, 'body', cast(len({sql_tokens('text')}) as bigint) from documents",
    "term_df_idf": f"with t as (select distinct doc_id, unnest({sql_tokens('text')}) as term from documents), d as (select term, count(*) as df from t group by term) select term, df, round(ln(1 + ((select count(*) from documents) - df + 0.5) / (df + 0.5)), 6) as idf from d",
    "bm25_topk": f"with {BODY} select query_id, doc_id, round(score, 6) as score, matched, rank from (select *, {RANK.format(s='score')} as rank from bm) where rank <= 10",
    "bm25f_two_fields": f"with {BOTH} select query_id, doc_id, round(score, 6) as score, matched, rank from (select *, {RANK.format(s='score')} as rank from bf) where rank <= 10",
    "exact_map_build": f"with {EXACT} select kind, normalized, value, array_to_string(documents, ',') as documents from exact",
    "exact_anchor_match": f"with {EXACT}, q as (select doc_id as query_id, lower(path) as a from paths where doc_id % 50 = 0 union all select doc_id, host from paths where doc_id % 50 = 0) select distinct query_id, kind, unnest(documents) as doc_id from q join exact on a = normalized",
    "path_suffix_join": f"with {PATHS}, q as (select doc_id as query_id, string_split(path, '/')[-1] as p from paths where doc_id % 50 = 0) select distinct query_id, doc_id from q join paths on p <> '' and path <> '' and (path = p or ends_with(path, '/' || p) or ends_with(p, '/' || path))",
    "trigger_containment": f"with t as (select item_id as trigger_id, array_to_string(({TOK.format(c='text')})[1:3], ' ') as trigger from benchmark), d as (select doc_id, ' ' || array_to_string({TOK.format(c='text')}, ' ') || ' ' as body from documents) select trigger_id, doc_id from t join d on contains(body, ' ' || trigger || ' ')",
    "delimited_triggers": r"with t as (select distinct unnest([split_part(lower(text), chr(10), 1), substr(lower(text), 1, 12), array_to_string(string_split(lower(text), ' ')[1:2], ' ')]) as normalized from benchmark) select distinct doc_id as query_id, normalized from t join documents on normalized <> '' and contains(lower(text), normalized) and regexp_matches(lower(text), '(^|[^a-z0-9])\Q' || normalized || '\E($|[^a-z0-9])')",
    "trigram_dice_join": f"with {PART_WORDS}, f as (select unnest([{', '.join(repr(f) for f in FRAGMENTS)}]) as fragment), l as (select fragment, {GRAMS.format(x='flat')} as g from (select fragment, regexp_replace(lower(fragment), '[^a-z0-9]', '', 'g') as flat from f)), r as (select term, {GRAMS.format(x='flat')} as g from (select term, regexp_replace(lower(term), '[^a-z0-9]', '', 'g') as flat from words) where len(flat) >= 3), s as (select fragment, term, len(list_intersect(l.g, r.g)) as shared, len(l.g) as n, len(r.g) as m from l, r), o as (select fragment, term, shared, 2.0 * shared / (n + m) as dice from s where shared >= least(2, n) and shared > 0 and 2.0 * shared / (n + m) >= 0.45) select fragment, term, shared, round(dice, 6) as dice, rank from (select *, row_number() over (partition by fragment order by round(dice, 9) desc, term) as rank from o) where rank <= 24",
    "fuzzy_edit_join": f"with {PART_WORDS}, w as (select unnest([{', '.join(repr(f) for f in WORDS)}]) as word) select word, term, levenshtein(word, term) as distance from w, words where levenshtein(word, term) between 1 and case when len(word) >= 9 then 2 else 1 end",
    "graph_two_hop": "with e as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst, 'supplies' as kind from lineitem union select distinct 'c' || o_custkey, 'p' || l_partkey, 'buys' from orders join lineitem on o_orderkey = l_orderkey), b as (select src, dst, kind from e union select dst, src, kind from e), f as (select src as seed, dst as via, kind from b where src in ('s1', 'c7')), h as (select seed, via as target, kind, 1 as hops, seed as through from f union all select f.seed, b.dst, b.kind, 2, f.via from (select distinct seed, via from f) f join b on b.src = f.via) select target, kind, hops, count(distinct through) as n from h where target not in ('s1', 'c7') group by target, kind, hops",
    "rrf_fusion": f"with {BODY}, {HEAD}, {LANES} select query_id, doc_id, round(rrf, 6) as rrf, array_to_string(channels, ',') as channels, rank from (select *, {RANK.format(s='rrf')} as rank from fused) where rank <= 10",
    "multi_query_fusion": f"with {BODY}, r as (select case when query_id <= 2 then 1 else 2 end as query_id, doc_id, r from (select *, {RANK.format(s='score')} as r from bm) where r <= 50), s as (select query_id, doc_id, sum(1.0::double / (10 + r)) as score, min(r) as best_rank, count(*) as variants from r group by query_id, doc_id) select query_id, doc_id, round(score, 6) as score, best_rank, variants, rank from (select *, {RANK.format(s='score')} as rank from s) where rank <= 10",
    "relative_score_cut": f"with {BODY} select query_id, doc_id, round(score, 6) as score, matched from (select *, max(score) over (partition by query_id) as top from bm) where round(score, 9) >= round(0.55::double * top, 9)",
    "conflict_penalty": f"with {BODY}, c as (select query_id, doc_id from (select *, {RANK.format(s='score')} as r from bm) where r <= 50), p as (select a.query_id, b.doc_id, case when x.lang = y.lang then 'superseded' else 'authority-role' end as kind, case when x.lang = y.lang then 0.25 else 0.03 end::double as penalty from c a join c b on a.query_id = b.query_id and b.doc_id in (a.doc_id - 1, a.doc_id - 2) join documents x on x.doc_id = a.doc_id join documents y on y.doc_id = b.doc_id), w as (select query_id, doc_id, kind, max(penalty) as p from p group by query_id, doc_id, kind) select query_id, doc_id, round(sum(p), 6) as penalty, count(*) as kinds from w group by query_id, doc_id",
}
