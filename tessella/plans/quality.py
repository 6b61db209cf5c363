"""Vectors, evaluation, duplicates, classification and excerpts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import classify, text
from tessella.functions.tokenizer import sql_tokens
from tessella.operators import duplicates, evaluate, index, vectors
from tessella.plans.retrieval import _bm25_sql, stored
from tessella.scratch import keep
from tessella.session import table


def cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return vectors.cosine_top_k(rows.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), rows, 10)


def cosine_neighbours(spark, sf_dir):
    """The three nearest of every vector, itself included: both sides are the whole table."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return vectors.cosine_top_k(rows.withColumnRenamed("doc_id", "query_id"), rows, 3)


def _states(spark, sf_dir):
    """Every document with its stored vector; some texts have changed since, some vectors belong to other ids."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(d, F.sha2("text", 256).alias("sha"))
    stored = docs.select(F.when(d % 10 == 3, -d - 1).otherwise(d).alias("doc_id"), F.when(d % 7 == 0, "old").otherwise(F.col("sha")).alias("sha"))
    return vectors.reconcile(docs, stored)


def embedding_reconcile(spark, sf_dir):
    return _states(spark, sf_dir)


def embedding_stale_ratio(spark, sf_dir):
    return vectors.staleness(_states(spark, sf_dir))


#: Words of a passage as they stand in the text, whatever their script.
WORDS = r"[\x20\x09-\x0D]+"


def _words(c):
    return F.split(c, WORDS)


def _golden(spark, sf_dir, cut=_words):
    """Cases: the first eight words of each benchmark passage; expected: documents that hold its first six."""
    words = cut(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 1, 8), " ").alias("query"), F.array_join(F.slice(words, 1, 6), " ").alias("gram"))


def _expected(spark, sf_dir, cut=_words):
    """(case_id, expected): the documents that hold a case's words; found once, however many profiles are compared."""
    cases = _golden(spark, sf_dir, cut).select(F.col("query_id").alias("case_id"), "gram")
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("expected"), F.explode(text.ngrams(cut(F.col("text")), 6)).alias("gram"))
    return keep(cases.join(held, "gram").select("case_id", "expected").distinct(), "golden")


def _hits(spark, sf_dir, b: float, golden, cut=_words):
    scored = index.bm25f_stored(stored(spark, sf_dir), "doc_id", {"body": (1.0, b)}, _golden(spark, sf_dir, cut))
    ranked = index.top_k(scored, "doc_id", 10).select(F.col("query_id").alias("case_id"), "doc_id", "rank")
    return evaluate.first_hits(ranked, golden).withColumn("group", F.when(F.col("case_id") % 2 == 0, "even").otherwise("odd"))


def retrieval_metrics(spark, sf_dir):
    return evaluate.metrics(_hits(spark, sf_dir, 0.75, _expected(spark, sf_dir)), "group")


def ab_compare(spark, sf_dir):
    """Passages are matched by ASCII tokens, so a document in other case or punctuation is expected too."""
    golden = _expected(spark, sf_dir, text.ascii_tokens)
    return evaluate.compare(*[_hits(spark, sf_dir, b, golden, text.ascii_tokens) for b in (0.75, 0.1)])


def ab_guard(spark, sf_dir):
    golden = _expected(spark, sf_dir)
    a, b = (evaluate.metrics(_hits(spark, sf_dir, b, golden), "group") for b in (0.75, 0.1))
    return evaluate.guard(a, b, ["group"])


def profile_selection(spark, sf_dir):
    golden = _expected(spark, sf_dir)
    out = None
    for name, b in (("b000", 0.0), ("b050", 0.5), ("b075", 0.75)):
        row = evaluate.metrics(_hits(spark, sf_dir, b, golden)).withColumn("profile", F.lit(name)).withColumn("cost", F.lit(b))
        out = row if out is None else out.unionByName(row)
    return evaluate.choose(out, ["recall_1", "mrr", "recall_5"], "cost", "profile")


def near_dup_minhash(spark, sf_dir):
    prints = duplicates.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text", simhash=False)
    return duplicates.similar_pairs(prints, "doc_id", simhash=None).drop("simhash_similarity")


def near_dup_simhash(spark, sf_dir):
    prints = duplicates.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text")
    return duplicates.similar_pairs(prints, "doc_id")


def near_dup_classes(spark, sf_dir):
    prints = duplicates.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text", simhash=False)
    return duplicates.similar_classes(prints, "doc_id", simhash=None)


def query_classify(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text"))
    return rows.select("conv_id", "turn", F.array_join(classify.query_classes(F.col("text")), ",").alias("classes"), F.size(classify.error_anchors(F.col("text"))).alias("errors"))


def identifier_fragments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(classify.fragments(F.col("url"))), ",").alias("fragments"))


SAID = ["remember that we deploy on Fridays", "forget it", "ok", "Do you remember the port?", "always use tabs", "remember this", "remember my password", "just today use port 9", "don't forget the milk", "show me the report"]


def intent_router(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.intent(F.col("text")).alias("i"))
    more = spark.createDataFrame([(-1 - i, 0, s) for i, s in enumerate(SAID)], "conv_id long, turn long, text string")
    return rows.unionByName(more.select("conv_id", "turn", classify.intent(F.col("text")).alias("i"))).select("conv_id", "turn", "i.action", "i.reason")


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def truncate_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 240).alias("excerpt"))


def best_chunk(spark, sf_dir):
    """Per document the paragraph (line) with most distinct tokens of the query, the first of several; with its byte
    offset."""
    asked = ["the", "and", "der", "die", "que", "de", "license"]
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "chunk"), "text")
    score = F.size(F.array_intersect(text.ascii_tokens(F.col("chunk")), F.array(*map(F.lit, asked))))
    best = lines.select("doc_id", score.alias("score"), "pos", F.octet_length("chunk").alias("bytes"), "chunk")
    return best.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"), "bytes", "chunk")).alias("b")).select("doc_id", "b.score", (-F.col("b.p")).alias("pos"), "b.bytes", "b.chunk")


def html_link_extract(spark, sf_dir):
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('<a\\s+href="([^"]*)"'), F.lit(1))))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).alias("n_links"), F.array_join(links, " ").alias("links"))


QUERIES = {f.__name__: f for f in (cosine_topk, cosine_neighbours, embedding_reconcile, embedding_stale_ratio, retrieval_metrics, ab_compare, ab_guard, profile_selection, near_dup_minhash, near_dup_simhash, near_dup_classes, query_classify, identifier_fragments, intent_router, token_estimate, truncate_excerpt, best_chunk, html_link_extract)}

TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"
STATES = "d as (select doc_id, sha256(text) as sha from documents), k as (select case when doc_id % 10 = 3 then -doc_id - 1 else doc_id end as doc_id, case when doc_id % 7 = 0 then 'old' else sha end as sha from d), s as (select coalesce(d.doc_id, k.doc_id) as doc_id, case when d.sha is null then 'deleted' when k.sha is null or k.sha <> d.sha then 'pending' else 'fresh' end as state from d full outer join k on d.doc_id = k.doc_id)"


def _hits_sql(name: str, b: float) -> str:
    """CTEs that end in {name}(case_id, rank, group)."""
    base = _bm25_sql(f"{name}_b", {"body": (1.0, b)}, f"select query_id, unnest(list_distinct({sql_tokens('query')})) as term from cases")
    return f"""{base}, {name}_r as (select query_id as case_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from {name}_b),
{name} as (select g.case_id, min(r.rank) filter (where r.rank <= 10) as rank, case when g.case_id % 2 = 0 then 'even' else 'odd' end as "group" from golden g left join {name}_r r on r.case_id = g.case_id and r.doc_id = g.expected group by g.case_id)"""


WORDS_SQL = r"string_split_regex(text, '[\x20\x09-\x0D]+')"
CASES = f"""cases as (select item_id as query_id, array_to_string(({WORDS_SQL})[1:8], ' ') as query, ' ' || array_to_string(({WORDS_SQL})[1:6], ' ') || ' ' as gram from benchmark),
golden as (select c.query_id as case_id, d.doc_id as expected from cases c join (select doc_id, ' ' || array_to_string({WORDS_SQL}, ' ') || ' ' as body from documents) d on contains(d.body, c.gram))"""
#: The same by ASCII tokens in lower case: more documents hold a passage.
ASCII_CASES = CASES.replace(WORDS_SQL, TOK.format(c="text"))
METRICS = "count(*) as cases, round(avg(case when rank <= 1 then 1.0 else 0.0 end::double), 6) as recall_1, round(avg(case when rank <= 5 then 1.0 else 0.0 end::double), 6) as recall_5, round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr"
PRINTS = f"""raw as (select doc_id, regexp_replace(coalesce(text, ''), '(?s)```.*?```', ' ', 'g') as x from documents), f as (select doc_id, {sql_tokens('x')} as t, regexp_replace(lower(x), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g') as flat from raw),
feat as (select doc_id, unnest(t || list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: 't3:' || t[i] || chr(0) || t[i + 1] || chr(0) || t[i + 2]) || list_transform(range(0, greatest(len(flat) - 11, 0), 4), lambda i: 'c12:' || flat[i + 1:i + 12])) as x from f),
cnt as (select doc_id, x, 1 + log2(count(*)) as w, sha256(x) as h from feat group by doc_id, x),
big as (select doc_id from cnt group by doc_id having count(*) >= 16),
num as (select doc_id, w, cast('0x' || h[1:16] as ubigint) as s, cast(cast('0x' || h[17:32] as ubigint) as hugeint) as a, cast(cast('0x' || h[33:48] as ubigint) | 1 as hugeint) as st from cnt where doc_id in (select doc_id from big)),
mh as (select doc_id, i, min((a + i * st) % 18446744073709551616::hugeint) as m from num, range(64) r(i) group by doc_id, i),
pair as (select x.doc_id as a, y.doc_id as b, count(*) / 64.0::double as minhash_similarity from mh x join mh y on x.i = y.i and x.m = y.m and x.doc_id < y.doc_id group by 1, 2 having count(*) >= 0.72 * 64)"""

#: Equal fingerprints are compared as one: each is listed with the smallest of them, and only that one with others.
LISTED = """sig as (select doc_id, string_agg(cast(m as varchar), ',' order by i) as g from mh group by doc_id), lead as (select g, min(doc_id) as id from sig group by g), of as (select doc_id, id from sig join lead using (g)),
listed as (select p.* from pair p join of x on x.doc_id = p.a join of y on y.doc_id = p.b where x.id = p.a and (y.id = p.b or y.id = p.a))"""
_C = {"p": classify.PATH, "e": classify.ERROR, "i": classify.IDENTIFIER, "d": classify.DECISION}
CLASSES = f"""with a as (select conv_id, turn, text, list_distinct(regexp_extract_all(text, '{_C['p']}')) as p, list_distinct(regexp_extract_all(text, '{_C['e']}')) as e, list_distinct(regexp_extract_all(text, '{_C['i']}')) as i,
  regexp_replace(regexp_replace(regexp_replace(text, '{_C['p']}', ' ', 'g'), '{_C['e']}', ' ', 'g'), '{_C['i']}', ' ', 'g') as rest from conversations),
b as (select *, len(list_filter(i, lambda x: not list_contains(e, x) and len(list_filter(p, lambda y: contains(y, x))) = 0)) as n from a),
c as (select conv_id, turn, len(e) as errors, list_filter([case when n > 0 then 'identifier' end, case when len(p) > 0 then 'path' end, case when len(e) > 0 then 'error' end, case when len(regexp_extract_all(rest, '[A-Za-zÀ-ÿ]{{2,}}')) >= 2 or regexp_matches(rest, '\\p{{Han}}{{2}}') then 'natural' end, case when regexp_matches(text, '{_C['d']}') then 'decision' end], lambda x: x is not null) as k from b)
select conv_id, turn, errors, case when len(k) = 0 then 'natural' when len(k) = 1 then k[1] else array_to_string(k, ',') || ',mixed' end as classes from c"""



def _intents() -> str:
    q = lambda x: x.replace("'", "''")
    pick = lambda i, other: "case " + " ".join(f"when regexp_matches(text, '{q(r[0])}') then '{r[i]}'" for r in classify.INTENTS) + f" else '{other}' end"
    more = ", ".join(f"({-1 - i}, 0, '{q(t)}')" for i, t in enumerate(SAID))
    return f"select conv_id, turn, {pick(1, 'recall')} as action, {pick(2, 'fallback')} as reason from (select conv_id, turn, text from conversations union all select * from (values {more}) v(conv_id, turn, text))"


ORACLES = {
    "intent_router": _intents(),
    "cosine_topk": "with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id as doc_id, greatest(0, least(1, (list_cosine_similarity(v, embedding::double[]) + 1) / 2)) as score from q, embeddings) select query_id, doc_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s) where rank <= 10",
    "cosine_neighbours": "with q as (select vec_id as query_id, embedding::double[] as v from embeddings), s as (select query_id, vec_id as doc_id, greatest(0, least(1, (list_cosine_similarity(v, embedding::double[]) + 1) / 2)) as score from q, embeddings) select query_id, doc_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s) where rank <= 3",
    "embedding_reconcile": f"with {STATES} select * from s",
    "embedding_stale_ratio": f"with {STATES} select count(*) as total, count(*) filter (where state <> 'fresh') as stale, round(count(*) filter (where state <> 'fresh') / cast(count(*) as double), 6) as stale_ratio, count(*) filter (where state <> 'fresh') / cast(count(*) as double) > 0.2 as degraded from s",
    "retrieval_metrics": f"with {CASES}, {_hits_sql('ha', 0.75)} select \"group\", {METRICS} from ha group by grouping sets ((\"group\"), ())",
    "ab_compare": f"with {ASCII_CASES}, {_hits_sql('ha', 0.75)}, {_hits_sql('hb', 0.1)} select case_id, ha.rank as rank_a, hb.rank as rank_b, case when coalesce(hb.rank, 1000) < coalesce(ha.rank, 1000) then 'improved' when coalesce(hb.rank, 1000) > coalesce(ha.rank, 1000) then 'regressed' else 'same' end as change from ha join hb using (case_id)",
    "ab_guard": f"with {CASES}, {_hits_sql('ha', 0.75)}, {_hits_sql('hb', 0.1)}, a as (select \"group\", {METRICS} from ha group by grouping sets ((\"group\"), ())), b as (select \"group\", {METRICS} from hb group by grouping sets ((\"group\"), ())) select a.\"group\", b.recall_1 >= a.recall_1 as recall_1_ok, b.recall_5 >= a.recall_5 as recall_5_ok, b.mrr >= a.mrr as mrr_ok, b.recall_1 >= a.recall_1 and b.recall_5 >= a.recall_5 and b.mrr >= a.mrr as safe from a join b on a.\"group\" is not distinct from b.\"group\"",
    "profile_selection": f"with {CASES}, {_hits_sql('h1', 0.0)}, {_hits_sql('h2', 0.5)}, {_hits_sql('h3', 0.75)} select * from (select {METRICS}, 'b000' as profile, 0.0::double as cost from h1 union all select {METRICS}, 'b050', 0.5 from h2 union all select {METRICS}, 'b075', 0.75 from h3) order by recall_1 desc, mrr desc, recall_5 desc, cost, profile limit 1",
    "identifier_fragments": f"select page_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(regexp_replace(url, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')), lambda x: len(x) between 3 and 64 and x not in ({', '.join(repr(g) for g in classify.GENERIC)}))), ',') as fragments from pages",
    "token_estimate": "with r as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}]', '', 'g') as rest from documents) select doc_id, cast(length(t) - length(rest) + ceil(strlen(rest) / 4.0) as bigint) as tokens from r",
    "truncate_excerpt": "with r as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') as t from documents) select doc_id, case when length(t) <= 240 then t else rtrim(substring(t, 1, 239), ' ') || '…' end as excerpt from r",
    "best_chunk": f"with l as (select doc_id, unnest(string_split(text, chr(10))) as chunk, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents), s as (select doc_id, pos, chunk, len(list_intersect(list_distinct({TOK.format(c='chunk')}), ['the', 'and', 'der', 'die', 'que', 'de', 'license'])) as score from l) select doc_id, score, pos, strlen(chunk) as bytes, chunk from (select *, row_number() over (partition by doc_id order by score desc, pos) as r from s) where r = 1",
    "html_link_extract": "with l as (select page_id, list_sort(list_distinct(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1))) as links from pages) select page_id, len(links) as n_links, array_to_string(links, ' ') as links from l",
    "near_dup_classes": f"with recursive {PRINTS}, e as (select a, b from pair union select b, a from pair), r as (select doc_id as id, doc_id as root from documents union select e.b, r.root from r join e on e.a = r.id) select id as doc_id, min(root) as class_id from r group by id",
    "query_classify": CLASSES,
    "near_dup_minhash": f"with {PRINTS}, {LISTED} select a, b, minhash_similarity from listed",
    "near_dup_simhash": f"with {PRINTS}, {LISTED}, bits as (select doc_id, i, sum(case when (s >> i) & 1 = 1 then w else -w end) as v from num, range(64) r(i) group by doc_id, i), sim as (select l.a, l.b, 1 - count(*) filter (where (round(x.v, 9) >= 0) <> (round(y.v, 9) >= 0)) / 64.0::double as simhash_similarity, any_value(l.minhash_similarity) as minhash_similarity from listed l join bits x on x.doc_id = l.a join bits y on y.doc_id = l.b and x.i = y.i group by l.a, l.b) select * from sim where simhash_similarity >= 0.84",
}
