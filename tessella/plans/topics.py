"""The snapshot runtime over `documents` as topics: compile, lanes, features, ranking.

Every document is a topic; its metadata follow from its id, language and source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import compile as compiler
from tessella.operators import planner, ranker, runtime, vectors
from tessella.scratch import scratch_dir
from tessella.session import table

ASKED = [
    (1, "the worthless trash of the nation"),
    (2, "released under the license version 3"),
    (3, "src3.load"),
    (4, "en/src4.py"),
    (5, "why do we use src5 notes on de"),
    (6, "zzzz qqqq"),
    (7, "src7 fr"),
    (8, "lib/en/src11.py raises srcc8.load"),
    (9, "doc_17"),
]


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


def topics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    when = lambda c, *values: F.when(c, F.array(*values)).otherwise(F.array().cast("array<string>"))
    lit = F.lit
    pair = F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0)
    rows = table(spark, sf_dir, "documents")
    name = F.concat(lit("doc_"), d.cast("string"))
    return rows.select(
        name.alias("doc_id"), lit(None).cast("string").alias("path"), F.split_part("text", lit("\n"), lit(1)).alias("description"), F.col("text").alias("body"), F.array(F.concat("source", lit(" notes on "), "lang")).alias("hooks"), F.array(F.concat(lit("MEMORY-"), "lang", lit(".md"))).alias("hook_paths"),
        F.concat(when(pair != "", pair), F.array(F.concat_ws(" ", "source", "lang"))).alias("triggers"), when(d % 3 == 0, F.concat(lit("lib/"), "lang", lit("/"), "source", lit(".py"))).alias("code_paths"), when(d % 6 == 0, F.concat("source", lit(".load"))).alias("code_symbols"), when(d % 9 == 0, F.concat(lit("test/"), "source", lit("_test.py#"), "lang")).alias("code_tests"),
        when(d % 4 == 0, F.concat("source", lit("-guide"))).alias("authority_docs"), when(d % 4 == 2, F.concat("source", lit("-guide"))).alias("history_docs"), when((d % 5 == 0) & (d > 0), F.concat(lit("doc_"), (d - 1).cast("string"))).alias("supersedes"), F.array("lang").alias("scopes"), F.array("source").alias("applies_to"),
        F.date_add(F.to_date(lit("2024-01-01")), (d % 400).cast("int")).alias("last_verified"), F.element_at(F.array(lit("observed"), lit("normative"), lit("user-confirmed")), (d % 3 + 1).cast("int")).alias("authority"),
    )


def tables_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The stored snapshot of these topics, compiled where the documents have changed."""
    return compiler.open_index(spark, f"{scratch_dir(spark)}/topics", [f"{sf_dir}/documents.parquet"], compiler.makers(topics_of(spark, sf_dir)))


def _asks(spark, sf_dir):
    return planner.analyse(asked(spark)), tables_of(spark, sf_dir)


def _shown(lane: DataFrame) -> DataFrame:
    evidence = F.array_join(F.array_sort(F.transform("evidence", lambda e: F.concat_ws("=", e["kind"], e["value"]))), ";")
    return lane.select("query_id", "doc_id", "score", "rank", F.array_join("fields", ",").alias("fields"), F.array_join("terms", ",").alias("terms"), evidence.alias("evidence"), F.round("strength", 6).alias("strength"))


def lane_exact(spark, sf_dir):
    return _shown(planner.exact_lane(*_asks(spark, sf_dir)))


def lane_bm25f(spark, sf_dir):
    return _shown(planner.bm25f_lane(*_asks(spark, sf_dir)))


def lane_ngram(spark, sf_dir):
    return _shown(planner.ngram_lane(*_asks(spark, sf_dir)))


def lane_fuzzy(spark, sf_dir):
    return _shown(planner.fuzzy_lane(*_asks(spark, sf_dir)))


def lane_graph(spark, sf_dir):
    asks, tables = _asks(spark, sf_dir)
    return _shown(planner.graph_lane(planner.exact_lane(asks, tables), tables))


def plan_counts(spark, sf_dir):
    """Candidates by channel and distinct documents of each query."""
    return planner.channel_counts(planner.all_lanes(*_asks(spark, sf_dir)))


def _answers(spark, sf_dir):
    """What an embedding adapter says of the asked queries: the vector of the same number stands for each."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    queries = asked(spark).join(rows, F.col("query_id") == F.col("vec_id")).select("query_id", "vector")
    found = vectors.cosine_top_k(queries, rows.withColumnRenamed("vec_id", "doc_id"), 100).withColumnRenamed("rank", "position")
    return found.join(runtime.invalid_candidates(found).select("query_id", "position"), ["query_id", "position"], "left_anti").withColumn("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))


def lane_embedding(spark, sf_dir):
    return planner.embedding_lane(_answers(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


def embedding_weighted(spark, sf_dir):
    """The ranking with the embedding lane in `weighted` mode."""
    rows = ranker.rank(asked(spark), tables_of(spark, sf_dir), _answers(spark, sf_dir), ranker.CHANNEL_WEIGHTS | {"embedding": 4})
    return rows.filter("rank <= 10").select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def query_analysis(spark, sf_dir):
    asks, _ = _asks(spark, sf_dir)
    join = lambda c: F.array_join(c, ",")
    return asks.select("query_id", join("classes").alias("classes"), join("anchors.paths").alias("paths"), join("anchors.identifiers").alias("identifiers"), join("anchors.errors").alias("errors"), join("fragments").alias("fragments"), join(F.array_sort("tokens")).alias("tokens"))


def _fused(spark, sf_dir):
    asks, tables = _asks(spark, sf_dir)
    return asks, tables, ranker.fuse(planner.all_lanes(asks, tables))


def ranked_features(spark, sf_dir):
    asks, tables, fused = _fused(spark, sf_dir)
    return ranker.features(asks, fused, tables).select("query_id", "doc_id", F.round("rrf", 6).alias("rrf"), *[F.round(f, 6).alias(f) for f in ranker.WEIGHTS])


def candidate_conflicts(spark, sf_dir):
    _, tables, fused = _fused(spark, sf_dir)
    return ranker.conflicts(fused, tables["documents"])


def ranked_candidates(spark, sf_dir):
    rows = ranker.rank(asked(spark), tables_of(spark, sf_dir))
    return rows.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "threshold", F.round("penalty", 6).alias("penalty"), "trusted")


def feature_score(spark, sf_dir):
    """The ten best candidates of each query by score."""
    return ranked_candidates(spark, sf_dir).filter("rank <= 10").select("query_id", "doc_id", "rank", "score")


def confidence_abstain(spark, sf_dir):
    return ranker.answer(asked(spark), tables_of(spark, sf_dir))[1].withColumn("top_score", F.round("top_score", 6)).withColumn("top_confidence", F.round("top_confidence", 6))


def ranked_explanations(spark, sf_dir):
    """All four lines of every candidate's explanation; no SQL twin: the numbers are those of ranked_candidates."""
    return ranker.rank(asked(spark), tables_of(spark, sf_dir)).select("query_id", "doc_id", F.array_join("explanation", "\n").alias("explanation"))


def ranked_answers(spark, sf_dir):
    """Diverse trusted candidates with their place."""
    return ranker.answer(asked(spark), tables_of(spark, sf_dir))[0].select("query_id", "doc_id", "position", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"))


def compiled_exact_map(spark, sf_dir):
    return tables_of(spark, sf_dir)["exact"].withColumn("documents", F.array_join("documents", ","))


def compiled_graph(spark, sf_dir):
    return tables_of(spark, sf_dir)["edges"]


def reverse_dependencies(spark, sf_dir):
    rows = compiler.reverse_dependencies(tables_of(spark, sf_dir)["edges"])
    return rows.select("id", F.array_join(F.transform("references", lambda r: F.concat_ws(" ", r["src"], r["kind"])), ",").alias("references"))


def compiled_terms(spark, sf_dir):
    return tables_of(spark, sf_dir)["terms"].select("term", "df", F.round("idf", 6).alias("idf"), "high")


def compile_actions(spark, sf_dir):
    """What an incremental compile does after some topics have changed and some were renamed."""
    topics = topics_of(spark, sf_dir)
    d = F.expr("cast(substring(doc_id, 5) as bigint)")
    now = topics.withColumn("body", F.when(d % 50 == 7, F.concat("body", F.lit(" edited"))).otherwise(F.col("body"))).withColumn("doc_id", F.when(d % 100 == 3, F.concat("doc_id", F.lit("x"))).otherwise(F.col("doc_id")))
    return compiler.plan(now, tables_of(spark, sf_dir))


QUERIES = {f.__name__: f for f in (query_analysis, lane_embedding, embedding_weighted, lane_exact, lane_bm25f, lane_ngram, lane_fuzzy, lane_graph, plan_counts, ranked_features, candidate_conflicts, ranked_candidates, feature_score, confidence_abstain, ranked_explanations, ranked_answers, compiled_exact_map, compiled_graph, reverse_dependencies, compiled_terms, compile_actions)}


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::varchar[]"


#: What the analysis of ASKED must give, by hand: classes, paths, identifiers, errors, fragments.
BY_HAND = {
    1: (["natural"], [], [], [], []),
    2: (["natural"], [], [], [], []),
    3: (["identifier"], [], ["src3.load"], [], ["src3", "load"]),
    4: (["path"], ["en/src4.py"], [], [], ["src4"]),
    5: (["natural", "decision", "mixed"], [], [], [], []),
    6: (["natural"], [], [], [], []),
    7: (["natural"], [], [], [], []),
    8: (["identifier", "path", "mixed"], ["lib/en/src11.py"], ["srcc8.load"], [], ["src11", "srcc8", "load"]),
    9: (["identifier"], [], ["doc_17"], [], ["doc"]),
}


def _base() -> str:
    """CTEs: topics t, values v, postings post, terms trm, fields fld, exact map ex, edges e, queries q."""
    from tessella.functions.tokenizer import sql_tokens

    fields = "unnest([{f: 'name', v: [doc_id]}, {f: 'hooks', v: hooks}, {f: 'description', v: case when description <> '' then [description] else [] end}, {f: 'triggers', v: triggers}, {f: 'codePath', v: code_paths}, {f: 'codeSymbol', v: code_symbols}, {f: 'codeTest', v: code_tests}, {f: 'authorityDocs', v: authority_docs}, {f: 'scopes', v: scopes}, {f: 'body', v: case when body <> '' then [body] else [] end}]) as x"
    when = lambda c, v: f"case when {c} then [{v}] else [] end"
    asks = ", ".join(f"({i}, '{s}', {', '.join(_sql_list(x) for x in BY_HAND[i])})" for i, s in ASKED)
    weights = ", ".join(f"('{f}', {s.weight}::double, {s.b}::double)" for f, s in planner.FIELDS.items())
    high = ", ".join(f"'{f}'" for f, s in planner.FIELDS.items() if s.high)
    return f"""t as (select 'doc_' || doc_id as doc_id, doc_id as d, coalesce(split_part(text, chr(10), 1), '') as description, coalesce(text, '') as body, [source || ' notes on ' || lang] as hooks, ['MEMORY-' || lang || '.md'] as hook_paths,
  case when regexp_extract(text, '[A-Za-z]+ [A-Za-z]+') <> '' then [regexp_extract(text, '[A-Za-z]+ [A-Za-z]+')] else [] end || [source || ' ' || lang] as triggers, {when('doc_id % 3 = 0', "'lib/' || lang || '/' || source || '.py'")} as code_paths, {when('doc_id % 6 = 0', "source || '.load'")} as code_symbols, {when('doc_id % 9 = 0', "'test/' || source || '_test.py#' || lang")} as code_tests,
  {when('doc_id % 4 = 0', "source || '-guide'")} as authority_docs, {when('doc_id % 4 = 2', "source || '-guide'")} as history_docs, {when('doc_id % 5 = 0 and doc_id > 0', "'doc_' || (doc_id - 1)")} as supersedes, [lang] as scopes, [source] as applies_to, date '2024-01-01' + cast(doc_id % 400 as int) as last_verified, ['observed', 'normative', 'user-confirmed'][doc_id % 3 + 1] as authority from documents),
v as (select doc_id, x.f as field, unnest(x.v) as value from (select doc_id, {fields} from t)),
txt as (select doc_id, field, string_agg(value, chr(10)) as text from v group by doc_id, field), tk as (select doc_id, field, {sql_tokens('text')} as toks from txt),
post as (select term, doc_id, field, len, count(*) as tf from (select doc_id, field, len(toks) as len, unnest(toks) as term from tk) group by all),
w(field, w, b) as (values {weights}), nn as (select count(*) as n from t), fld as (select w.field, w.w, w.b, coalesce(s.total, 0) / cast(nn.n as double) as avg_len from w cross join nn left join (select field, sum(tf) as total from post group by field) s on s.field = w.field),
trm as (select term, count(distinct doc_id) as df, ln(1 + (any_value(nn.n) - count(distinct doc_id) + 0.5) / (count(distinct doc_id) + 0.5)) as idf, bool_or(field in ({high})) as high from post, nn group by term),
xe as (select 'name' as kind, doc_id as value, doc_id from t union all select 'trigger', unnest(triggers), doc_id from t union all select 'path', unnest(code_paths), doc_id from t union all select 'basename', unnest(list_transform(code_paths, lambda p: string_split(p, '/')[-1])), doc_id from t
  union all select 'symbol', unnest(code_symbols), doc_id from t union all select 'symbol-suffix', unnest(list_transform(code_symbols, lambda p: string_split(p, '.')[-1])), doc_id from t union all select 'test', unnest(code_tests), doc_id from t union all select 'test', unnest(list_transform(code_tests, lambda p: string_split(split_part(p, '#', 1), '/')[-1])), doc_id from t
  union all select 'test-case', unnest(list_transform(code_tests, lambda p: split_part(p, '#', 2))), doc_id from t union all select 'doc-id', unnest(authority_docs), doc_id from t
  union all select 'error', unnest(regexp_extract_all(array_to_string(triggers || case when description <> '' then [description] else [] end, chr(10)), '\\b(?:[A-Z][A-Z0-9_.-]{{2,}}|[A-Za-z][A-Za-z0-9]*(?:Error|Exception)|[1-9]\\d{{3,}})\\b')), doc_id from t),
ex as (select kind, trim(lower(value), ' ') as normalized, min(value) as value, list_sort(list(distinct doc_id)) as documents from xe where trim(lower(value), ' ') <> '' group by 1, 2),
e as (select distinct 'l2:' || unnest(hook_paths) as src, 'topic:' || doc_id as dst, 'l2-hook' as kind from t union select 'topic:' || doc_id, 'document:' || unnest(authority_docs), 'authority-doc' from t union select 'topic:' || doc_id, 'document:' || unnest(history_docs), 'history-doc' from t
  union select 'topic:' || doc_id, 'topic:' || unnest(supersedes), 'supersedes' from t union select 'topic:' || doc_id, 'code:' || unnest(code_paths), 'code-evidence' from t union select 'topic:' || doc_id, 'code:' || unnest(code_tests), 'code-test' from t),
q0(query_id, query, classes, paths, ids, errors, frags) as (values {asks}), q as (select *, lower(query) as q, list_distinct({sql_tokens('query')}) as toks from q0)"""


def _lanes() -> str:
    """CTEs l_exact ... l_graph: query_id, channel, doc_id, score, rank, fields, terms, evidence, strength."""
    case = lambda at, x, other: "case " + x + " " + " ".join(f"when '{k}' then {v[at]!r}" for k, v in planner.KINDS.items()) + f" else {other} end"
    edge = lambda at: "case r.kind " + " ".join(f"when '{k}' then {v[at]}::double" for k, v in planner.EDGES.items()) + " else 0.5 end"
    generic = ", ".join(f"'{g}'" for g in planner.GENERIC_FRAGMENTS)
    fuzzy = ", ".join(f"'{k}'" for k in planner.FUZZY_KINDS)
    done = lambda name, rows: f"l_{name} as (select query_id, '{name}' as channel, doc_id, round(score, 6) as score, rank, fields, terms, evidence, strength from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from (select query_id, doc_id, sum(score) as score, list_sort(list_distinct(flatten(list(fields)))) as fields, list_sort(list_distinct(flatten(list(terms)))) as terms, list_sort(list_distinct(list(evidence))) as evidence, max(strength) as strength from ({rows}) group by query_id, doc_id)) where rank <= 50)"
    exact = done("exact", f"select query_id, unnest(documents) as doc_id, cast({case(0, 'kind', 0)} as double) as score, [{case(1, 'kind', chr(39) * 2)}] as fields, [normalized] as terms, kind || '=' || value as evidence, ({case(2, 'kind', 0)})::double * case when kind = 'trigger' and normalized <> q then 0.25 else 1 end as strength from xf")
    bm = done("bm25f", "select query_id, doc_id, s as score, fields, [term] as terms, 'term=' || term as evidence, 0.0::double as strength from tm where not (len(classes) = 1 and classes[1] = 'path')")
    gram = lambda x: f"list_distinct(list_transform(range(1, greatest(len({x}) - 1, 1)), lambda i: {x}[i:i+2]))"
    ngram = done("ngram", "select p.query_id, h.doc_id, p.alike * p.idf * h.w as score, h.fields, list_distinct([p.f, p.term]) as terms, 'ngram=' || p.f || '~' || p.term as evidence, 0.0::double as strength from ng p join hold h on h.term = p.term")
    fz = done("fuzzy", f"select query_id, unnest(documents) as doc_id, (1 - d / cast(greatest(len(word), len(fragment)) as double)) * ({case(0, 'kind', 1)}) as score, [{case(1, 'kind', chr(39) * 2)}] as fields, [word, fragment] as terms, 'edit-distance=' || word || '~' || fragment || ':' || d as evidence, 1 - d / cast(greatest(len(word), len(fragment)) as double) as strength from fm")
    graph = done("graph", f"select r.query_id, r.doc_id, {edge(0)} / r.place as score, ['graph:' || r.kind] as fields, [r.seed] as terms, r.kind || '=' || r.seed || '->' || r.doc_id || ' via ' || r.via as evidence, {edge(1)} as strength from gr r")
    return f"""an as (select query_id, unnest(list_distinct([q] || paths || list_transform(paths, lambda p: string_split(p, '/')[-1]) || ids || errors)) as a from q),
xf as (select distinct on (query_id, kind, normalized) query_id, kind, normalized, value, documents, q from (select an.query_id, ex.*, q.q from an join ex on ex.normalized = an.a join q on q.query_id = an.query_id
  union all select p.query_id, ex.*, p.q from (select query_id, q, unnest(paths) as p from q) p join ex on ex.kind = 'path' and (ends_with(ex.normalized, '/' || p.p) or ends_with(p.p, '/' || ex.normalized))
  union all select q.query_id, ex.*, q.q from q join ex on ex.kind = 'trigger' and length(ex.normalized) >= 4 and list_has_any(q.classes, ['natural', 'decision', 'error']) and regexp_matches(q.q, '(^|[^a-z0-9])' || regexp_escape(ex.normalized) || '([^a-z0-9]|$)'))),
{exact},
tm as (select q.query_id, any_value(q.classes) as classes, p.doc_id, p.term, any_value(trm.idf) as idf, list_sort(list(distinct p.field)) as fields, any_value(trm.idf) * sum(f.w * p.tf / greatest(1 - f.b + f.b * p.len / case when f.avg_len > 0 then f.avg_len else 1 end, 0.1)) * 2.2 / (sum(f.w * p.tf / greatest(1 - f.b + f.b * p.len / case when f.avg_len > 0 then f.avg_len else 1 end, 0.1)) + 1.2) as s
  from (select query_id, classes, unnest(toks) as term from q) q join post p on p.term = q.term join fld f on f.field = p.field join trm on trm.term = p.term group by q.query_id, p.doc_id, p.term),
{bm},
nq as (select query_id, f, {gram('f')} as g from (select query_id, unnest(list_distinct(list_filter(toks, lambda x: regexp_full_match(x, '[a-z0-9]{{4,64}}') and x not in ({generic})) || frags)) as f from q where not (len(classes) = 1 and classes[1] = 'path'))),
nt as (select term, idf, {gram('term')} as g from trm where high and regexp_full_match(term, '[a-z0-9]{{4,64}}')),
ns as (select query_id, f, term, idf, 2.0 * len(list_intersect(nq.g, nt.g)) / (len(nq.g) + len(nt.g)) as alike, len(list_intersect(nq.g, nt.g)) as shared, len(nq.g) as m from nq, nt where len(nq.g) > 0),
ng as (select * from (select *, row_number() over (partition by query_id, f order by round(alike, 9) desc, round(idf, 9) desc, term) as r from ns where shared >= least(2, m) and alike >= 0.45) where r <= 24),
hold as (select p.term, p.doc_id, max(f.w) as w, list_sort(list(distinct p.field)) as fields from post p join fld f on f.field = p.field where p.term in (select term from ng) group by p.term, p.doc_id),
{ngram},
fw as (select query_id, unnest(frags[1:8]) as word from q where list_has_any(classes, ['identifier', 'path', 'error']) and not (len(classes) = 1 and classes[1] = 'path')),
fx as (select distinct kind, normalized, documents, unnest(list_distinct(list_filter([lower(value)] || list_filter(string_split_regex(lower(regexp_replace(value, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 3), lambda x: regexp_full_match(x, '[a-z0-9]{{3,64}}')))) as fragment from ex where kind in ({fuzzy})),
fm as (select query_id, word, kind, documents, fragment, levenshtein(word, fragment) as d from fw join fx on levenshtein(word, fragment) between 1 and case when len(word) >= 9 then 2 else 1 end),
{fz},
sd as (select query_id, doc_id as seed, rank as place from (select *, row_number() over (partition by query_id order by rank) as n from l_exact where len(list_filter(evidence, lambda x: split_part(x, '=', 1) in ({fuzzy}))) > 0) where n <= 8),
bo as (select src, dst, kind from e union select dst, src, kind from e),
g1 as (select sd.query_id, sd.seed, sd.place, 'topic:' || sd.seed as src, bo.dst, bo.kind from sd join bo on bo.src = 'topic:' || sd.seed),
g2 as (select distinct query_id, seed, place, dst as target, kind, dst as via from g1 where starts_with(dst, 'topic:') union select g.query_id, g.seed, g.place, bo.dst, bo.kind, g.dst from g1 g join bo on bo.src = g.dst where not starts_with(g.dst, 'topic:') and starts_with(bo.dst, 'topic:') and bo.dst <> g.src),
gr as (select query_id, seed, place, substr(target, 7) as doc_id, kind, via from g2 where (query_id, substr(target, 7)) not in (select query_id, seed from sd) and substr(target, 7) in (select doc_id from t)),
{graph}, lanes as (select * from l_exact union all select * from l_bm25f union all select * from l_ngram union all select * from l_fuzzy union all select * from l_graph)"""


def _rank() -> str:
    """CTEs: fused candidates fu, conflicts cf, features ft, scores sc."""
    from tessella.functions.concepts import COMMON, sql_count

    case = lambda x, table, other: f"case {x} " + " ".join(f"when '{k}' then {v}::double" for k, v in table.items()) + f" else {other} end"
    top = sum(v / 11 for v in ranker.CHANNEL_WEIGHTS.values())
    high, anchor = (", ".join(f"'{f}'" for f in x) for x in (ranker.HIGH, ranker.ANCHORS))
    total = " + ".join(f"{f} * {float(x)}::double" for f, x in ranker.WEIGHTS.items())
    branch = lambda b: "(" + " + ".join(f"{f} * {float(x)}::double" for f, x in ranker.CONFIDENCE[b].items()) + ")"
    thresholds = "list_max(list_transform(q.classes, lambda c: " + case("c", ranker.fusion.THRESHOLDS, 0) + "))"
    return f"""fu as (select query_id, doc_id, sum({case('channel', ranker.CHANNEL_WEIGHTS, 0)} / (10 + rank)) / {top!r}::double as rrf, list(distinct channel) as channels, list_distinct(flatten(list(fields))) as fields,
  coalesce(max(strength) filter (where channel = 'exact'), 0) as exact_anchor, coalesce(max(strength) filter (where channel = 'fuzzy'), 0) as approximate_anchor, coalesce(max(strength) filter (where channel = 'graph'), 0) as graph_quality from lanes group by query_id, doc_id),
od as (select f.query_id, f.doc_id as newer, o.doc_id as older from (select fu.query_id, fu.doc_id, unnest(t.supersedes) as s from fu join t on t.doc_id = fu.doc_id) f join fu o on o.query_id = f.query_id and o.doc_id = f.s),
rl as (select a.query_id, a.doc_id as a, h.doc_id as h, a.r as reference from (select fu.query_id, fu.doc_id, unnest(authority_docs) as r from fu join t on t.doc_id = fu.doc_id) a join (select fu.query_id, fu.doc_id, unnest(history_docs) as r from fu join t on t.doc_id = fu.doc_id) h on h.query_id = a.query_id and h.r = a.r and h.doc_id <> a.doc_id),
cf as (select query_id, newer as doc_id, 'supersedes-candidate' as kind, older as "with", older as reference, 0.0::double as penalty from od union select query_id, older, 'superseded-by-candidate', newer, newer, 0.25::double from od union select query_id, a, 'authority-role-disagreement', h, reference, 0.03::double from rl union select query_id, h, 'authority-role-disagreement', a, reference, 0.03::double from rl),
pn as (select query_id, doc_id, sum(p) as penalty from (select query_id, doc_id, kind, max(penalty) as p from cf group by query_id, doc_id, kind) group by query_id, doc_id),
qw as (select query_id, sum(coalesce(trm.idf, ln(1 + (nn.n + 0.5) / 0.5))) as qw from (select query_id, unnest(toks) as term from q) x cross join nn left join trm on trm.term = x.term group by query_id),
lx as (select query_id, doc_id, sum(idf) as mw, count(*) as m, list_filter(list(case when list_has_any(fields, [{high}]) then term end), lambda x: x is not null) as high, count(*) filter (where list_has_any(fields, [{anchor}])) as a from tm group by query_id, doc_id),
gen as (select coalesce(list(term), []) as g from trm cross join nn where df > 1 and df >= {COMMON} * nn.n),
ft as (select fu.*, 0.0::double as embedding_similarity, coalesce(lx.mw / qw.qw, 0) as query_coverage, least(1.0, coalesce(lx.m, 0) / 5.0::double) as matched_terms, least(1.0, coalesce({sql_count('q.query', 'lx.high', 'gen.g')}, 0) / 2.0::double) as high_signal_concepts, least(1.0, coalesce(len(lx.high), 0) / 5.0::double) as high_signal_terms, least(1.0, coalesce(lx.a, 0) / 2.0::double) as anchor_terms,
  least(1.0, len(list_intersect(fu.fields, [{high}])) / 4.0::double) as field_coverage, len(list_intersect(st.s, q.toks)) / cast(len(st.s) as double) as scope_overlap, {case('t.authority', ranker.AUTHORITY, 0)} as authority,
  least(1.0, 0.1 + case when len(t.authority_docs) > 0 then 0.25 else 0 end + case when len(t.code_paths) > 0 then 0.2 else 0 end + case when len(t.code_symbols) > 0 then 0.2 else 0 end + case when len(t.code_tests) > 0 then 0.25 else 0 end)::double as evidence,
  power(0.5::double, datediff('day', t.last_verified, max(t.last_verified) over (partition by fu.query_id)) / 365.0::double) as freshness, least(1.0, len(list_filter(fu.channels, lambda c: c not in ('graph', 'embedding'))) / 4.0::double) as channel_diversity, q.classes
  from fu join t on t.doc_id = fu.doc_id join q on q.query_id = fu.query_id join qw on qw.query_id = fu.query_id cross join gen left join lx on lx.query_id = fu.query_id and lx.doc_id = fu.doc_id join (select doc_id, list_distinct({_scopes()}) as s from t) st on st.doc_id = t.doc_id),
s0 as (select ft.*, coalesce(pn.penalty, 0) as penalty, {thresholds} as threshold, greatest(exact_anchor, {branch('concept')}, {branch('density')}, case when list_contains(q.classes, 'natural') then 0 else {branch('approximate')} end) as sure from ft join q on q.query_id = ft.query_id left join pn on pn.query_id = ft.query_id and pn.doc_id = ft.doc_id),
s1 as (select *, greatest(0.0, least(1.0, (rrf + {total}) / (1 + {sum(ranker.WEIGHTS.values())!r}::double) * (1 - least(0.9, penalty)))) as score, sure * (1 - least(0.9, penalty)) as confidence from s0),
sc as (select *, round(confidence, 9) >= threshold as trusted, row_number() over (partition by query_id order by round(score, 9) desc, round(rrf, 9) desc, doc_id) as rank from s1)"""


def _scopes() -> str:
    from tessella.functions.tokenizer import sql_tokens

    return sql_tokens("array_to_string(scopes || applies_to, ' ')")


_SHOWN = "select query_id, doc_id, score, rank, array_to_string(fields, ',') as fields, array_to_string(terms, ',') as terms, array_to_string(evidence, ';') as evidence, round(strength, 6) as strength from l_{name}"
_WITH = f"with {_base()}"
ORACLES = {
    "query_analysis": _WITH + " select query_id, array_to_string(classes, ',') as classes, array_to_string(paths, ',') as paths, array_to_string(ids, ',') as identifiers, array_to_string(errors, ',') as errors, array_to_string(frags, ',') as fragments, array_to_string(list_sort(toks), ',') as tokens from q",
    **{f"lane_{n}": f"{_WITH}, {_lanes()} {_SHOWN.format(name=n)}" for n in ("exact", "bm25f", "ngram", "fuzzy", "graph")},
    "lane_embedding": f"{_WITH}, c as (select q.query_id, 'doc_' || b.vec_id as doc_id, round(greatest(0, least(1, (list_cosine_similarity(a.embedding::double[], b.embedding::double[]) + 1) / 2)), 6) as score, b.vec_id, row_number() over (partition by q.query_id order by round((list_cosine_similarity(a.embedding::double[], b.embedding::double[]) + 1) / 2, 9) desc, b.vec_id) as n from q join embeddings a on a.vec_id = q.query_id, embeddings b), r as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from c where n <= 100) select * from r where rank <= {planner.PER_LANE}",
    "plan_counts": f"{_WITH}, {_lanes()} select query_id, " + ", ".join(f"count(*) filter (where channel = '{c}') as {c}" for c in planner.CHANNELS) + ", count(distinct doc_id) as documents from lanes group by query_id",
    "ranked_features": f"{_WITH}, {_lanes()}, {_rank()} select query_id, doc_id, round(rrf, 6) as rrf, " + ", ".join(f"round({f}, 6) as {f}" for f in ranker.WEIGHTS) + " from ft",
    "candidate_conflicts": f"{_WITH}, {_lanes()}, {_rank()} select * from cf",
    "ranked_candidates": f"{_WITH}, {_lanes()}, {_rank()} select query_id, doc_id, rank, round(score, 6) as score, round(confidence, 6) as confidence, threshold, round(penalty, 6) as penalty, trusted from sc",
    "feature_score": f"{_WITH}, {_lanes()}, {_rank()} select query_id, doc_id, rank, round(score, 6) as score from sc where rank <= 10",
    "confidence_abstain": f"{_WITH}, {_lanes()}, {_rank()} select q.query_id, count(sc.doc_id) as candidates, count(*) filter (where sc.trusted) as trusted, round(max(sc.score), 6) as top_score, round(max(sc.confidence), 6) as top_confidence, count(*) filter (where sc.trusted) = 0 as abstained, case when count(sc.doc_id) = 0 then 'no-trusted-candidate' when count(*) filter (where sc.trusted) = 0 then 'below-threshold' end as reason from q left join sc on sc.query_id = q.query_id group by q.query_id",
    "compiled_exact_map": _WITH + " select kind, normalized, value, array_to_string(documents, ',') as documents from ex",
    "compiled_graph": _WITH + " select * from e",
    "reverse_dependencies": _WITH + " select dst as id, string_agg(src || ' ' || kind, ',' order by src, kind) as \"references\" from e group by dst",
    "compiled_terms": _WITH + " select term, df, round(idf, 6) as idf, high from trm",
    "compile_actions": _WITH + """, c as (select case when d % 100 = 3 then doc_id || 'x' else doc_id end as id, d % 50 = 7 as edited from t), b as (select coalesce(c.id, t.doc_id) as id, case when c.id is null then 'delete' when t.doc_id is null or c.edited then 'compile' else 'reuse' end as action from c full outer join t on t.doc_id = c.id),
z as (with recursive r as (select 'topic:' || id as id from b where action <> 'reuse' union select e.src from e join r on e.dst = r.id) select id from r)
select id, case when action = 'reuse' and 'topic:' || id in (select id from z) then 'invalidated' else action end as action from b""",
}
