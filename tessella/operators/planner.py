"""Candidates of a batch of queries from the tables of a snapshot (operators/compile.py): six lanes, each ranked.

A lane's rows: query_id, channel, doc_id, score, rank, fields, terms, evidence (kind, value), strength (what the ranker
takes of it).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import classify, tokenizer
from tessella.functions.text import character_trigrams, edit_budget, edit_lookups
from tessella.operators import index, lanes
from tessella.operators.compile import FUZZY_KINDS
from tessella.operators.search import FIELDS
from tessella.scratch import keep

CHANNELS = ("exact", "bm25f", "ngram", "fuzzy", "graph", "embedding")
#: Limits of a query, of a lane, of fuzzy fragments, of terms a fragment, of graph seeds.
QUERY_LENGTH, PER_LANE, MOST_FRAGMENTS, PER_FRAGMENT, SEEDS = 2_000, 50, 8, 24, 8
#: The score, the field and the strength of each kind of the exact map.
KINDS = {
    "name": (12, "name", 0.9),
    "trigger": (7, "triggers", 0.72),
    "path": (14, "codePath", 1.0),
    "basename": (11, "codePath", 0.88),
    "symbol": (15, "codeSymbol", 1.0),
    "symbol-suffix": (12, "codeSymbol", 0.9),
    "test": (12, "codeTest", 0.92),
    "test-case": (13, "codeTest", 0.96),
    "doc-id": (10, "authorityDocs", 0.82),
    "error": (14, "error", 1.0),
}
#: Score and strength of each kind of edge; a trigger that is not the whole query has a quarter.
EDGES = {"wiki-link": (1.0, 1.0), "supersedes": (0.95, 0.95), "authority-doc": (0.85, 0.85), "history-doc": (0.75, 0.7), "code-evidence": (0.8, 0.8), "code-test": (0.8, 0.8), "l2-hook": (0.55, 0.55)}
PART_OF_QUERY = 0.25
#: Fragments too common to match by.
GENERIC_FRAGMENTS = ("file", "files", "lib", "script", "scripts", "source", "spec", "src", "test", "tests")
#: Batches of up to this many distinct fragments are compared with every indexed one, in one pass and without their keys; more
#: of them are looked up by keys. Both ways give the same rows.
COMPARED = 64
#: Similarity of trigrams, and shortest triggers that are looked for within a query (Han: characters).
LEAST_DICE, LEAST_SHARED, SHORTEST_TRIGGER, SHORTEST_HAN = 0.45, 2, 4, 2


def _pick(table: Mapping[str, tuple], at: int, key: Column, other) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v[at]))])[key], F.lit(other))


def analyse(queries: DataFrame) -> DataFrame:
    """(query_id, query) with normalized, anchors, classes, tokens and fragments. Empty queries and such of more than 2,000
    characters are left out."""
    ok = queries.select("query_id", F.trim("query").alias("query")).filter((F.length("query") > 0) & (F.length("query") <= QUERY_LENGTH))
    tokenize = tokenizer.batch_tokenizer(ok, "query")
    plain = ok.filter(~tokenizer.is_plain(F.col("query"))).isEmpty()
    out = ok.withColumn("normalized", F.lower("query") if plain else tokenizer.normalized(F.col("query"))).withColumn("anchors", classify.anchors(F.col("query")))
    out = out.withColumn("classes", classify.runtime_classes(F.col("query"), F.col("anchors"))).withColumn("tokens", F.array_distinct(tokenize(F.col("query"))))
    return keep(out.withColumn("fragments", F.filter(classify.identifier_fragments(F.col("query")), lambda x: ~x.isin(*GENERIC_FRAGMENTS))), "queries")


def ranked(found: DataFrame, channel: str, limit: int = PER_LANE) -> DataFrame:
    """Evidence rows (query_id, doc_id, score, fields, terms, evidence, strength) added up per document and cut to the best
    `limit` by score, then document."""
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    best = found.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"), sets("fields").alias("fields"), sets("terms").alias("terms"), F.array_sort(F.collect_set("evidence")).alias("evidence"), F.max("strength").alias("strength"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).withColumn("score", F.round("score", 6)).withColumn("channel", F.lit(channel))


def _evidence(kind: Column | str, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value")).alias("evidence")


def exact_lane(asks: DataFrame, tables: Mapping[str, DataFrame], limit: int = PER_LANE) -> DataFrame:
    entries = tables["exact"]
    paths = F.col("anchors.paths")
    names = F.concat(F.array("normalized"), paths, F.transform(paths, lambda p: F.element_at(F.split(p, "/"), -1)), F.col("anchors.identifiers"), F.col("anchors.errors"))
    whole = asks.select("query_id", F.explode(F.array_distinct(names)).alias("normalized")).join(entries, "normalized").select("query_id", "kind", "normalized", "value", "documents")
    by_path = lanes.suffix_matches(asks.select("query_id", F.explode("anchors.paths").alias("path")), entries.filter("kind = 'path'").select(F.col("normalized").alias("doc_id"), F.replace("normalized", F.lit("\\"), F.lit("/")).alias("path")))
    by_path = by_path.select("query_id", F.lit("path").alias("kind"), F.col("doc_id").alias("normalized")).join(entries, ["kind", "normalized"]).select(whole.columns)
    known = entries.filter("kind = 'trigger'")
    wide = asks.filter(F.arrays_overlap("classes", F.array(F.lit("natural"), F.lit("decision"), F.lit("error"))))
    is_han = F.col("normalized").rlike(r"\A\p{IsHan}+\z")
    known = known.filter(F.length("normalized") >= F.when(is_han, SHORTEST_HAN).otherwise(SHORTEST_TRIGGER))
    within = lanes.delimited(wide, known).join(known, "normalized").select(whole.columns)
    found = whole.unionByName(by_path).unionByName(within).dropDuplicates(["query_id", "kind", "normalized"]).join(asks.select("query_id", F.col("normalized").alias("q")), "query_id")
    kind = F.col("kind")
    whole_query = (kind != "trigger") | (F.trim("normalized") == F.col("q"))
    strength = _pick(KINDS, 2, kind, 0.0) * F.when(whole_query, 1.0).otherwise(PART_OF_QUERY)
    rows = found.select("query_id", F.explode("documents").alias("doc_id"), _pick(KINDS, 0, kind, 0).cast("double").alias("score"), F.array(_pick(KINDS, 1, kind, "")).alias("fields"), F.array("normalized").alias("terms"), _evidence(kind, F.col("value")), strength.alias("strength"))
    return ranked(rows, "exact", limit)


def _open(asks: DataFrame) -> DataFrame:
    """Queries that are more than a path: a path alone asks for nothing beyond itself."""
    return asks.filter(~((F.size("classes") == 1) & (F.col("classes")[0] == "path")))


def term_matches(asks: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(query_id, doc_id, term, s, idf, fields) of all query tokens."""
    asked = asks.select("query_id", F.explode("tokens").alias("term"))
    return index.term_scores(index.hits(tables, asked), tables, "doc_id", {f: (s.weight, s.b) for f, s in FIELDS.items()})


def bm25f_lane(asks: DataFrame, tables: Mapping[str, DataFrame], limit: int = PER_LANE) -> DataFrame:
    rows = term_matches(_open(asks), tables).select("query_id", "doc_id", F.col("s").alias("score"), "fields", F.array("term").alias("terms"), _evidence("term", F.col("term")), F.lit(0.0).alias("strength"))
    return ranked(rows, "bm25f", limit)


def ngram_lane(asks: DataFrame, tables: Mapping[str, DataFrame], limit: int = PER_LANE) -> DataFrame:
    wide = _open(asks)
    plain = F.filter("tokens", lambda t: t.rlike("^[a-z0-9]{4,64}$") & ~t.isin(*GENERIC_FRAGMENTS))
    asked = wide.select("query_id", F.explode(F.array_union(plain, F.col("fragments"))).alias("fragment")).withColumn("g", character_trigrams(F.col("fragment"))).filter("size(g) > 0").select("query_id", "fragment", F.size("g").alias("m"), F.explode("g").alias("term"))
    both = index.matching(tables["grams"], asked).join(asked, "term").groupBy("query_id", "fragment", "m", "of", "idf", "n").agg(F.count(F.lit(1)).alias("shared"))
    both = both.withColumn("alike", 2 * F.col("shared") / (F.col("m") + F.col("n"))).filter((F.col("shared") >= F.least(F.lit(LEAST_SHARED), F.col("m"))) & (F.col("alike") >= LEAST_DICE))
    order = Window.partitionBy("query_id", "fragment").orderBy(F.desc(F.round("alike", 9)), F.desc(F.round("idf", 9)), "of")
    near = both.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= PER_FRAGMENT).select("query_id", "fragment", F.col("of").alias("term"), "alike", "idf")
    han = wide.select("query_id", F.explode(F.filter("tokens", lambda t: t.rlike(r"\A\p{IsHan}{2,3}\z"))).alias("term"))
    han = han.join(index.matching(tables["terms"], han), "term").select("query_id", F.col("term").alias("fragment"), "term", F.lit(1.0).alias("alike"), "idf")
    pairs = keep(near.unionByName(han), "ngrams")
    weight = F.create_map(*[x for f, s in FIELDS.items() for x in (F.lit(f), F.lit(float(s.weight)))])
    held = index.matching(tables["postings"], pairs).groupBy("term", "doc_id").agg(F.max(weight[F.col("field")]).alias("w"), F.array_sort(F.collect_set("field")).alias("fields"))
    rows = pairs.join(held, "term").select("query_id", "doc_id", (F.col("alike") * F.col("idf") * F.col("w")).alias("score"), "fields", F.array_distinct(F.array("fragment", "term")).alias("terms"), _evidence("ngram", F.concat_ws("~", "fragment", "term")), F.lit(0.0).alias("strength"))
    return ranked(rows, "ngram", limit)


def fuzzy_lane(asks: DataFrame, tables: Mapping[str, DataFrame], limit: int = PER_LANE) -> DataFrame:
    some = _open(asks).filter(F.arrays_overlap("classes", F.array(F.lit("identifier"), F.lit("path"), F.lit("error"))))
    words = keep(some.select("query_id", F.explode(F.slice("fragments", 1, MOST_FRAGMENTS)).alias("word")).withColumn("k", edit_budget(F.col("word"))), "words")
    if words.select("word").distinct().limit(COMPARED + 1).count() <= COMPARED:
        apart = F.levenshtein("word", "fragment", 2)  # two is the largest budget; -1 beyond it
        found = tables["fuzzy"].join(F.broadcast(words), (apart > 0) & (apart <= F.col("k"))).withColumn("d", apart)
    else:
        asked = words.select("word", F.explode(edit_lookups(F.col("word"))).alias("term")).distinct()
        near = index.matching(tables["near"], asked).join(asked, "term").select("word", "fragment").distinct().withColumn("d", F.levenshtein("word", "fragment"))
        found = words.join(near, "word").filter((F.col("d") > 0) & (F.col("d") <= F.col("k"))).join(tables["fuzzy"], "fragment")
    alike = 1 - F.col("d") / F.greatest(F.length("word"), F.length("fragment"))
    rows = found.select("query_id", F.explode("documents").alias("doc_id"), (alike * _pick(KINDS, 0, F.col("kind"), 1)).alias("score"), F.array(_pick(KINDS, 1, F.col("kind"), "")).alias("fields"), F.array("word", "fragment").alias("terms"), _evidence("edit-distance", F.concat(F.col("word"), F.lit("~"), F.col("fragment"), F.lit(":"), F.col("d").cast("string"))), alike.alias("strength"))
    return ranked(rows, "fuzzy", limit)


def graph_lane(exact: DataFrame, tables: Mapping[str, DataFrame], limit: int = PER_LANE) -> DataFrame:
    """From the best exact candidates (of other kinds than triggers) to the topics next to them, and to those that share a
    document, a hook file or a piece of code with them. Seeds are no targets."""
    seeds = exact.filter(F.exists("evidence", lambda e: e["kind"].isin(*FUZZY_KINDS)))
    order = Window.partitionBy("query_id").orderBy("rank")
    seeds = keep(seeds.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SEEDS).select("query_id", F.col("doc_id").alias("seed"), F.col("rank").alias("at"), F.concat(F.lit("topic:"), "doc_id").alias("src")), "seeds")
    edge = tables["edges"]
    both = edge.unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")).distinct()
    first = seeds.join(both, "src")
    near = first.filter("dst like 'topic:%'").select("query_id", "seed", "at", F.col("dst").alias("target"), "kind", F.col("dst").alias("via"))
    shared = first.filter("not dst like 'topic:%'").select("query_id", "seed", "at", "src", F.col("dst").alias("via")).distinct()
    far = shared.join(both.select(F.col("src").alias("via"), F.col("dst").alias("target"), "kind"), "via").filter("target like 'topic:%' and target <> src").select(near.columns)
    target = F.expr("substring(target, 7)")
    found = near.unionByName(far).dropDuplicates(["query_id", "seed", "target", "kind", "via"]).withColumn("doc_id", target)
    found = found.join(seeds.select("query_id", F.col("seed").alias("doc_id")), ["query_id", "doc_id"], "left_anti").join(tables["ids"], "doc_id", "left_semi")
    value = F.concat("seed", F.lit("->"), "doc_id", F.lit(" via "), "via")
    rows = found.select("query_id", "doc_id", (_pick(EDGES, 0, F.col("kind"), 0.5) / F.col("at")).alias("score"), F.array(F.concat(F.lit("graph:"), "kind")).alias("fields"), F.array("seed").alias("terms"), _evidence(F.col("kind"), value), _pick(EDGES, 1, F.col("kind"), 0.0).alias("strength"))
    return ranked(rows, "graph", limit)


def embedding_lane(answers: DataFrame, limit: int = PER_LANE) -> DataFrame:
    """Validated answers of an embedding adapter (query_id, doc_id, score) as a lane."""
    rows = answers.select("query_id", "doc_id", F.col("score").cast("double").alias("score"), F.array(F.lit("embedding")).alias("fields"), F.array().cast("array<string>").alias("terms"), _evidence("embedding-score", F.format_string("%.6f", F.col("score").cast("double"))), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score").cast("double"))).alias("strength"))
    return ranked(rows, "embedding", limit)


def all_lanes(asks: DataFrame, tables: Mapping[str, DataFrame], answers: DataFrame | None = None, limit: int = PER_LANE) -> DataFrame:
    """The candidates of all lanes, written once."""
    exact = keep(exact_lane(asks, tables, limit), "exact-lane")
    out = exact
    for lane in (bm25f_lane(asks, tables, limit), ngram_lane(asks, tables, limit), fuzzy_lane(asks, tables, limit), graph_lane(exact, tables, limit)):
        out = out.unionByName(lane)
    if answers is not None:
        out = out.unionByName(embedding_lane(answers, limit))
    return keep(out, "lanes")


def fused_variants(candidates: DataFrame, k: int = 10, limit: int = PER_LANE) -> DataFrame:
    """Lanes of phrasings (query_id, variant, ...) to lanes of queries: reciprocal ranks add up within each channel."""
    parts = [ranked(candidates.filter(F.col("channel") == c).select("query_id", "doc_id", (1 / (k + F.col("rank"))).alias("score"), "fields", "terms", F.explode_outer("evidence").alias("evidence"), "strength", "variant").groupBy("query_id", "doc_id", "variant", "score", "fields", "terms", "strength").agg(F.collect_list("evidence").alias("e")).select("query_id", "doc_id", "score", "fields", "terms", "strength", F.col("e").alias("evidence")), c, limit) for c in CHANNELS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("evidence", F.array_sort(F.array_distinct(F.flatten("evidence"))))


def channel_counts(candidates: DataFrame) -> DataFrame:
    """Per query: how many candidates each channel has, and how many documents they are."""
    each = candidates.groupBy("query_id").pivot("channel", list(CHANNELS)).agg(F.count(F.lit(1)))
    return each.select("query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in CHANNELS]).join(candidates.groupBy("query_id").agg(F.count_distinct("doc_id").alias("documents")), "query_id")
