"""Rank the candidates of a snapshot's lanes (operators/planner.py): fusion, conflicts, features, score, confidence, diversity.

Everything is a relation over (query_id, doc_id); a batch of queries is ranked at once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import concepts
from tessella.functions.math import clamp
from tessella.operators import fusion, index, planner
from tessella.operators.search import FIELDS
from tessella.scratch import keep

#: Weights of channels and features, of the branches of confidence, and strengths.
CHANNEL_WEIGHTS = {"exact": 8, "bm25f": 16, "ngram": 0.1, "fuzzy": 0.25, "graph": 0.05, "embedding": 0}
RRF_WEIGHT = 1
WEIGHTS = {
    "exact_anchor": 0.15,
    "approximate_anchor": 0,
    "embedding_similarity": 0,
    "query_coverage": 0.2,
    "matched_terms": 0.15,
    "high_signal_concepts": 0.3,
    "high_signal_terms": 0.15,
    "anchor_terms": 0.15,
    "field_coverage": 0.2,
    "scope_overlap": 0.01,
    "authority": 0.01,
    "evidence": 0.01,
    "freshness": 0.01,
    "graph_quality": 0.02,
    "channel_diversity": 0.05,
}
CONFIDENCE = {
    "approximate": {"approximate_anchor": 0.85, "field_coverage": 0.1, "channel_diversity": 0.05},
    "embedding": {"embedding_similarity": 1},
    "concept": {"high_signal_concepts": 0.55, "high_signal_terms": 0.2, "field_coverage": 0.15, "query_coverage": 0.1},
    "density": {"matched_terms": 0.55, "query_coverage": 0.35, "field_coverage": 0.1},
}
AUTHORITY = {"observed": 0.75, "normative": 1.0, "user-confirmed": 0.95}
EVIDENCE = {"has_hook": 0.1, "has_authority_doc": 0.25, "has_code": 0.2, "has_symbol": 0.2, "has_test": 0.25}
HALF_LIFE_DAYS = 365
SUPERSEDED, ROLE = 0.25, 0.03
#: How many make a feature whole.
WHOLE = {"matched_terms": 5, "high_signal_concepts": 2, "high_signal_terms": 5, "anchor_terms": 2, "field_coverage": 4, "channel_diversity": 4}
#: Here scopes count as high-signal, unlike in direct search.
HIGH = tuple(f for f, s in FIELDS.items() if s.high or f == "scopes")
ANCHORS = tuple(f for f, s in FIELDS.items() if s.anchor)


def _in(names) -> Column:
    return F.array(*map(F.lit, names))


def fuse(candidates: DataFrame, weights: Mapping[str, float] = CHANNEL_WEIGHTS, k: int = fusion.RRF_K) -> DataFrame:
    """(query_id, doc_id) with rrf (over its maximum), ranks by channel, fields, terms, evidence, and the strengths of exact,
    fuzzy, graph and embedding evidence."""
    table = F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(float(w)))])
    top = sum(w / (k + 1) for w in weights.values())
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    of = lambda c: F.coalesce(F.max(F.when(F.col("channel") == c, F.col("strength"))), F.lit(0.0))
    named = F.transform("evidence", lambda e: F.struct(F.col("channel").alias("channel"), e["kind"].alias("kind"), e["value"].alias("value")))
    out = candidates.groupBy("query_id", "doc_id").agg(
        (F.sum(table[F.col("channel")] / (k + F.col("rank"))) / top).alias("rrf"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("ranks"), sets("fields").alias("fields"), sets("terms").alias("terms"),
        sets(named).alias("evidence"), of("exact").alias("exact_anchor"), of("fuzzy").alias("approximate_anchor"), of("graph").alias("graph_quality"), of("embedding").alias("embedding_similarity"),
    )
    return out


def unknown(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates that no document of the snapshot is: there must be none."""
    return candidates.join(documents.select("doc_id"), "doc_id", "left_anti")


def conflicts(fused: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id, kind, with, reference, penalty) between candidates of a query: one supersedes the other, or one
    holds a document as authority that the other holds as history. Equi-joins on the query and the reference."""
    held = fused.select("query_id", "doc_id").join(documents.select("doc_id", "supersedes", "authority_docs", "history_docs"), "doc_id")
    older = held.select("query_id", F.col("doc_id").alias("newer"), F.explode("supersedes").alias("doc_id")).join(fused.select("query_id", "doc_id"), ["query_id", "doc_id"])
    row = lambda df, doc, kind, other, reference, penalty: df.select("query_id", F.col(doc).alias("doc_id"), F.lit(kind).alias("kind"), F.col(other).alias("with"), F.col(reference).alias("reference"), F.lit(float(penalty)).alias("penalty"))
    out = row(older, "newer", "supersedes-candidate", "doc_id", "doc_id", 0).unionByName(row(older, "doc_id", "superseded-by-candidate", "newer", "newer", SUPERSEDED))
    side = lambda c, name: held.select("query_id", F.col("doc_id").alias(name), F.explode(F.array_distinct(c)).alias("reference"))
    roles = side("authority_docs", "a").join(side("history_docs", "h"), ["query_id", "reference"]).filter("a <> h")
    both = row(roles, "a", "authority-role-disagreement", "h", "reference", ROLE).unionByName(row(roles, "h", "authority-role-disagreement", "a", "reference", ROLE))
    return out.unionByName(both).distinct()


def penalties(found: DataFrame) -> DataFrame:
    """(query_id, doc_id, penalty): the worst of each kind, kinds add up."""
    return found.groupBy("query_id", "doc_id", "kind").agg(F.max("penalty").alias("p")).groupBy("query_id", "doc_id").agg(F.sum("p").alias("penalty"))


def lexical(asks: DataFrame, tables: Mapping[str, DataFrame], among: DataFrame) -> DataFrame:
    """(query_id, doc_id) of `among` with query_coverage (by idf), matched_terms, high_signal_concepts, high_signal_terms,
    anchor_terms; pairs without a shared term are left out."""
    asked = asks.select("query_id", F.explode("tokens").alias("term"))
    found = planner.term_matches(asks, tables).join(among.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    n = F.broadcast(tables["fields"].agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")))  # one row
    weighed = asked.join(index.matching(tables["terms"], asked).select("term", "idf"), "term", "left").crossJoin(n).groupBy("query_id").agg(F.sum(F.coalesce("idf", index.idf(F.col("n"), F.lit(0)))).alias("query_weight"))
    high, anchor = F.arrays_overlap("fields", _in(HIGH)), F.arrays_overlap("fields", _in(ANCHORS))
    per = found.groupBy("query_id", "doc_id").agg(F.sum("idf").alias("w"), F.count(F.lit(1)).alias("m"), F.array_sort(F.collect_set(F.when(high, F.col("term")))).alias("high"), F.count_if(anchor).alias("a"))
    generic = concepts.common_terms(tables)
    segments = concepts.with_segments(asks.select("query_id", "query"), generic=generic)
    per = per.join(weighed, "query_id").join(segments, "query_id")
    share = lambda c, name: F.least(F.lit(1.0), c / WHOLE[name]).alias(name)
    spoken = concepts.count(F.col("segments"), F.col("high"), generic, concepts.has_han(asks))
    return per.select("query_id", "doc_id", F.coalesce(F.col("w") / F.nullif("query_weight", F.lit(0.0)), F.lit(0.0)).alias("query_coverage"), share(F.col("m"), "matched_terms"), share(spoken, "high_signal_concepts"), share(F.size("high"), "high_signal_terms"), share(F.col("a"), "anchor_terms"))


LEXICAL = ("query_coverage", "matched_terms", "high_signal_concepts", "high_signal_terms", "anchor_terms")


def features(asks: DataFrame, fused: DataFrame, tables: Mapping[str, DataFrame], weights: Mapping[str, float] = CHANNEL_WEIGHTS) -> DataFrame:
    """fused with the fifteen features (see WEIGHTS). Freshness is relative to the newest candidate of the query."""
    rows = fused.join(tables["documents"], "doc_id").join(asks.select("query_id", "tokens"), "query_id")
    rows = rows.join(lexical(asks, tables, fused), ["query_id", "doc_id"], "left").fillna(0.0, list(LEXICAL))
    age = F.datediff(F.max("last_verified").over(Window.partitionBy("query_id")), F.col("last_verified"))
    evidence = F.lit(0.0)
    for c, w in EVIDENCE.items():
        evidence = evidence + F.when(F.col(c), w).otherwise(0.0)
    authority = F.create_map(*[x for a, w in AUTHORITY.items() for x in (F.lit(a), F.lit(w))])
    counted = [c for c, w in weights.items() if w > 0 and c != "graph"]
    made = {
        "field_coverage": F.least(F.lit(1.0), F.size(F.array_intersect("fields", _in(HIGH))) / WHOLE["field_coverage"]),
        "scope_overlap": F.when(F.size("scope_tokens") > 0, F.size(F.array_intersect("scope_tokens", "tokens")) / F.size("scope_tokens")).otherwise(0.0),
        "authority": F.coalesce(authority[F.col("authority")], F.lit(0.0)),
        "evidence": clamp(evidence),
        "freshness": F.coalesce(F.pow(F.lit(0.5), age / HALF_LIFE_DAYS), F.lit(0.0)),
        "channel_diversity": F.least(F.lit(1.0), F.size(F.array_intersect(F.map_keys("ranks"), _in(counted))) / WHOLE["channel_diversity"]),
    }
    return rows.select("query_id", "doc_id", "rrf", "ranks", "fields", "terms", "evidence", F.col("authority").alias("authority_kind"), "last_verified", "fingerprint", "exact_anchor", "approximate_anchor", "embedding_similarity", *LEXICAL, "graph_quality", *[c.alias(f"_{n}") for n, c in made.items()]).withColumnsRenamed({"evidence": "found", **{f"_{n}": n for n in made}})


def greatest_features(variants: DataFrame) -> DataFrame:
    """Of features by phrasing (query_id, variant, doc_id, ...): the largest of each."""
    return variants.groupBy("query_id", "doc_id").agg(*[F.max(f).alias(f) for f in WEIGHTS])


def _branch(weights: Mapping[str, float]) -> Column:
    return clamp(fusion.branch(weights) / sum(weights.values()))


def scored(rows: DataFrame, asks: DataFrame, found: DataFrame, weights: Mapping[str, float] = WEIGHTS, branches: Mapping[str, Mapping[str, float]] = CONFIDENCE) -> DataFrame:
    """Add score, confidence, threshold, penalty and trusted, and rank all candidates of a query by score, rrf, document.

    Confidence is the best branch: exact, concept, density, for queries without natural language also approximate; the
    embedding's only where other channels found the document and trust it already. Conflicts lower both."""
    rows = rows.join(penalties(found), ["query_id", "doc_id"], "left").join(asks.select("query_id", "classes", fusion.threshold(F.col("classes")).alias("threshold")), "query_id")
    kept = 1 - F.least(F.lit(0.9), F.coalesce("penalty", F.lit(0.0)))
    total = F.col("rrf") * RRF_WEIGHT
    for f, w in weights.items():
        total = total + F.col(f) * float(w)
    score = clamp(total / (RRF_WEIGHT + sum(weights.values())) * kept)
    sure = F.greatest(F.col("exact_anchor"), _branch(branches["concept"]), _branch(branches["density"]), F.when(~F.array_contains("classes", "natural"), _branch(branches["approximate"])).otherwise(0.0))
    others = F.size(F.array_except(F.map_keys("ranks"), F.array(F.lit("embedding")))) > 0
    by_vector = F.when((F.col("embedding_similarity") > 0) & others & (sure >= F.col("threshold")), _branch(branches["embedding"])).otherwise(0.0)
    rows = rows.withColumn("penalty", F.coalesce("penalty", F.lit(0.0))).withColumn("score", score).withColumn("confidence", F.greatest(sure, by_vector) * kept)
    rows = rows.withColumn("trusted", F.round("confidence", 9) >= F.col("threshold"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc(F.round("rrf", 9)), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order))


def strongest(weights: Mapping[str, float] = WEIGHTS, most: int = 3) -> Column:
    """The features that add most to the score, as name=value, by weight times value, then name."""
    every = F.array(*[F.struct((-F.round(F.col(f) * float(w), 12)).alias("w"), F.lit(f).alias("f"), F.col(f).alias("v")) for f, w in weights.items()])
    best = F.slice(F.array_sort(F.filter(every, lambda x: x["v"] > 0)), 1, most)
    return F.array_join(F.transform(best, lambda x: F.concat(x["f"], F.lit("="), F.format_string("%.3f", x["v"]))), ", ")


def explanations(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Add explanation: four lines on ranks, features, score, and the conflicts that lower it or else the document's
    authority."""
    bad = found.filter("penalty > 0").groupBy("query_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("kind", "with"))), lambda x: F.concat_ws(":", x["kind"], x["with"])), ", ").alias("bad"))
    in_order = F.filter(_in(planner.CHANNELS), lambda c: F.map_contains_key("ranks", c))
    ranks = F.array_join(F.transform(in_order, lambda c: F.concat(c, F.lit("#"), F.col("ranks")[c].cast("string"))), ", ")
    three = lambda c: F.format_string("%.3f", F.round(c, 6))
    lines = F.array(
        F.concat(F.lit("RRF "), ranks, F.lit("; normalized="), three("rrf")),
        F.concat(F.lit("Features "), strongest()),
        F.concat(F.lit("Score "), three("score"), F.lit("; confidence="), three("confidence"), F.lit("; threshold="), three("threshold")),
        F.coalesce(F.concat(F.lit("Conflict "), F.col("bad")), F.concat(F.lit("Evidence authority="), F.coalesce("authority_kind", F.lit("none")), F.lit("; verified="), F.coalesce(F.col("last_verified").cast("string"), F.lit("never")))),
    )
    return rows.join(bad, ["query_id", "doc_id"], "left").withColumn("explanation", lines).drop("bad")


def rank(queries: DataFrame, tables: Mapping[str, DataFrame], answers: DataFrame | None = None, weights: Mapping[str, float] = CHANNEL_WEIGHTS) -> DataFrame:
    """All candidates of a batch (query_id, query) with lanes, features, score, confidence, rank and explanation."""
    asks = planner.analyse(queries)
    fused = keep(fuse(planner.all_lanes(asks, tables, answers), weights), "fused")
    found = keep(conflicts(fused, tables["documents"]), "conflicts")
    return explanations(scored(features(asks, fused, tables, weights), asks, found), found)


def answer(queries: DataFrame, tables: Mapping[str, DataFrame], limit: int = 10, **options) -> tuple[DataFrame, DataFrame]:
    """(answers, abstentions) of a batch: the trusted candidates after diversity, at most `limit` a query with position; and
    per query whether and why it abstains."""
    rows = keep(rank(queries, tables, **options), "ranked")
    trusted = rows.filter("trusted")
    picked = fusion.mmr(trusted.select("query_id", "doc_id", "score", F.col("fingerprint").alias("tokens"), "rrf"), "doc_id", most=limit)
    answers = trusted.join(picked, ["query_id", "doc_id"])
    counts = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("trusted").alias("trusted"), F.max("confidence").alias("top_confidence"), F.max("score").alias("top_score"))
    out = queries.select("query_id").join(counts, "query_id", "left")
    reason = F.when(F.col("candidates").isNull(), "no-trusted-candidate").when(F.col("trusted") == 0, "below-threshold")
    return answers, out.select("query_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("trusted", F.lit(0)).alias("trusted"), "top_score", "top_confidence", reason.isNotNull().alias("abstained"), reason.alias("reason"))


def embedding_weights(weights: Mapping[str, float], mode: str, weight: float = 4.0) -> dict[str, float]:
    """The channel weights under an embedding mode: only `weighted` gives the channel its weight."""
    return dict(weights) | {"embedding": weight if mode == "weighted" else 0}
