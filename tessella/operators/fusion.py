"""Fusion of lanes and variants, features, confidence, cuts and conflicts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.math import clamp

RRF_K = 10  # fixed value


def rrf(lanes: DataFrame, weights: Mapping[str, float], key: str, k: int = RRF_K) -> DataFrame:
    """(query_id, channel, key, rank) to (query_id, key, rrf, channels): weighted reciprocal ranks over their maximum."""
    table = F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(float(w)))])
    top = sum(w / (k + 1) for w in weights.values())
    out = lanes.groupBy("query_id", key).agg(F.sum(table[F.col("channel")] / (k + F.col("rank"))).alias("s"), F.array_sort(F.collect_set("channel")).alias("channels"))
    return out.select("query_id", key, (F.col("s") / top).alias("rrf"), "channels")


def fuse_variants(ranked: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """(query_id, variant, key, rank) to (query_id, key, score, best_rank, variants)."""
    return ranked.groupBy("query_id", key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("variants"))


def weighted_score(features: Mapping[str, float], rrf_column: str = "rrf", penalty: Column | None = None) -> Column:
    """(rrf + sum of feature * weight) / (1 + sum of weights), cut to 0..1 and lowered by at most 0.9 of penalty."""
    total = F.col(rrf_column)
    for name, w in features.items():
        total = total + F.col(name) * w
    kept = 1 - F.least(F.lit(0.9), penalty) if penalty is not None else F.lit(1.0)
    return clamp(total / (1 + sum(features.values())) * kept)


#: The branches of the confidence and the thresholds per query class.
CONCEPT = {"high_signal_concepts": 0.55, "high_signal_terms": 0.2, "field_coverage": 0.15, "query_coverage": 0.1}
DENSITY = {"matched_terms": 0.55, "query_coverage": 0.35, "field_coverage": 0.1}
THRESHOLDS = {"identifier": 0.6, "path": 0.7, "error": 0.7, "natural": 0.65, "decision": 0.65, "mixed": 0.65}


def branch(weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.col(name) * w
    return total


def threshold(classes: Column) -> Column:
    """The largest threshold of a query's classes."""
    table = F.create_map(*[x for c, t in THRESHOLDS.items() for x in (F.lit(c), F.lit(t))])
    return F.array_max(F.transform(classes, lambda c: table[c]))


def with_abstentions(queries: DataFrame, ranked: DataFrame, key: str, confidence: str, least: str) -> DataFrame:
    """Per query: how many candidates and trusted ones, the best trusted key, whether and why it abstains."""
    best = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col(confidence) >= F.col(least)).alias("trusted"), F.max(F.when(F.col(confidence) >= F.col(least), F.struct(F.round(confidence, 9).alias("c"), (-F.col(key)).alias("k")))).alias("b"))
    out = queries.select("query_id").join(best, "query_id", "left")
    reason = F.when(F.col("candidates").isNull(), "no-trusted-candidate").when(F.col("trusted") == 0, "below-threshold")
    return out.select("query_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("trusted", F.lit(0)).alias("trusted"), (-F.col("b.k")).alias("best"), reason.isNotNull().alias("abstained"), reason.alias("reason"))


def relative_cut(scored: DataFrame, share: float = 0.55, score: str = "score") -> DataFrame:
    """Keep rows of at least `share` of their query's best score."""
    top = F.max(score).over(Window.partitionBy("query_id"))
    return scored.withColumn("_top", top).filter(F.round(score, 9) >= F.round(share * F.col("_top"), 9)).drop("_top")


def conflicts(candidates: DataFrame, supersedes: DataFrame, key: str) -> DataFrame:
    """(query_id, key, penalty): for candidates that another candidate of the query supersedes (newer, older). The worst
    penalty counts once per kind, kinds add up."""
    pairs = candidates.select("query_id", F.col(key).alias("newer")).join(supersedes, "newer").join(candidates.select("query_id", F.col(key).alias("older")), ["query_id", "older"])
    worst = pairs.groupBy("query_id", "older", "kind").agg(F.max("penalty").alias("p"))
    return worst.groupBy("query_id", F.col("older").alias(key)).agg(F.round(F.sum("p"), 6).alias("penalty"), F.count(F.lit(1)).alias("kinds"))


def mmr(ranked: DataFrame, key: str, balance: float = 0.78, alike: float = 0.82, most: int = 10) -> DataFrame:
    """Greedy diversity per query over (query_id, key, score, tokens): takes the best of balance * score -
    (1 - balance) * similarity to what is taken; suppresses Jaccard >= alike. Each query's candidates are few (they have
    passed the top-k before), so a query is one task's group."""
    import pandas as pd

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        left = [(r.score, r.key, frozenset(r.tokens)) for r in pdf.rename(columns={key: "key"}).itertuples()]
        taken: list[tuple[float, object, frozenset]] = []
        rows = []
        while left and len(taken) < most:
            best = None
            for s, k, t in left:
                sim = max((len(t & u) / len(t | u) if t | u else 0.0 for _, _, u in taken), default=0.0)
                if sim >= alike:
                    continue
                rank = (-round(balance * s - (1 - balance) * sim, 9), -s, k)
                if best is None or rank < best[0]:
                    best = (rank, (s, k, t), sim)
            if best is None:
                break
            taken.append(best[1])
            left.remove(best[1])
            rows.append((pdf["query_id"].iloc[0], best[1][1], len(taken), best[2]))
        return pd.DataFrame(rows, columns=["query_id", key, "position", "similarity"])

    kind = ranked.schema[key].dataType.simpleString()
    return ranked.select("query_id", key, "score", "tokens").groupBy("query_id").applyInPandas(select, f"query_id {ranked.schema['query_id'].dataType.simpleString()}, {key} {kind}, position int, similarity double")
