"""Retrieval quality: recall, reciprocal rank, abstention, paired A/B and profile selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_hits(ranked: DataFrame, golden: DataFrame) -> DataFrame:
    """(case_id, rank) of the best expected document per golden case (case_id, expected); null rank if none was found."""
    found = ranked.join(golden.select("case_id", F.col("expected").alias("doc_id")), ["case_id", "doc_id"]).groupBy("case_id").agg(F.min("rank").alias("rank"))
    return golden.select("case_id").distinct().join(found, "case_id", "left")


def metrics(hits: DataFrame, *groups: str) -> DataFrame:
    """cases, recall@1, recall@5 and mean reciprocal rank, overall (null group) and by group, in one pass."""
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return hits.groupingSets([list(groups), []] if groups else [[]], *groups).agg(F.count(F.lit(1)).alias("cases"), at(1).alias("recall_1"), at(5).alias("recall_5"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per case: the ranks of A and B and improved, regressed or same; no rank is worse than any."""
    pair = a.select("case_id", F.col("rank").alias("rank_a")).join(b.select("case_id", F.col("rank").alias("rank_b")), "case_id", "full_outer")
    x, y = F.coalesce("rank_a", F.lit(1 << 30)), F.coalesce("rank_b", F.lit(1 << 30))
    return pair.withColumn("change", F.when(y < x, "improved").when(y > x, "regressed").otherwise("same"))


def guard(metrics_a: DataFrame, metrics_b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: B is no worse than A on every metric."""
    names = ["recall_1", "recall_5", "mrr"]
    b = metrics_b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(n).alias(f"b_{n}") for n in names])
    joined = metrics_a.join(b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return joined.select(*keys, *[(F.col(f"b_{n}") >= F.col(n)).alias(f"{n}_ok") for n in names]).withColumn("safe", F.col("recall_1_ok") & F.col("recall_5_ok") & F.col("mrr_ok"))


def choose(profiles: DataFrame, better: Sequence[str], cheaper: str, name: str) -> DataFrame:
    """The lexicographic best: larger `better` columns in order, then the smaller cost, then the name."""
    return profiles.orderBy(*[F.desc(c) for c in better], F.asc(cheaper), F.asc(name)).limit(1)


def negatives(answers: DataFrame, asked: DataFrame, *groups: str) -> DataFrame:
    """Of queries that nothing should answer (case_id): cases, abstained and their rate, overall (null group) and by group, in
    one pass. answers (case_id): any row is an answer."""
    rows = asked.join(answers.select("case_id").distinct().withColumn("_got", F.lit(True)), "case_id", "left")
    none = F.count_if(F.col("_got").isNull())
    return rows.groupingSets([list(groups), []] if groups else [[]], *groups).agg(F.count(F.lit(1)).alias("cases"), none.alias("abstained"), F.round(none / F.count(F.lit(1)), 6).alias("abstain_rate"))


def changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per negative case (case_id, abstained) of both sides: improved where only B abstains, regressed where only A does."""
    pair = a.select("case_id", F.col("abstained").alias("abstained_a")).join(b.select("case_id", F.col("abstained").alias("abstained_b")), "case_id")
    return pair.withColumn("change", F.when(F.col("abstained_a") == F.col("abstained_b"), "unchanged").when(F.col("abstained_b"), "improved").otherwise("regressed"))


def ab_safe(cases: DataFrame) -> DataFrame:
    """One row of guards from cases (kind: golden or negative, partition, rank_a, rank_b, abstained_a, abstained_b): B
    abstains no less, is no worse on golden cases outside the holdout, nor on those within it (none: no worse)."""
    golden, held = (F.col("kind") == "golden"), F.coalesce(F.col("partition") == "holdout", F.lit(False))
    sides = {}
    for side in "ab":
        rank = F.col(f"rank_{side}")
        for name, value in (("r1", F.when(rank <= 1, 1.0).otherwise(0.0)), ("r5", F.when(rank <= 5, 1.0).otherwise(0.0)), ("mrr", F.coalesce(1 / rank, F.lit(0.0)))):
            sides[f"g_{name}_{side}"] = F.round(F.coalesce(F.avg(F.when(golden & ~held, value)), F.lit(0.0)), 6)
            sides[f"h_{name}_{side}"] = F.round(F.coalesce(F.avg(F.when(golden & held, value)), F.lit(0.0)), 6)
        sides[f"n_{side}"] = F.round(F.coalesce(F.avg(F.when(~golden, F.col(f"abstained_{side}").cast("double"))), F.lit(0.0)), 6)
    row = cases.agg(F.count_if(golden & ~held).alias("golden"), F.count_if(golden & held).alias("holdout"), F.count_if(~golden).alias("negative"), *[c.alias(n) for n, c in sides.items()])
    no_worse = lambda p: (F.col(f"{p}_r1_b") >= F.col(f"{p}_r1_a")) & (F.col(f"{p}_r5_b") >= F.col(f"{p}_r5_a")) & (F.col(f"{p}_mrr_b") >= F.col(f"{p}_mrr_a"))
    out = row.select("golden", "holdout", "negative", (F.col("n_b") >= F.col("n_a")).alias("negative_not_worse"), no_worse("g").alias("golden_not_worse"), no_worse("h").alias("holdout_not_worse"))
    return out.withColumn("safe", F.col("negative_not_worse") & F.col("golden_not_worse") & F.col("holdout_not_worse"))


def find_report(reports: DataFrame, provider: str, model: str, version: str, snapshot: str | None = None) -> DataFrame:
    """Of A/B reports (report_id, provider, model, version, snapshot_id, weight, safe, modified, file) the newest that is of
    this provider, model, version and snapshot; one of equal weight that calls it unsafe takes its place, since equal inputs
    must agree. No row if none fits."""
    fit = reports.filter((F.col("provider") == provider) & (F.col("model") == model) & (F.col("version") == version) & (F.lit(snapshot is None) | (F.col("snapshot_id") == F.lit(snapshot))))
    best = fit.orderBy(F.desc("modified"), "file").limit(1)
    against = fit.alias("x").join(F.broadcast(best.filter("safe").select(F.col("weight").alias("w"), F.col("report_id").alias("best"))), (F.col("weight") == F.col("w")) & (F.col("report_id") != F.col("best")) & ~F.col("safe"))  # at most one row
    first = against.orderBy(F.desc("modified"), "file").limit(1).select(*reports.columns)
    both = first.withColumn("_o", F.lit(0)).unionByName(best.withColumn("_o", F.lit(1)))
    return both.orderBy("_o").limit(1).drop("_o")


def latencies(samples: DataFrame, value: str, *keys: str) -> DataFrame:
    """Nearest-rank p50 and p95 over all samples and by each key, in one pass: metric (all or the key), name, n, p50, p95."""
    from tessella.functions.math import percentile

    rows = samples.groupingSets([[], *[[k] for k in keys]], *keys).agg(F.count(value).alias("n"), percentile(value, 0.5).alias("p50"), percentile(value, 0.95).alias("p95"), *[F.grouping(k).alias(f"_{k}") for k in keys])
    metric = F.lit("all")
    for k in keys:
        metric = F.when(F.col(f"_{k}") == 0, k).otherwise(metric)
    return rows.select(metric.alias("metric"), F.coalesce(*[F.col(k).cast("string") for k in keys]).alias("name"), "n", "p50", "p95")


def ranking_digest(ranked: DataFrame) -> DataFrame:
    """One row, digest: the same for equal rankings (case_id, rank, doc_id) in any order of rows. Each case is hashed by
    itself; only hashes are combined."""
    each = ranked.groupBy("case_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("doc_id")))), lambda x: x["doc_id"]), "\n"), 256).alias("h"))
    whole = each.select(F.sha2(F.concat_ws(" ", F.col("case_id").cast("string"), "h"), 256).alias("h"))
    part = lambda at: F.expr(f"bit_xor(conv(substr(h, {at}, 15), 16, 10) :: bigint)")
    return whole.agg(F.sha2(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), part(1).cast("string"), part(16).cast("string"), part(31).cast("string")), 256).alias("digest"))


def quality_gate(overall: DataFrame, by_group: DataFrame, repeated: bool = True) -> DataFrame:
    """One row, passed: every metric (recall_1, recall_5, mrr, abstain_rate; null: none asked) is 1 overall and in every group
    of languages, scripts and partitions, and repeats were equal."""
    perfect = F.lit(True)
    for c in ("recall_1", "recall_5", "mrr", "abstain_rate"):
        perfect = perfect & (F.coalesce(F.col(c), F.lit(1.0)) == 1)
    rows = overall.select(perfect.alias("ok")).unionByName(by_group.select(perfect.alias("ok")))
    return rows.agg((F.coalesce(F.bool_and("ok"), F.lit(False)) & F.lit(repeated)).alias("passed"))


def performance_gate(found: DataFrame, budget_ms: float, factor: float = 1.0, allowance: float = 2.0) -> DataFrame:
    """One row, passed: latencies() keep to the budget (scaled by how much slower this machine is), groups to `allowance`
    times it, and none is missing."""
    limit = F.when(F.col("metric") == "all", budget_ms * factor).otherwise(budget_ms * factor * allowance)
    return found.agg(F.coalesce(F.bool_and(F.coalesce(F.col("p95") <= limit, F.lit(False))), F.lit(False)).alias("passed"))


def adapter_answers(queries: DataFrame, documents: list[dict], search, limit: int = 5) -> DataFrame:
    """(query_id, rank, doc_id) of an external search(documents, query, limit) -> ids, run on the executors. The documents are
    those of a benchmark corpus: a few, sent once."""
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast((documents, search))  # the size of the corpus given

    def run(frames):
        import pandas as pd

        docs, call = sent.value
        for pdf in frames:
            rows = [(q, i + 1, str(d)) for q, text in zip(pdf["query_id"], pdf["query"], strict=True) for i, d in enumerate(list(call(documents=docs, query=text, limit=limit))[:limit])]
            yield pd.DataFrame(rows, columns=["query_id", "rank", "doc_id"])

    return queries.select("query_id", "query").mapInPandas(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, doc_id string")
