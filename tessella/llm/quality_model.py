"""Quality classifier: a sparse rule ensemble.

Boosted trees over text statistics are cut into their paths; every path is a conjunctive rule. A lasso logistic
regression over the rules leaves few of them, and these are compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._boost import Boost, Node, sigmoid

#: A model is fitted on at most so many labelled rows, chosen by the hash of their ids.
MOST_TRAINED = 20_000

#: Statistics of a text `_t`: their names and SQL. u holds the numbers of words (w), distinct word pairs (d;
#: unlike distinct words, their share does not fall with the length of a text), characters in
#: words (bare) and characters (n), and the lines (l).
STATISTICS = {
    "words": "u.w",
    "word_length": "u.bare / greatest(u.w, 1)",
    "distinct_pairs": "u.d / greatest(u.w - 1, 1)",
    "symbols": r"(u.n - length(regexp_replace(_t, r'[#*$%&|<>=@~^_+]+', ''))) / greatest(u.bare, 1)",
    "shouting": r"(u.n - length(regexp_replace(_t, r'[!?]+', ''))) / greatest(u.w, 1)",
    "upper": r"(u.n - length(regexp_replace(_t, r'[A-ZÀ-ÖØ-Þ]+', ''))) / greatest(u.bare, 1)",
    "digits": r"(u.n - length(regexp_replace(_t, r'[0-9]+', ''))) / greatest(u.bare, 1)",
    "stops": r"(u.n - length(regexp_replace(_t, r'[.,;:]+', ''))) / greatest(u.w, 1)",
    "lines": "size(u.l) / greatest(u.w, 1)",
    "distinct_lines": "size(array_distinct(u.l)) / greatest(size(u.l), 1)",
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add one double per entry of STATISTICS (columns of those names are replaced). Null counts as empty."""
    names = list(STATISTICS)
    held = docs.drop(*names).withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    # Words and lines are bound once, as lambda variables.
    fields = ", ".join(f"'{name}', cast({sql} as double)" for name, sql in STATISTICS.items())
    sql = rf"""transform(array(named_struct('ws', regexp_extract_all(_t, r'[^\x20\x09-\x0D]+', 0), 'l', split(_t, '\n'))), v ->
      transform(array(named_struct('w', size(v.ws), 'd', case when size(v.ws) > 1 then size(array_distinct(transform(sequence(2, size(v.ws)), i -> xxhash64(element_at(v.ws, i - 1), element_at(v.ws, i))))) else size(v.ws) end, 'bare', length(array_join(v.ws, '')), 'n', length(_t), 'l', v.l)), u ->
      named_struct({fields}))[0])[0]"""
    out = held.withColumn("_s", F.expr(sql)).drop("_t")
    return out.select(*[c for c in out.columns if c != "_s"], *[F.col(f"_s.{n}").alias(n) for n in names])


#: A rule: conditions (feature, at most?, cut) that must all hold.
Rule = tuple[tuple[int, bool, float], ...]


def paths(node: Node, so_far: Rule = ()) -> list[Rule]:
    """The conjunctions of all nodes below the root."""
    out = [so_far] if so_far else []
    if node.feature >= 0:
        out += paths(node.left, (*so_far, (node.feature, True, node.cut)))
        out += paths(node.right, (*so_far, (node.feature, False, node.cut)))
    return out


def _simplify(rule: Rule) -> Rule:
    """One bound per feature and side, in order."""
    ends: dict[tuple[int, bool], float] = {}
    for f, below, cut in rule:
        ends[f, below] = (min if below else max)(ends.get((f, below), cut), cut)
    return tuple((f, below, cut) for (f, below), cut in sorted(ends.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, below, cut in rule:
        out &= (x[:, f] <= cut) == below
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the mean log loss plus penalty * |w|; the intercept is free."""
    n, k = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    rate = 4 * n / max(1e-9, np.linalg.norm(a.T @ a, 2))
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        new = v - rate * (a.T @ (sigmoid(a @ v) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleEnsemble:
    features: tuple[str, ...]
    start: float
    rules: tuple[tuple[Rule, float], ...]

    def decide(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.start + sum((w * holds(rule, x) for rule, w in self.rules), np.zeros(len(x))))

    def column(self) -> Column:
        """The score as a Spark expression over the feature columns."""
        total = F.lit(self.start)
        for rule, w in self.rules:
            all_ = F.lit(True)
            for f, below, cut in rule:
                c = F.col(self.features[f])
                all_ = all_ & (c <= cut if below else c > cut)
            total = total + F.when(all_, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, features: list[str], penalty: float = 1e-3) -> RuleEnsemble:
    """Trees -> paths -> lasso. With one class only (or no rows) the score is constant."""
    p = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return RuleEnsemble(tuple(features), float(np.log(p / (1 - p))), ())
    boost = Boost(trees=30, depth=3, rate=0.3, share=0.5, least=max(4, min(20, len(y) // 100))).fit(x, y)
    seen: dict[bytes, Rule] = {}
    for root in boost.roots:
        for rule in map(_simplify, paths(root)):
            held = holds(rule, x)
            if 0 < held.sum() < len(x):
                seen.setdefault(min(held.tobytes(), (~held).tobytes()), rule)  # rules that agree on all rows are one
    rules = list(seen.values())
    r = np.stack([holds(rule, x) for rule in rules], 1).astype(float)
    start, w = lasso_logistic(r, y.astype(float), penalty)
    return RuleEnsemble(tuple(features), start, tuple((rule, float(v)) for rule, v in zip(rules, w, strict=True) if abs(v) > 1e-6))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED) -> RuleEnsemble:
    """Fit on the labelled rows whose remainder by 3 is not 1, at most `most` of them by the hash of the id (of rows with
    one id the smallest statistics, of its labels the larger). Only the texts of these rows are read for it."""
    names = list(STATISTICS)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # at most `most` rows
    rows = statistics(rows).groupBy("doc_id").agg(F.min(F.struct("quality", *names)).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([[r[n] for n in names] for r in rows], dtype=float).reshape(len(rows), len(names))
    return fit_rules(x, np.array([r["quality"] for r in rows], dtype=int), names)


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score and predicted; see quality_digest."""
    score = train(docs, labels, most).column()
    stats = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text")
    held = remainder(F.col("doc_id"), 3) == 1
    return stats.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score (likelihood of label 1) and predicted. Empty and null texts are scored as empty;
    repeated rows score alike; a null doc_id is scored, never trained on; without labels every score is 0.5; other columns
    are ignored."""
    return score_quality(docs, labels)


def drop_low_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED) -> DataFrame:
    """The rows of `docs` with a score of at least 0.5; all columns are kept. Empty and null texts are scored as empty."""
    model = train(docs, labels, most)
    held = statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("text")))
    return held.filter(model.column() >= 0.5).select("_row.*")
