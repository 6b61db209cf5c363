"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a seed lexicon and of a lexicon learned from the training labels (words and word beginnings),
their nearness to second-person words, capitals, punctuation and obfuscation. The learned lexicon is applied out of fold
while the trees are trained, and the calibration sees out-of-fold scores only.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._boost import Boost, isotonic
from tessella.llm._scale import drop, keep
from tessella.llm.quality_model import remainder

#: A model is fitted on at most so many labelled texts, chosen by the hash of their ids.
MOST_TRAINED = 8_000
FOLDS = 4
#: A stem must occur in so many toxic texts to be learned.
LEAST_TOXIC = 4
#: Tasks over the training texts, and rows of an Arrow batch of them.
TRAIN_TASKS, BATCH = 24, 200

#: Insults and second-person words of everyday language.
SEED = frozenset("idiot idiots moron morons stupid loser losers trash scum scumbag worthless pathetic disgusting clown dumb dumbass fool garbage jerk bastard bitch asshole shit shitty crap fuck fucking retard retarded ugly filthy vermin pig hate kill die imbecile dimwit cretin idiotisch dumm arschloch scheisse wichser idiota estúpido imbécil basura mierda idiote stupide connard salaud merde ordure".split())
SECOND = frozenset("you your yours yourself youre du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros su".split())
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|*", "oieastasiix")

FEATURES = ("seed_density", "seed_count", "learned_density", "learned_count", "learned_most", "learned_total", "near_second", "second_density", "capitals", "shouted_words", "exclaims", "punctuation", "disguised", "disguised_hits", "words")
_WORD = re.compile(r"[^\W\d_]+")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_INSIDE = re.compile(r"(?<=[^\W\d_])[0-9@$!|*]+(?=[^\W\d_])")
#: What a disguised word is made of; white space and all other punctuation end it.
_TOKEN = re.compile(r"(?:[^\W_]|[@$!|*])+")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_SHORTEST, _LONGEST = 4, 8


def stems(word: str) -> list[str]:
    """What a word is looked up by: itself (ending in $) and its beginnings."""
    return [word + "$", *(word[:k] for k in range(_SHORTEST, min(_LONGEST, len(word)) + 1))]


class Lookup(dict):
    """Lower-case word to (is in the seed lexicon, learned weight, is second person), or None; remembers what fits."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        found = (word in SEED, max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0), word in SECOND)
        found = found if any(found) else None
        if len(self) < 300_000:
            self[word] = found
        return found


def is_code(token: str) -> bool:
    """Whether a token looks like a key or a digest: hexadecimal, or letters of both cases and digits in quick change."""
    if len(token) < 16:
        return False
    kinds = [c.isdigit() + 2 * c.isupper() for c in token]
    return bool(_HEX.fullmatch(token)) or 3 * sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) >= len(token)


def _disguised(text: str) -> list[str]:
    """Words with digits or signs between letters, undisguised, whatever their length; keys and digests are none."""
    if not _INSIDE.search(text):
        return []
    return [t.lower().translate(DISGUISE) for t in _TOKEN.findall(text) if _INSIDE.search(t) and not is_code(t)]


def features(text: str | None, lookup: Lookup) -> list[float]:
    """Dense features of a whole text; null counts as empty."""
    text = text or ""
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    seeds = learned = second = near = 0
    most = total = 0.0
    last_second, last_hit = -99, -99
    for i, got in enumerate(map(lookup.__getitem__, words)):
        if got is None:
            continue
        seed, weight, person = got
        if person:
            second += 1
            last_second = i
            near += i - last_hit <= 5
        if seed or weight:
            seeds += seed
            learned += weight > 0
            total += weight
            most = max(most, weight)
            near += i - last_second <= 5
            last_hit = i
    letters = max(1, len("".join(words)))
    capitals = list(map(len, _CAPITALS.findall(text)))
    plain = _disguised(text)
    hits = sum(w in SEED or any(s in lookup.lexicon for s in stems(w)) for w in plain)
    return [seeds / n, seeds, learned / n, learned, most, total, near, second / n, sum(capitals) / letters, sum(k > 2 for k in capitals) / n, (text.count("!") + text.count("?")) / n, sum(map(text.count, ".,;:*#$%&|")) / n, len(plain) / n, hits, math.log1p(len(words))]


def learn(counts: list[tuple[Counter, Counter, int, int]], least: int = LEAST_TOXIC, odds: float = 2.2) -> dict[str, float]:
    """Words and beginnings that toxic texts hold far more often: smoothed log odds of at least `odds`, in at least
    `least` toxic texts. A beginning counts only if it says more than all longer ones together."""
    toxic, clean = Counter(), Counter()
    nt = nc = 0
    for a, b, p, q in counts:
        toxic.update(a)
        clean.update(b)
        nt, nc = nt + p, nc + q
    out = {}
    for s, k in toxic.items():
        if k >= least:
            w = math.log((k + 0.5) / (nt + 1)) - math.log((clean[s] + 1.0) / (nc + 2))
            if w >= odds and k > 3 * clean[s] * nt / max(1, nc) + 2:
                out[s] = w
    return out


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    boost: Boost
    knots: np.ndarray
    values: np.ndarray

    def score(self, texts: list[str | None], lookup: Lookup) -> np.ndarray:
        x = np.array([features(t, lookup) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
        return np.clip(np.interp(self.boost.decide(x), self.knots, self.values), 0, 1)


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, lexicon: dict[str, float]) -> ToxicityModel:
    """Fit on the driver over dense rows (out-of-fold lexicon features). With one class only (or no rows) the score is
    constant."""
    if len(set(y.tolist())) < 2:
        p = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
        return ToxicityModel({}, Boost(trees=0).fit(np.zeros((0, len(FEATURES))), np.zeros(0)), np.zeros(1), np.array([p]))
    z = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            z[fold == k] = Boost().fit(x[fold != k], y[fold != k]).decide(x[fold == k])
    knots, values = isotonic(z, y)
    return ToxicityModel(lexicon, Boost().fit(x, y), knots, values)


def fold_of(text: str) -> int:
    """Equal texts share a fold."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (stem, fold, toxic, n): in how many texts of a batch a stem occurs. The stem null counts texts."""
    for batch in batches:
        found: Counter = Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k = fold_of(text)
            found[None, k, y] += 1
            found.update((s, k, y) for s in {s for w in set(_WORD.findall(text.lower())) for s in stems(w)})
        columns = zip(*[(*key, n) for key, n in found.items()], strict=True) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["stem", "fold", "toxic", "n"])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED) -> ToxicityModel:
    """Fit on the labelled rows whose remainder by 5 is not 0, at most `most` of them by the hash of the id (of texts with
    one id the smallest, of its labels the larger).

    Texts stay on the executors: the driver gets the stems that occur in enough toxic texts, with their counts by fold,
    and one dense row per training text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(known), "doc_id")  # at most `most` rows
    rows = keep(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).repartition(TRAIN_TASKS, "doc_id"), "training", BATCH)
    by_stem = rows.select("text", "toxic").mapInArrow(_counted, "stem string, fold int, toxic int, n long")
    each = [F.coalesce(F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == y), F.col("n"))), F.lit(0)).alias(f"n{y}{k}") for y in (1, 0) for k in range(FOLDS)]
    by_stem = by_stem.groupBy("stem").agg(*each)
    by_stem = by_stem.filter(F.col("stem").isNull() | (sum(F.col(f"n1{k}") for k in range(FOLDS)) >= LEAST_TOXIC)).collect()
    counts = [(Counter(), Counter(), 0, 0)] * FOLDS
    for r in by_stem:
        if r["stem"] is None:
            counts = [(Counter(), Counter(), r[f"n1{k}"], r[f"n0{k}"]) for k in range(FOLDS)]
    for r in by_stem:
        for k in range(FOLDS):
            if r["stem"] is not None:
                for side, y in ((0, 1), (1, 0)):
                    if r[f"n{y}{k}"]:
                        counts[k][side][r["stem"]] = r[f"n{y}{k}"]
    lexicons = docs.sparkSession.sparkContext.broadcast([learn(counts[:k] + counts[k + 1 :]) for k in range(FOLDS)])  # as large as the sample's vocabulary

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = [Lookup(x) for x in lexicons.value]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            folds = list(map(fold_of, texts))
            x = [features(t, lookups[k]) for t, k in zip(texts, folds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(folds, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "fold", "x"])

    held = sorted(rows.select("doc_id", "text", "toxic").mapInArrow(dense, "doc_id long, toxic int, fold int, x array<double>").collect(), key=lambda r: r["doc_id"])
    drop(rows)
    x = np.array([r["x"] for r in held], dtype=float).reshape(len(held), len(FEATURES))
    return fit(x, np.array([r["toxic"] for r in held], dtype=int), np.array([r["fold"] for r in held], dtype=int), learn(counts))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value.lexicon)
        for batch in batches:
            score = sent.value.score(batch.column(1).to_pylist(), lookup)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_digest(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED) -> DataFrame:
    """Per document: held_out, score (likelihood of label 1) and predicted. Empty and null texts are scored as empty;
    repeated rows score alike; a null doc_id is scored, never trained on; without labels every score is 0.5 (predicted
    1); other columns are ignored."""
    return score_toxicity(docs, train(docs, labels, most))
