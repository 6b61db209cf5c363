"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed greedily into phrases, each the longest match
of the automaton from where the last phrase ended; the fewer phrases, the closer the language. A phrase costs the
logarithm of the automaton's sample, so phrases of samples of different lengths compare as code lengths.

Automata are built in Spark tasks, one per language, as dense tables (state x symbol) that also hold where a parse goes
on after a phrase ends. So many texts advance by one symbol at a time with one lookup, in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the sample that the automata are fitted on: rows of a language, symbols of a row, symbols of a language and
#: bytes of all tables (with very many languages each gets fewer symbols). Texts to be judged have no bound.
SAMPLE_ROWS, ROW_SYMBOLS, LANGUAGE_SYMBOLS, TABLE_BYTES = 256, 128, 32_768, 64 << 20
#: Letters with a symbol of their own, the most frequent ones; all others share symbols.
OWN_LETTERS, SHARED_LETTERS = 120, 40
#: A parse starts anew after so many symbols, so that long texts are parsed in many lanes side by side.
LANE = 1024
#: Lanes that advance together.
LANES = 8192


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower-cased code point) of every code point; lower-casing to more than one keeps the first."""
    chars = [chr(c) for c in range(0x110000)]
    is_letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
    lower = np.arange(len(chars), dtype=np.uint32)
    for c in np.flatnonzero(is_letter):
        lower[c] = ord(chars[c].lower()[0])
    return is_letter, lower


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbol_table(alphabet: list[int]) -> np.ndarray:
    """Symbol of every code point: 0 for anything but a letter, 1.. for the letters of the alphabet in either case, and a
    shared one for each other letter."""
    is_letter, lower = letters()
    shared = len(alphabet) + 1 + (lower * np.uint32(2654435761) >> np.uint32(20)) % SHARED_LETTERS
    own = np.zeros(len(lower), np.uint8)
    own[alphabet] = np.arange(1, len(alphabet) + 1)
    return np.where(is_letter, np.where(own[lower] > 0, own[lower], shared), 0).astype(np.uint8)


def symbols(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of a text: letters, and one 0 between runs of them."""
    s = table[points]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    s = s[keep]
    return s[1 if len(s) and not s[0] else 0 : len(s) - 1 if len(s) > 1 and not s[-1] else len(s)]


def automaton(s: np.ndarray, size: int) -> np.ndarray:
    """Dense parsing table of the suffix automaton of s over `size` symbols.

    Entry [state, symbol] is 4 * (where to go) + phrases that end: 0 where the match goes on, 1 where the phrase ends and
    the next one starts with this symbol, and one more for a symbol that s does not hold, a phrase by itself."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s.tolist():
        here = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = here
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    table = np.zeros((len(follow), size), np.int32)
    first = np.zeros(size, np.int32)
    for c, state in follow[0].items():
        first[c] = state
    table[:] = np.where(first > 0, 4 * first + 1, 2)  # the phrase before ends; an unknown symbol is one more
    table[0] = np.where(first > 0, 4 * first, 1)
    rows = np.repeat(np.arange(len(follow)), [len(f) for f in follow])
    columns = np.fromiter((c for f in follow for c in f), np.int64, len(rows))
    table[rows, columns] = 4 * np.fromiter((t for f in follow for t in f.values()), np.int32, len(rows))
    return table


def phrases(lanes: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Phrases of each lane; lanes[i, t] is the symbol i of lane t, and lanes come with the longest first."""
    size = table.shape[1]
    flat = table.ravel()
    state = np.zeros(lanes.shape[1], np.int64)
    count = np.zeros(lanes.shape[1], np.int32)
    live = np.searchsorted(-lengths, -np.arange(lanes.shape[0]), "left")  # lanes longer than i
    for i in range(lanes.shape[0]):
        n = live[i]
        v = flat[state[:n] * size + lanes[i, :n]]
        count[:n] += v & 3
        state[:n] = v >> 2
    return count + (state > 0)  # the last phrase ends with the lane


def _middle(text: str) -> str:
    """The ROW_SYMBOLS letters in the middle of a text, lower-cased, with one blank between runs of them."""
    is_letter, lower = letters()
    points = lower[code_points(text)]
    letter = is_letter[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.where(letter, points, np.uint32(32))[keep]
    lo = max(0, (len(points) - ROW_SYMBOLS) // 2)
    return points[lo : lo + ROW_SYMBOLS].tobytes().decode("utf-32-le", "surrogatepass")


def _middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_middle(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.string())], names=["lang", "h", "part"])


def _sample(docs: DataFrame, label: str) -> DataFrame:
    """(lang, h, part) of the SAMPLE_ROWS texts of each language that come first by a hash of the text; equal texts count
    once. Only hashes are shuffled; the texts of the sample are then read from the table by a join with them."""
    rows = docs.select(F.col(label).cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    found = rows.select("lang", "h").distinct()
    for by in (["lang", F.pmod("h", F.lit(64))], ["lang"]):  # a language of any size is first thinned in parts
        found = found.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("i") <= SAMPLE_ROWS)
    parts = rows.join(found.select("lang", "h"), ["lang", "h"], "left_semi").select("lang", "h", "text").mapInArrow(_middles, "lang string, h long, part string")
    return parts.groupBy("lang", "h").agg(F.min("part").alias("part")).where("trim(part) <> ''")


def fit(labelled: DataFrame, label: str = "lang") -> tuple[list[str], np.ndarray, list[np.ndarray], np.ndarray]:
    """(languages, symbol table, automata, bits of a phrase) from at most SAMPLE_ROWS rows a language."""
    spark = labelled.sparkSession
    rows = sorted((r["lang"], r["h"], r["part"]) for r in _sample(labelled, label).collect())  # bounded: SAMPLE_ROWS x ROW_SYMBOLS letters a language
    languages = sorted({r[0] for r in rows})
    is_letter, _ = letters()
    seen = np.concatenate([np.zeros(0, np.uint32), *[code_points(r[2]) for r in rows]])
    found, n = np.unique(seen[is_letter[seen]], return_counts=True)
    alphabet = found[np.lexsort((found, -n))][:OWN_LETTERS].tolist()
    table = symbol_table(alphabet)
    size = len(alphabet) + 1 + SHARED_LETTERS
    most = max(256, min(LANGUAGE_SYMBOLS, TABLE_BYTES // max(1, len(languages) * 2 * size * 4)))
    samples = {}
    for lang in languages:
        pieces = [np.append(symbols(code_points(r[2]), table), np.uint8(0)) for r in rows if r[0] == lang]
        samples[lang] = np.concatenate(pieces)[:most]
    sent = spark.createDataFrame([(la, bytearray(s.tobytes())) for la, s in samples.items()], "lang string, s binary").repartition(max(1, len(samples)), "lang")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [automaton(np.frombuffer(s, np.uint8), size).tobytes() for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["lang", "a"])

    built = {r["lang"]: np.frombuffer(r["a"], np.int32).reshape(-1, size) for r in sent.mapInArrow(build, "lang string, a binary").collect()}  # TABLE_BYTES at most
    bits = np.array([math.log2(max(2, len(samples[la]))) for la in languages])
    return languages, table, [built[la] for la in languages], bits


def _lanes(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lanes, lengths, text of each): texts cut into lanes of LANE symbols, the longest lane first."""
    lengths = np.concatenate([np.full(-(-len(s) // LANE), LANE) for s in texts])
    ends = np.cumsum([-(-len(s) // LANE) for s in texts]) - 1
    lengths[ends] = [len(s) - (len(s) - 1) // LANE * LANE for s in texts]
    owner = np.repeat(np.arange(len(texts)), [-(-len(s) // LANE) for s in texts])
    out = np.zeros((len(lengths), LANE), np.uint8)
    out[np.arange(LANE) < lengths[:, None]] = np.concatenate(texts)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    return np.ascontiguousarray(out[order, : lengths[0]].T), lengths, owner[order]


def predictor(model):
    """Arrow function from (doc_id, held_out, text) to the digest; model is a broadcast of fit()'s result."""

    def judge(texts: list[str | None]) -> tuple[list[str], list[float]]:
        languages, table, automata, bits = model.value
        coded = [symbols(code_points(t), table) if t else np.zeros(0, np.uint8) for t in texts]
        some = [i for i, s in enumerate(coded) if len(s) and s.any()]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not some or not languages:
            return names, scores
        cost = np.zeros((len(languages), len(some)))
        lo = 0
        while lo < len(some):
            hi, n = lo, 0
            while hi < len(some) and (hi == lo or n + -(-len(coded[some[hi]]) // LANE) <= LANES):
                n += -(-len(coded[some[hi]]) // LANE)
                hi += 1
            lanes, lengths, owner = _lanes([coded[i] for i in some[lo:hi]])
            for j, a in enumerate(automata):
                cost[j, lo:hi] = np.bincount(owner, phrases(lanes, lengths, a), hi - lo) * bits[j]
            lo = hi
        best = np.argmin(cost, axis=0)  # ties: the first by name
        share = 1 / np.exp2(np.maximum(cost.min(axis=0) - cost, -1000)).sum(axis=0)
        for k, i in enumerate(some):
            names[i], scores[i] = languages[best[k]], float(share[k])
        return names, scores

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = judge(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return predict


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from those that are not held out.

    The prediction takes the text alone. A null text, or one without a letter, is `und` with score 0; so is every text
    where nothing was labelled. A null doc_id counts as empty text in the remainder, so such rows are learned from.
    Repeated rows come back as often as they occur, and equal texts get equal results; ties go to the first language by
    code points. The score is the winner's share if each language weighs 2^-(bits of its parse). Other columns are
    ignored, whatever their names. Empty tables give no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where("not held_out")))
    return rows.select("doc_id", "held_out", "text").mapInArrow(predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")
