"""Phrase collocations by Apriori passes: one pass over the texts per phrase length, then cuts scored from the level tables.

A pass splits windows of text into words (numpy on the bytes), numbers words and phrases within the window, and emits the
k-word phrases whose two overlapping (k-1)-word phrases are frequent. That test is a broadcast bitmap of hashes with a
fixed most size: a bit set by chance lets a phrase through that the count then refuses, so results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._scale import keep

#: Bytes of one language that are counted together in a task.
WINDOW_BYTES = 8 << 20
#: Bits of a broadcast bitmap at most (32 MB), and in each of the blocks it is built from.
MOST_BITS, BLOCK_BITS = 1 << 28, 1 << 18
#: Partial leaders: the best of a language are found in so many parts before they meet.
PARTS = 16

_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return h ^ (h >> np.uint64(29))


def _phrase_hashes(columns: list[np.ndarray], lang: str) -> np.ndarray:
    """Hashes of phrases whose words have the hashes in `columns` (one array per place)."""
    with np.errstate(over="ignore"):
        out = np.full(len(columns[0]), _word_hashes([lang.encode("utf-8", "surrogatepass")])[0])
        for c in columns:
            out = _mixed(out * _MIX + c)
    return out


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value in order of first sight, first place of each number)."""
    numbers = pa.array(values).dictionary_encode().indices.to_numpy()
    first = np.empty(int(numbers.max()) + 1, np.int64)
    first[numbers[::-1]] = np.arange(len(values) - 1, -1, -1)
    return numbers, first


def _count(data: np.ndarray, lang: str, k: int, frequent: list[np.ndarray]) -> pa.RecordBatch | None:
    """The k-word phrases of a window with their counts; at k = 1 also the number of its words, under a null phrase."""
    kind = _KIND[data]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return None
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    if k == 1:
        n = np.append(np.bincount(codes, minlength=len(words)), len(codes))
        return _batch(lang, pa.array([*words.to_pylist(), None], pa.binary()), n)
    hashes = _word_hashes(words.to_pylist())
    # A pair stays in its piece unless a break lies between its words.
    breaks = np.flatnonzero(kind == 2)
    joined = np.diff(np.searchsorted(breaks, starts)) == 0
    good = _has(frequent[0], _phrase_hashes([hashes], lang))[codes]
    numbers, at = codes, np.arange(len(codes))
    for j in range(2, k + 1):
        # numbers[i] stands for the (j-1)-word phrase at at[i], good[i] says whether it is frequent
        pair = np.flatnonzero(good[:-1] & good[1:] & (np.diff(at) == 1))
        pair = pair[joined[at[pair]]]  # the rest of the phrase stays in its piece by the levels before
        if not len(pair):
            return None
        low = np.int64(numbers.max()) + 1
        numbers, first = _distinct(numbers[pair].astype(np.int64) * low + numbers[pair + 1])
        at = at[pair]
        places = [codes[at[first] + i] for i in range(j)]
        if j < k:
            good = _has(frequent[j - 1], _phrase_hashes([hashes[p] for p in places], lang))[numbers]
    texts = pc.binary_join_element_wise(*[words.take(pa.array(p)) for p in places], pa.scalar(b" ", pa.large_binary()))
    return _batch(lang, texts.cast(pa.binary()), np.bincount(numbers))


def _batch(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases.view(pa.string()), pa.array(n, pa.int64())], schema=_COUNTS)


def _edge(text: bytes, at: int, step: int, stop: int) -> int:
    """From a word's edge over what lies between words and one more word, forwards or backwards."""
    here = 0 if step > 0 else -1
    for inside in (False, True):
        while at != stop and (not _KIND[text[at + here]]) == inside:
            at += step
    return at


def _windows(text: bytes, k: int) -> Iterator[bytes]:
    """A long text in windows that end between words and share k - 1 words, so each k-word phrase lies in exactly one."""
    lo, end = 0, len(text)
    while end - lo > WINDOW_BYTES:
        hi = lo + WINDOW_BYTES
        while hi < end and not _KIND[text[hi]]:
            hi += 1
        while True:
            back = hi
            for _ in range(k - 1):
                back = _edge(text, back, -1, lo)
            if back > lo or hi == end:
                break
            hi = _edge(text, hi, 1, end)  # fewer than k words, as words may be huge
        yield text[lo:hi]
        if hi == end:
            return
        lo = back
    yield text[lo:]


def _counter(k: int, bitmaps: list):
    """Arrow function from (lang, text) to partial counts of k-word phrases."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = [b.value for b in bitmaps]
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            size.pop(lang)
            out = _count(np.frombuffer(b"\n".join(held.pop(lang)), np.uint8), lang, k, frequent)
            if out is not None:
                for i in range(0, out.num_rows, 200_000):
                    yield out.slice(i, 200_000)

        for batch in batches:
            texts = batch.column(1).view(pa.binary()) if pa.types.is_string(batch.column(1).type) else batch.column(1).view(pa.large_binary())
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                for part in _windows(text.as_py(), k):
                    if size.get(lang, 0) + len(part) > WINDOW_BYTES and lang in held:
                        yield from flush(lang)
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part)
            while sum(size.values()) > 4 * WINDOW_BYTES:  # many languages: the largest goes
                yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    return count


def _bitmap(level: DataFrame):
    """A broadcast bitmap of the phrases of a kept level, at most MOST_BITS long whatever the level's size."""
    spark = level.sparkSession
    bits = 1 << 16
    rows = level.count()
    while bits < 16 * rows and bits < MOST_BITS:
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.empty(batch.num_rows, np.int64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                words = _word_hashes(phrase.split(b" "))
                at[i] = int(_phrase_hashes([words[j : j + 1] for j in range(len(words))], lang)[0] & np.uint64(bits - 1))
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    def block(key, pdf):
        import pandas as pd

        out = np.zeros(BLOCK_BITS // 8, np.uint8)
        at = pdf["at"].to_numpy() % BLOCK_BITS
        np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return pd.DataFrame({"block": [key[0]], "bits": [out.tobytes()]})

    marked = level.select("lang", "phrase").mapInArrow(places, "at long").distinct()
    found = marked.withColumn("block", F.expr(f"at div {BLOCK_BITS}")).groupBy("block").applyInPandas(block, "block long, bits binary")
    out = np.zeros(max(bits, BLOCK_BITS) // 8, np.uint8)
    for r in found.toLocalIterator():  # MOST_BITS / BLOCK_BITS blocks at most
        out[r["block"] * BLOCK_BITS // 8 :][: BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(out[: bits // 8])


def phrase_counts(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(phrases, totals, tables to drop): lang, phrase, k, f of all phrases of 1..longest words found `least` times or more
    in their language, and lang, n with the number of its words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("text <> ''")
    levels, bitmaps = [], []
    for k in range(1, longest + 1):
        counted = texts.mapInArrow(_counter(k, bitmaps), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        levels.append(keep(counted.where((F.col("f") >= least) | F.col("phrase").isNull()).withColumn("k", F.lit(k)), f"phrases-{k}"))
        if k < longest:
            bitmaps.append(_bitmap(levels[-1].where("phrase is not null")))
    for b in bitmaps:
        b.unpersist()
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.where("phrase is not null"), levels[0].where("phrase is null").select("lang", F.col("f").alias("n")), levels


def _joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """The best `top` phrases of 2..longest words of each language: lang, rank, phrase, a, l, r, n, score.

    docs needs lang and text; other columns are ignored, whatever their names. A null language is `und`, together with a
    language of that name; a null text is empty and counts nothing; repeated rows count as often as they occur. The text
    is lower-cased in A-Z only, cut into pieces at .,;:!? and line breaks, and into words at blanks and tabs. A phrase of
    `least` occurrences or more is a candidate; it is scored at its worst cut (ties: the first), dropped where a longer
    candidate that holds it is as frequent, and ranked by score, occurrences and then its bytes, so no two tie. Texts are
    read in windows, so their length is no limit. Empty tables give no rows."""
    phrases, totals, _ = phrase_counts(docs, longest, least)
    many = phrases.where("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = many.select("lang", "phrase", "f", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "f", "cut", _joined(F.col("w"), F.lit(1), F.col("cut")).alias("first"), _joined(F.col("w"), F.col("cut") + 1, F.size("w")).alias("rest"))
    known = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    # 1000 a n stays under 38 digits up to 10^17 words; the quotient is 1000 n / max(l, r) at most and fits a long.
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(f as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "f", "l", "r", "n")).alias("b"))
    lengths = F.sequence(F.lit(2), F.col("k") - 1)
    inner = many.where("k > 2").withColumn("len", F.explode(lengths)).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("len") + 1)))
    inner = inner.groupBy("lang", _joined(F.col("w"), F.col("at"), F.col("len")).alias("phrase")).agg(F.max("f").alias("longer"))
    left = best.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < b.f")
    out = left.select("lang", "phrase", F.col("b.f").alias("a"), "b.l", "b.r", "b.n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    out = out.withColumn("rank", F.row_number().over(part.orderBy(*order))).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with texts as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
pieces as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') w from texts),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase
  from (select lang, k, w, unnest(range(1, len(w) - k + 2)) i from pieces, range(1, 6) t(k) where len(w) >= k)),
counts as materialized (select lang, k, phrase, count(*) f from grams group by all),
frequent as materialized (select * from counts where f >= 100),
totals as (select lang, sum(f) n from counts where k = 1 group by lang),
many as materialized (select lang, k, phrase, f, string_split(phrase, ' ') w from frequent where k > 1),
split as (select lang, phrase, f, w, k, unnest(range(1, k)) cut from many),
cuts as materialized (select *, array_to_string(w[1:cut], ' ') fore, array_to_string(w[cut + 1:k], ' ') aft from split),
scored as (
  select c.lang, c.phrase, c.cut, c.f a, l.f l, r.f r, n,
    (1000::hugeint * c.f::hugeint * n::hugeint) // (l.f::hugeint * r.f::hugeint) score
  from cuts c join totals using (lang)
  join frequent l on l.lang = c.lang and l.phrase = c.fore
  join frequent r on r.lang = c.lang and r.phrase = c.aft),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inside as (
  select lang, array_to_string(w[i:i + m - 1], ' ') phrase, max(f) longer
  from (select lang, w, f, m, unnest(range(1, k - m + 2)) i from (select *, unnest(range(2, k)) m from many where k > 2)) group by all),
ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) rank
  from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where longer is null or longer < a)
select lang, rank, phrase, a, l, r, n::bigint n, score::bigint score from ranked where rank <= 2000
"""
