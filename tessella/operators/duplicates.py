"""Near-duplicate topics by SimHash and MinHash fingerprints of the same features.

Features are the tokens of the Unicode tokenizer, triples of them, and shingles of the text without punctuation. They and the
fingerprints are made in Arrow batches, once per distinct text; no feature leaves the task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import tokenizer
from tessella.operators.components import components
from tessella.scratch import keep

#: Similarity thresholds, permutations, the fewest features, shingle width and step.
SIMHASH_ALIKE, MINHASH_ALIKE, PERMUTATIONS, FEWEST, WIDTH, STEP = 0.84, 0.72, 64, 16, 12, 4
#: Code that does not count, and what the compact text leaves out.
_FENCE, _LOOSE = re.compile(r"(?s)```.*?```"), regex.compile(r"[\p{P}\p{S} \t-\r]+")
_ASCII_LOOSE = bytes(c for c in range(128) if _LOOSE.match(chr(c)))
#: So many texts are read at a time.
BATCH = 256


def bands(minhash: float = MINHASH_ALIKE) -> list[tuple[int, int]]:
    """(first, length) of bands so that no alike pair is missed: fewer places differ than there are bands, so at least one
    band is equal throughout."""
    n = PERMUTATIONS - math.ceil(round(minhash * PERMUTATIONS, 9)) + 1
    ends = [round(i * PERMUTATIONS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _compact(text: str) -> str:
    """A text in lower case without punctuation, symbols and white space."""
    if text.isascii():
        return text.lower().encode().translate(None, _ASCII_LOOSE).decode()
    if tokenizer.beyond_plain(text):
        return _LOOSE.sub("", tokenizer.normalize(text))
    codes = np.frombuffer(text.lower().encode("utf-16-le"), np.uint16)  # plain characters take 16 bits each
    return codes[_kept()[codes]].tobytes().decode("utf-16-le")


@lru_cache(1)
def _kept() -> np.ndarray:
    """Which plain characters the compact text keeps, by their code."""
    return np.array([_LOOSE.match(chr(c)) is None for c in range(0x2100)])


def features(text: str | None) -> list[bytes]:
    """Tokens, token triples and shingles of the compact text, as UTF-8 and with repeats, without fenced code; null has none."""
    bare = text or ""
    if "```" in bare:
        bare = _FENCE.sub(" ", bare)
    found = tokenizer.encoded_tokens(bare)
    triples = [b"t3:" + t for t in map(b"\0".join, zip(found, found[1:], found[2:]))]
    flat = _compact(bare)
    places = range(0, len(flat) - WIDTH + 1, STEP)
    if flat.isascii():
        letters = flat.encode()
        shingles = [b"c12:" + letters[i : i + WIDTH] for i in places]
    else:
        shingles = [b"c12:" + flat[i : i + WIDTH].encode() for i in places]
    return [*found, *triples, *shingles]


_EMPTY = hashlib.sha256()
#: Texts repeat their words, but seldom three in a row: digests of short features are remembered, so many of them at most.
_SHORT: dict[bytes, bytes] = {}
REMEMBERED = 1 << 18


def _digests(found: Iterable[bytes]) -> np.ndarray:
    """The SHA-256 of each feature, a row each."""
    if len(_SHORT) > REMEMBERED:
        _SHORT.clear()
    out, empty, known = [], _EMPTY.copy, _SHORT
    for feature in found:
        if len(feature) < WIDTH:
            digest = known.get(feature)
            if digest is None:
                digest = known[feature] = hashlib.sha256(feature).digest()
        else:
            sha = empty()  # a copy is cheaper than a new one
            sha.update(feature)
            digest = sha.digest()
        out.append(digest)
    return np.frombuffer(b"".join(out), dtype=np.uint8).reshape(-1, 32)


#: So many features at a time are what fits a core's cache.
_BLOCK = 256
_TIMES, _ROOM = np.arange(PERMUTATIONS, dtype=np.uint64), np.empty((_BLOCK, PERMUTATIONS), np.uint64)


def fingerprint(found: list[bytes], simhash: bool = True) -> tuple[int | None, list[int] | None]:
    """(simhash, minhash) of features as signed 64-bit numbers; null under sixteen distinct ones. The first is null too where it
    is not asked for; then no feature is counted, as repeats do not change the other."""
    counts = Counter(found) if simhash or len(set(found[: 8 * FEWEST])) < FEWEST else found
    if len(counts) < FEWEST:
        return None, None
    digests = _digests(counts)
    parts = digests[:, 8:24].copy().view(">u8").astype(np.uint64)
    first, step = parts[:, :1], parts[:, 1:] | np.uint64(1)
    low = np.full(PERMUTATIONS, np.uint64(2**64 - 1))
    for at in range(0, len(step), _BLOCK):
        room = _ROOM[: len(step) - at]
        np.multiply(step[at : at + _BLOCK], _TIMES, out=room)
        np.add(room, first[at : at + _BLOCK], out=room)
        np.minimum(low, room.min(0), out=low)
    sim = None
    if simhash:
        weight = 1 + np.log2(np.fromiter(counts.values(), dtype=np.float64))
        bits = np.unpackbits(digests[:, :8], axis=1)  # the highest bit first
        sums = 2 * (weight @ bits) - weight.sum()
        sim = int("".join("1" if round(float(s), 9) >= 0 else "0" for s in sums), 2)
        sim = sim - (1 << 64) if sim >= 1 << 63 else sim
    return sim, low.view(np.int64).tolist()


def fingerprints(docs: DataFrame, key: str, text: str, simhash: bool = True) -> DataFrame:
    """(key, simhash, minhash): each distinct text is read once. Texts are dealt over all tasks by their hash. The SimHash is
    null where it is not asked for."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            made = [fingerprint(features(t), simhash) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int64()))], ["_h", "simhash", "minhash"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = docs.select(F.col(key), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("_h"), F.col(text).cast("string").alias("_t"))
    texts = named.repartition(tasks, "_h").groupBy("_h").agg(F.any_value("_t").alias("_t"))
    made = keep(texts.mapInArrow(run, "_h string, simhash long, minhash array<long>"), "fingerprints")
    return named.select(key, "_h").join(made, "_h").select(key, "simhash", "minhash")


def _sim(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64


def similar_pairs(prints: DataFrame, key: str, simhash: float | None = SIMHASH_ALIKE, minhash: float = MINHASH_ALIKE) -> DataFrame:
    """(a, b, simhash_similarity, minhash_similarity), a < b: bands of the MinHash find the candidates (see bands(): none is
    missed), both similarities decide. Equal MinHashes are compared as one and then listed through their smallest key."""
    known = prints.filter("minhash is not null")
    one = known.groupBy("minhash").agg(F.min(key).alias("id"), F.min_by("simhash", key).alias("simhash"))
    lead = one.select("minhash", "id", F.col("simhash").alias("_s"))
    same = known.join(lead, "minhash").filter(F.col(key) != F.col("id")).select(F.col("id").alias("a"), F.col(key).alias("b"), _sim("_s", "simhash").alias("simhash_similarity"), F.lit(1.0).alias("minhash_similarity"))
    band = F.array(*[F.xxhash64(F.lit(i), F.slice("minhash", a + 1, n)) for i, (a, n) in enumerate(bands(minhash))])
    keys = one.select("id", F.explode(band).alias("k"))
    pairs = keys.alias("x").join(keys.alias("y"), F.expr("x.k = y.k and x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    out = _likeness(pairs, one).unionByName(same)
    alike = F.col("minhash_similarity") >= minhash
    return out.filter(alike & (F.col("simhash_similarity") >= simhash) if simhash is not None else alike)


def _likeness(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """(a, b, simhash_similarity, minhash_similarity) of pairs of ids of distinct fingerprints."""
    full = pairs.join(one.select(F.col("id").alias("a"), F.col("simhash").alias("sa"), F.col("minhash").alias("ma")), "a").join(one.select(F.col("id").alias("b"), F.col("simhash").alias("sb"), F.col("minhash").alias("mb")), "b")
    mh = F.size(F.filter(F.zip_with("ma", "mb", lambda p, q: p == q), lambda e: e)) / PERMUTATIONS
    return full.select("a", "b", _sim("sa", "sb").alias("simhash_similarity"), mh.alias("minhash_similarity"))


def similar_classes(prints: DataFrame, key: str, simhash: float | None = SIMHASH_ALIKE, minhash: float = MINHASH_ALIKE) -> DataFrame:
    """(key, class_id: the smallest key of the class) of every row: classes are the connected components of similar pairs.

    Equal fingerprints count as one. Fingerprints that agree in three of their four quarters are alike in at least 0.75 of
    the places, so a group of them is tied to its smallest id in as many comparisons as it has members: these are the
    near copies that would fill a band. A band then compares only members of different classes found so far; a band whose
    members are all of one class, whatever its size, compares nothing. No link between classes is lost, since every pair
    of different classes that shares a band is verified. Rows without a fingerprint are classes of their own."""
    if minhash > 0.75:
        raise ValueError("quarters tie what is 0.75 alike")
    known = prints.filter("minhash is not null")
    equal = ["minhash"] if simhash is None else ["simhash", "minhash"]
    one = keep(known.groupBy(*equal).agg(F.min(key).alias("id"), *([F.any_value("simhash").alias("simhash")] if simhash is None else [])), "distinct-prints")
    fits = F.col("minhash_similarity") >= minhash
    fits = fits & (F.col("simhash_similarity") >= simhash) if simhash is not None else fits
    n = PERMUTATIONS // 4
    quarters = F.array(*[F.xxhash64(F.lit(q), F.slice("minhash", 1, q * n), F.slice("minhash", (q + 1) * n + 1, PERMUTATIONS)) for q in range(4)])
    cores = one.select("id", F.explode(quarters).alias("k"))
    least = cores.groupBy("k").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    tied = cores.join(least, "k").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    tied = keep(_likeness(tied, one).filter(fits).select("a", "b"), "tied")
    label = lambda links: one.select("id").join(components(links).select("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    band = F.array(*[F.xxhash64(F.lit(i), F.slice("minhash", a + 1, n)) for i, (a, n) in enumerate(bands(minhash))])
    rows = one.select("id", F.explode(band).alias("k")).join(label(tied), "id")
    some = rows.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("k")
    rows = keep(rows.join(some, "k"), "bands")  # bands where different classes meet
    each = rows.select("k", "root").distinct()
    meet = each.alias("x").join(each.alias("y"), F.expr("x.k = y.k and x.root < y.root")).select("x.k", F.col("x.root").alias("left"), F.col("y.root").alias("right"))
    pairs = meet.join(rows.select("k", F.col("root").alias("left"), F.col("id").alias("a")), ["k", "left"]).join(rows.select("k", F.col("root").alias("right"), F.col("id").alias("b")), ["k", "right"])
    found = _likeness(pairs.select("a", "b").distinct(), one).filter(fits).select("a", "b")
    classes = label(keep(tied.unionByName(found), "links"))
    named = known.join(one.select("id", *equal), equal).select(key, "id").join(classes, "id").select(key, "root")
    return prints.select(key).join(named, key, "left").select(key, F.coalesce("root", key).alias("class_id")).distinct()


def changed_duplicates(pairs: DataFrame, names: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Of similar pairs those that a changed topic is in: candidate, duplicate_of, similarities. names (key, path), changed
    (path): what a version control system lists; a pair of two changed topics is listed once, the smaller first."""
    one = names.join(changed.select("path").distinct(), "path", "left_semi").select(F.col(key).alias("c"), F.lit(True).alias("hit"))
    rows = pairs.join(one.withColumnsRenamed({"c": "a", "hit": "hit_a"}), "a", "left").join(one.withColumnsRenamed({"c": "b", "hit": "hit_b"}), "b", "left").filter("hit_a or hit_b")
    return rows.select(F.when(F.col("hit_a"), F.col("a")).otherwise(F.col("b")).alias("candidate"), F.when(F.col("hit_a"), F.col("b")).otherwise(F.col("a")).alias("duplicate_of"), "simhash_similarity", "minhash_similarity")
