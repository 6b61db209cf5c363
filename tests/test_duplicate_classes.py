"""Classes of near duplicates against all pairs, with hot bands of near copies and of unlike prints."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import regex

from tessella.functions import tokenizer
from tessella.operators import duplicates
from tessella.operators.components import components


def test_components_equal_a_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(150)] + [(2000, 2000 + i) for i in range(1, 80)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root} and components(spark.createDataFrame([], "a long, b long")).count() == 0


def prints(rng, base, n, changed):
    out = []
    for _ in range(n):
        p = base.copy()
        at = rng.choice(64, int(rng.integers(0, changed + 1)), replace=False)
        p[at] = rng.integers(1 << 40, 1 << 41, len(at))
        out.append(p)
    return out


def classes(rows, simhash):
    ids = [i for i, s, m in rows]
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, s, m) in enumerate(rows):
        for j, t, n in rows[:x]:
            if m is not None and n is not None and (m == n).sum() >= 0.72 * 64 and (simhash is None or bin((s ^ t) & (2**64 - 1)).count("1") <= 64 - simhash * 64):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_classes_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 1 << 40, 64) for _ in range(4)]
    base[1][:20] = base[0][:20]  # unlike groups share bands
    rows = [m for b in base for m in prints(rng, b, 60, 14)] + [m for m in prints(rng, base[0], 60, 40)] + [base[2]] * 3
    for i in range(40):  # a chain of prints, each alike the next only
        m = base[3].copy()
        m[: min(64, 2 * i)] = np.arange(min(64, 2 * i)) + 7
        rows.append(m)
    table = [(i, int(rng.integers(0, 4)), m) for i, m in enumerate(rows)] + [(900, None, None)]
    df = spark.createDataFrame([(i, s, None if m is None else m.tolist()) for i, s, m in table], "doc_id long, simhash long, minhash array<long>")
    for simhash in (None, 0.84, 0.97):
        got = {r.doc_id: r.class_id for r in duplicates.similar_classes(df, "doc_id", simhash).collect()}
        assert got == classes(table, simhash), simhash
        assert len(set(got.values())) > 4


def test_a_hot_band_of_near_copies_takes_linear_rows(spark):
    """50,000 near copies: all are tied to a few leaders, and no band has two classes left to compare."""
    from pyspark.sql import functions as F

    n = 50_000
    at = F.sequence(F.lit(0), F.lit(63))
    minhash = F.transform(at, lambda j: F.when((j == F.col("id") % 16), F.col("id") + 1000).otherwise(j).cast("long"))
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("simhash"), minhash.alias("minhash"))
    got = duplicates.similar_classes(df, "doc_id")
    assert got.select("class_id").distinct().count() == 1 and got.count() == n


def odd_texts():
    draw = random.Random(4)
    letters = "aAbZ09 ._:/\\-ßéÉœł’\n\x01½一кЖﬁ$€"
    some = ["".join(draw.choices(letters[: draw.choice((12, 19, len(letters)))], k=draw.randint(0, 200))) for _ in range(300)]
    return [None, "", "a b", "one two three four five six seven eight", "x y\n```\ncode that does not count\n```\nseen c12:abcdefghijkl abcdefghijklmnop, the rest of it", "ab " * 500, *some]


def test_fingerprints_equal_their_definition():
    for text in odd_texts():
        bare = re.sub(r"(?s)```.*?```", " ", text or "")
        tokens = tokenizer.tokenize(bare)
        flat = regex.sub(r"[\p{P}\p{S} \t-\r]+", "", tokenizer.normalize(bare))
        found = tokens + ["t3:" + "\0".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] + ["c12:" + flat[i : i + 12] for i in range(0, len(flat) - 11, 4)]
        assert Counter(f.decode() for f in duplicates.features(text)) == Counter(found)
        counts = Counter(found)
        if len(counts) < 16:
            assert duplicates.fingerprint(duplicates.features(text)) == (None, None)
            continue
        digests = [hashlib.sha256(f.encode()).digest() for f in counts]
        a, b = ([int.from_bytes(d[i : i + 8], "big") for d in digests] for i in (8, 16))
        minhash = [min((x + i * (y | 1)) % 2**64 for x, y in zip(a, b)) for i in range(64)]
        first = [int.from_bytes(d[:8], "big") for d in digests]
        weights = [1 + math.log2(n) for n in counts.values()]
        simhash = sum((round(sum(w if h >> i & 1 else -w for h, w in zip(first, weights)), 9) >= 0) << i for i in range(64))
        signed = lambda n: n - 2**64 if n >= 2**63 else n
        assert duplicates.fingerprint(duplicates.features(text)) == (signed(simhash), [signed(m) for m in minhash])
        assert duplicates.fingerprint(duplicates.features(text), simhash=False) == (None, [signed(m) for m in minhash])


def test_fingerprints_without_a_simhash_give_the_same_pairs_and_classes(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts() + odd_texts()[3:20])], "doc_id long, text string")
    both = duplicates.fingerprints(rows, "doc_id", "text")
    bare = duplicates.fingerprints(rows, "doc_id", "text", simhash=False)
    assert bare.filter("simhash is not null").count() == 0 and both.count() == bare.count() == rows.count()
    for made in (lambda p: duplicates.similar_pairs(p, "doc_id", simhash=None).select("a", "b", "minhash_similarity"), lambda p: duplicates.similar_classes(p, "doc_id", simhash=None)):
        assert sorted(map(tuple, made(both).collect())) == sorted(map(tuple, made(bare).collect())) != []


def test_equal_minhashes_of_unlike_simhashes_are_listed_through_the_smallest_key(spark):
    """As in the SQL of near_dup_minhash: the same features in other numbers are one MinHash, and only its first text is compared
    with others."""
    base = np.arange(64) + 5
    near = base.copy()
    near[:4] = 99
    table = [(1, 0b1111, base), (2, 0, base), (3, 0b1111, near), (4, (1 << 20) - 1, base)]
    df = spark.createDataFrame([(i, s, m.tolist()) for i, s, m in table], "doc_id long, simhash long, minhash array<long>")
    got = {tuple(r) for r in duplicates.similar_pairs(df, "doc_id", simhash=None).collect()}
    assert got == {(1, 2, 1 - 4 / 64, 1.0), (1, 3, 1.0, 60 / 64), (1, 4, 1 - 16 / 64, 1.0)}
    assert {tuple(r)[:2] for r in duplicates.similar_pairs(df, "doc_id").collect()} == {(1, 2), (1, 3)}
