"""Joins on bounded keys against brute force: delimited triggers, edit neighbourhoods, vectors in groups."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import lanes, vectors


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("chunk", [256, 5])
def test_delimited_triggers_equal_a_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(lanes, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    alphabet = list("ab1 -.界é")
    queries = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 60, 120)] + ["", "a", "界界界", "ab " * 900]
    triggers = [q[i : i + n] for q in queries[:60] for i, n in ((0, 3), (2, 8), (1, 17), (0, 40))] + ["", "b", "界", "zz", "ab " * 800 + "ab", "ab " * 700]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, normalized string")
    t = spark.createDataFrame([(x,) for x in triggers], "normalized string")
    got = {tuple(r) for r in lanes.delimited(q, t).collect()}
    want = {(i, x) for i, s in enumerate(queries) for x in set(triggers) if x and re.search(rf"(?<![a-z0-9]){re.escape(x)}(?![a-z0-9])", s)}
    assert got == want


def test_delimited_rows_grow_with_the_query(spark):
    t = spark.createDataFrame([("界" * n,) for n in (2, 5, 9, 33)], "normalized string")
    sizes = []
    for n in (500, 2000):
        q = spark.createDataFrame([(1, "界" * n)], "query_id int, normalized string")
        plan = lanes.delimited(q, t)
        assert plan.count() == 4
        sizes.append(n)
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in plan._jdf.queryExecution().toString()


def test_delimited_triggers_are_looked_for_where_texts_are_read(spark, monkeypatch):
    rng = np.random.default_rng(6)
    alphabet = list("ab1 -.界é\n")
    queries = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 60, 120)] + ["", "aab ab", "xab,ab1 ab", "ab"]
    triggers = sorted({q[i : i + n] for q in queries[:60] for i, n in ((0, 2), (1, 5), (3, 12))} | {"", "ab", ".", "é", "ab1 ab"})
    q = spark.createDataFrame([*enumerate(queries), (3, None), (4, queries[4])], "query_id int, normalized string")
    t = spark.createDataFrame([(x,) for x in triggers], "normalized string")
    carried = lanes.delimited(q, t)
    plan = carried._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # no row per place of a text
    rows = sorted(map(tuple, carried.collect()))
    for bound in ("CARRIED", "CARRIED_CHARACTERS", "CARRIED_BARE"):
        with monkeypatch.context() as m:
            m.setattr(lanes, bound, 0)
            assert sorted(map(tuple, lanes.delimited(q, t).collect())) == rows != []
    assert lanes.delimited(q, t.limit(0)).count() == 0


def words(seed, n):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abc"), k)) for k in rng.integers(1, 40, n)]
    out = set(base)
    for w in base:
        for _ in range(3):
            v = list(w)
            for _ in range(rng.integers(1, 4)):
                at = int(rng.integers(0, len(v) + 1))
                kind = rng.integers(0, 3)
                if kind == 0:
                    v.insert(at, "abcd"[rng.integers(0, 4)])
                elif v and at < len(v):
                    v[at : at + 1] = [] if kind == 1 else ["d"]
            out.add("".join(v))
    return sorted(w for w in out if w)


@pytest.mark.parametrize("seed", [1, 2])
def test_edit_neighbours_equal_all_pairs(spark, seed):
    some = words(seed, 60)
    df = spark.createDataFrame([(w,) for w in some], "word string")
    got = {tuple(r) for r in lanes.fuzzy_matches(df, df.withColumnRenamed("word", "term")).collect()}
    want = {(a, b, d) for a in some for b in some if abs(len(a) - len(b)) <= 2 and 0 < (d := edits(a, b)) <= (2 if len(a) >= 9 else 1)}
    assert got == want and len(want) > 100


def test_candidates_do_not_grow_with_the_vocabulary_of_a_length(spark):
    terms = spark.range(20_000).select(F.concat(F.lit("w"), F.lpad(F.conv(F.xxhash64("id").cast("string"), 10, 36), 13, "0")).alias("term"))
    asked = terms.limit(5).select(F.concat("term", F.lit("x")).alias("word"))
    keys = asked.select("word", F.explode(text.edit_lookups(F.col("word"))).alias("key"))
    met = keys.join(terms.select("term", F.explode(text.edit_keys(F.col("term"))).alias("key")), "key").select("word", "term").distinct()
    assert 5 <= met.count() <= 10


@pytest.mark.parametrize(("group", "fewest"), [(32_768, 1_024), (50, 10)])
def test_vectors_in_groups_equal_brute_force(spark, monkeypatch, group, fewest):
    monkeypatch.setattr(vectors, "GROUP", group)
    monkeypatch.setattr(vectors, "FEWEST", fewest)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 5)), 2)
    x[40:120] = x[3]  # a hot vector: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 5), (901, None)]
    df = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    got = sorted((r.query_id, r.rank, r.doc_id) for r in vectors.cosine_top_k(df.withColumnRenamed("doc_id", "query_id"), df, 7).collect())
    x = np.vstack([x, np.zeros(5)])
    ids = [*range(300), 900]
    n = np.linalg.norm(x, axis=1)
    unit = x / np.where(n > 0, n, 1)[:, None]
    score = np.round(np.clip((unit @ unit.T + 1) / 2, 0, 1), 9)
    want = [(q, r + 1, ids[c]) for q, s in zip(ids, score) for r, c in enumerate(sorted(range(len(ids)), key=lambda c: (-s[c], ids[c]))[:7])]
    assert got == sorted(want)


def test_vectors_stay_in_the_cluster(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.array(*[F.rand(i) for i in range(4)]).alias("vector"))
    plan = vectors.cosine_top_k(df.withColumnRenamed("doc_id", "query_id"), df, 3)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "NestedLoop" not in plan and plan.count("Range (0, 5000") <= 8
