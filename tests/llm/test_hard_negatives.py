"""Hard negatives against brute force: ties, repeated rows, rows that take no part, hot vectors, empty tables."""

import math

import duckdb
import numpy as np
import pytest

from tessella.llm import hard_negatives as hn
from tessella.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, q string, list string, away int"


def brute(rows, every=100, positives=5, k=5):
    used = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        used[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = []
    for i, label, q in used:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), j, la) for j, la, p in used if (j, la, p) != (i, label, q))
        good = [s for s in scored if s[2] == label][:positives]
        for gs, g, _ in good:
            bad = [s for s in scored if s[2] != label and 80 * -gs <= 100 * -s[0] <= 100 * -gs][:k]
            out += [(i, g, r + 1, b, -gs, -bs) for r, (bs, b, _) in enumerate(bad)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, la, "x", "y", 0) for i, v, la in rows], SCHEMA)


def made(n=700, width=6, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, width)) * 2
    rows = [(int(i), [float(np.float32(x)) for x in centers[i % 9] + rng.normal(size=width) * 0.7], int(rng.integers(0, 10))) for i in range(n)]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(150)]  # a hot vector: ties go to the smaller id
    rows += rows[:20]  # repeated rows count once
    odd = [(2000, None, 1), (2100, [None] * width, 1), (2200, [math.nan] * width, 2), (2300, [math.inf] * width, 2), (2400, rows[1][1], None), (None, rows[1][1], 1), (2500, [], 1), (2600, [0.0] * width, 1)]
    return rows + odd


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("block", "anchors", "rounds"), [(512, 256, (4, 32)), (32, 2, (1, 2))])
def test_equals_brute_force(spark, monkeypatch, block, anchors, rounds):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    monkeypatch.setattr(hn, "MEET", 1)
    monkeypatch.setattr(hn, "ROUNDS", rounds)
    rows = made()
    assert rows_of(hn.hard_negatives(table(spark, rows))) == brute(rows)


def test_lists_outside_the_window_are_not_visited(spark):
    rng = np.random.default_rng(1)
    far = np.eye(8) * 20
    rows = [(int(i), [float(x) for x in far[i % 8] + rng.normal(size=8) * 0.01], int(i % 3)) for i in range(1600)]
    index = hn.Index(hn.quantized(table(spark, rows)))
    anchors = index.rows.where("vec_id = 100").selectExpr("vec_id anchor_id", "label", "q", "array(named_struct('id', 0L, 'least', 1000000L, 'most', 99999999999L, 'kth', cast(null as long))) windows")
    visited = {r["list"] for r in hn._visits(anchors, index, 0, len(index.sizes)).collect()}
    assert 0 < len(visited) < len(index.sizes)


def test_empty_and_without_anchors(spark):
    assert hn.hard_negatives(table(spark, [])).collect() == []
    assert hn.hard_negatives(table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)])).collect() == []
    assert hn.hard_negatives(table(spark, [(100, [1.0, 2.0], 1)])).collect() == []


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert rows_of(queries.op11_hard_negatives(spark, sf)) == sorted(con.sql(hn.ORACLE).fetchall())
