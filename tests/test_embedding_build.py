"""Builds resume after failures without asking twice; retries, contracts, changed texts and headers."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import embedding
from tessella.operators.embedding import ProviderError, VectorStore

HEADER = {"provider": "p", "model": "m", "dimensions": 2}


def told(log, fail=None):
    """An embedder that notes in a file what it is asked for, and fails on a text."""

    def embed(texts):
        with open(log, "a") as out:
            for t in texts:
                out.write(t + "\n")
        if fail in texts:
            raise ProviderError(401)
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def test_a_failed_build_resumes_without_repeated_calls(spark, tmp_path):
    corpus = spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(60)], "doc_id string, text string")
    store = VectorStore(spark, f"file://{tmp_path}/v", HEADER)
    last = corpus.orderBy(F.desc(F.pmod(F.xxhash64("doc_id"), F.lit(6))), "doc_id").first()  # of the last of six slices
    with pytest.raises(Exception, match="401"):
        store.build(corpus, told(tmp_path / "one", last.text), commit_rows=10)
    kept = {r.doc_id for r in store.stored().collect()}
    assert 0 < len(kept) < 60 and last.doc_id not in kept
    assert store.build(corpus, told(tmp_path / "two"), commit_rows=10) == 60 - len(kept)
    again = (tmp_path / "two").read_text().split("\n")[:-1]
    assert len(again) == len(set(again)) == 60 - len(kept) and not {f"text {d[1:]}" for d in kept} & set(again)
    assert store.current(corpus).count() == 60 and store.build(corpus, told(tmp_path / "three")) == 0
    changed = corpus.filter("doc_id <> 'd3'").withColumn("text", F.when(F.col("doc_id") == "d5", "other").otherwise(F.col("text"))).unionByName(corpus.limit(1))
    assert store.pending(changed).count() == 1 and store.build(changed, told(tmp_path / "four")) == 1
    assert {r.doc_id: r.vector for r in store.current(changed).collect()}["d5"] == [5.0, 1.0] and store.current(changed).count() == 59
    other = VectorStore(spark, f"file://{tmp_path}/v", HEADER | {"model": "n"})
    assert other.stored().count() == 0 and other.build(corpus.limit(3), told(tmp_path / "five")) == 3 and store.stored().count() == 0
    assert store.build(corpus.limit(0), told(tmp_path / "six")) == 0


def test_tries_and_contract():
    waits, turns = [], iter([ProviderError(503), ProviderError(429), [[1.0]]])

    def flaky(texts):
        got = next(turns)
        if isinstance(got, Exception):
            raise got
        return got

    assert embedding.asked(flaky, ["a"], 1, waits.append) == [[1.0]] and waits == [0.2, 0.4]
    turns = iter([ProviderError(503)] * 3)
    with pytest.raises(ProviderError):
        embedding.asked(flaky, ["a"], 1, waits.append)
    turns = iter([ProviderError(401)])
    with pytest.raises(ProviderError):
        embedding.asked(flaky, ["a"], 1, waits.append)
    for bad in ([], [[1.0, 2.0]], [[float("nan")]], [[0.0]]):
        with pytest.raises(ValueError):
            embedding.checked(bad, 1, 1)


def test_channel_needed(spark):
    rows = [(None, False), ('{"enabled": true}', True), ('{"enabled": false}', False), ('{"enabled": "true"}', False), ("{}", False), ("{broken", True)]
    df = spark.createDataFrame(rows, "c string, want boolean")
    assert df.filter(embedding.channel_needed(F.col("c")) != F.col("want")).count() == 0
