"""Substring joins against brute force, and the two ways of exact_fields against each other."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import containment, search


def pairs(spark, values, queries):
    v = spark.createDataFrame(values, "doc_id int, value string")
    q = spark.createDataFrame(queries, "query_id int, query string")
    got = sorted((r.query_id, r.doc_id) for r in containment.holding(v, "value", q, "query").collect())
    assert got == sorted((i, d) for i, t in queries if t for d, x in values if x is not None and t in x)
    return got


def test_equals_brute_force(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abé😀 \n") for _ in range(rnd.randint(1, 40)))
    values = [(i, word() * rnd.randint(1, 4)) for i in range(150)] + [(900, None), (901, ""), (902, "ab" * 30), (902, "ab" * 30)]
    queries = [(i, word()[: rnd.choice([1, 2, 3, 5, 9, 17, 33])]) for i in range(200)] + [(500, None), (501, ""), (502, "ab"), (502, "ab")]
    values += [(1000 + i, "x" + q + "y") for i, (_, q) in enumerate(queries) if q]
    assert len(pairs(spark, values, queries)) > 1000


@pytest.mark.parametrize("at", [0, 1000, 1008, 1009, 1023, 1024, 1025, 2040, 2048])
def test_runs_across_pieces(spark, at):
    needle = "needle of a query 😀 that crosses pieces"
    assert pairs(spark, [(1, "😀" * at + needle + "z" * 50), (2, "😀" * at + needle[:-1])], [(1, needle), (2, needle[:16]), (3, needle[-9:])]) == [(1, 1), (2, 1), (2, 2), (3, 1)]


def test_very_long_values_and_empty_sides(spark):
    long = "lorem ipsum " * 200_000 + "the end"
    assert pairs(spark, [(1, long)], [(1, "m the end"), (2, "ipsum the end"), (3, "ipsum  lorem"), (4, long)]) == [(1, 1), (2, 1), (4, 1)]
    assert pairs(spark, [], [(1, "a")]) == [] and pairs(spark, [(1, "a")], []) == [] and pairs(spark, [(1, "a")], [(1, "")]) == []


def test_both_ways_of_exact_fields_agree(spark, monkeypatch):
    rows = [(f"d{i}", f, v) for i in range(40) for f, v in (("name", f"Port_{i}"), ("body", f"the server {i % 7} uses port_{i % 11} in STRASSE and straße"), ("other", "port_1"))]
    fields = spark.createDataFrame(rows, "doc_id string, field string, value string")
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["port_1", "SERVER 3", "straße", "", None, "nothing", "the server 5 uses port_5"])], "query_id int, query string")
    get = lambda: sorted(map(tuple, search.exact_fields(fields, asked).collect()))
    few = get()
    monkeypatch.setattr(search, "BLOCK", 0)
    assert get() == few and few and {f for *_, e in few for f in e} == {"name", "body"}


def test_many_queries_do_not_pass_the_driver(spark, monkeypatch):
    """5,000 queries are one join on runs: no query is a constant of the plan, and no pair is compared but by key."""
    fields = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("body").alias("field"), F.concat(F.lit("value number "), F.col("id").cast("string"), F.lit(" of the table")).alias("value"))
    asked = spark.range(5000).select(F.col("id").alias("query_id"), F.concat(F.lit("number "), F.col("id").cast("string"), F.lit(" of")).alias("query"))
    out = search.exact_fields(fields, asked)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "4999" not in plan and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.doc_id) for r in out.collect()) == [(i, i) for i in range(300)]
