from pyspark.sql import functions as F

from tessella.operators import runtime


def test_decisions(spark):
    df = spark.createDataFrame([(1, "sha256 differs"), (2, "schema v1"), (3, "ENOENT: no such file"), (4, "boom")], "i int, m string")
    assert [r.t for r in df.select("i", runtime.rebuild_trigger(F.col("m")).alias("t")).orderBy("i").collect()] == ["checksum-mismatch", "schema-mismatch", "missing-artifact", None]
    rows = [(True, 2, 1, True, None), (True, 1, 2, True, None), (False, 1, 1, True, True), (None, 1, 1, True, False)]
    df = spark.createDataFrame(rows, "v boolean, r int, w int, c boolean, b boolean")
    assert [r[0] for r in df.select(runtime.read_decision(F.col("v"), F.col("r"), F.col("w"), F.col("c"), F.col("b"))).collect()] == ["ready", "rebuild", "rebuilt", "markdown-fallback"]


def test_activation(spark):
    fresh = spark.createDataFrame([("fresh",)] * 9 + [("pending",)], "state string")
    old = spark.createDataFrame([("pending",)], "state string")
    safe, unsafe = (spark.createDataFrame([(x,)], "safe boolean") for x in (True, False))
    get = lambda *a, **k: tuple(runtime.activation(*a, **k).first())
    assert get(fresh, safe, "weighted") == ("weighted", None)
    assert get(fresh, unsafe, "weighted") == ("observe", "guard-not-safe")
    assert get(fresh, unsafe, "weighted", force=True, confirm=True) == ("weighted", "forced")
    assert get(old, safe, "weighted") == ("off", "vectors-stale") and get(fresh, safe, "off")[0] == "off"


def test_caches(spark):
    asked = spark.createDataFrame([("A b",), ("a b ",), ("c",)], "query string")
    todo = runtime.missing_vectors(asked, spark.createDataFrame([], "cache_key string"), "m")
    assert todo.count() == 2 and runtime.missing_vectors(asked, todo, "m").count() == 0 and runtime.missing_vectors(asked, todo, "other").count() == 2
    lru = spark.createDataFrame([("s", i) for i in range(10)], "k string, t int")
    assert {r.t for r in runtime.newest(lru, ["k"], "t", "t", 3).collect()} == {7, 8, 9}


def test_paths(spark):
    paths = ["src/a.py", "/etc/x", "../up", "a/../b", "C:x", "", None, "mem/a_b.md", "mem/MEMORY.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [tuple(r) for r in df.select(runtime.safe_path(F.col("p")), runtime.tool_query(F.lit("Edit"), F.col("p")), runtime.opened_topic(F.col("p"), "mem")).collect()]
    assert [g[0] for g in got] == [True, False, False, False, False, False, False, True, True]
    assert got[0][1] == "src/a.py" and got[1][1] is None and got[7][2] == "a_b" and got[8][2] is None


def test_embedding(spark):
    df = spark.createDataFrame([(i, f"text number {i % 3}") for i in range(70)], "doc_id int, text string")
    rows = {r.doc_id: r.vector for r in runtime.embed(df, "doc_id", "text", runtime.hashing_embedder(16)).collect()}
    assert rows[0] == rows[3] and rows[0] != rows[1] and abs(sum(x * x for x in rows[0]) - 1) < 1e-5
    bad = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "a", 0.8), (1, 3, "b", 0.85), (1, 4, "c", 1.5)], "query_id int, position int, doc_id string, score double")
    assert [r.code for r in runtime.invalid_candidates(bad).orderBy("position").collect()] == ["duplicate", "not-sorted", "score-range"]
    assert runtime.embedding_lane(spark.createDataFrame([(1, 1, 0.0)], "query_id int, doc_id int, cosine double")).first().score == 0.5
