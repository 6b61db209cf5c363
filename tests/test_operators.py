import math

from pyspark.sql import functions as F

from tessella.functions import classify, text
from tessella.functions.math import duration_hours, ratio
from tessella.operators import budget, fusion, governance, index, lanes, report, search, vectors


def test_bm25f_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox", "red red den"), (2, "", "fox"), (3, "", "hen")], "doc_id int, title string, body string")
    got = {r.doc_id: r.score for r in index.bm25f(docs, "doc_id", {"title": F.col("title"), "body": F.col("body")}, {"title": (2.5, 0.35), "body": (1.0, 0.75)}, spark.createDataFrame([(1, "red fox")], "query_id int, query string")).collect()}
    at, ab = 2 / 3, 5 / 3
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    norm = lambda b, n, avg: max(1 - b + b * n / avg, 0.1)
    red = 2.5 / norm(0.35, 2, at) + 2 / norm(0.75, 3, ab)
    fox1, fox2 = 2.5 / norm(0.35, 2, at), 1 / norm(0.75, 1, ab)
    sat = lambda f: f * 2.2 / (f + 1.2)
    assert abs(got[1] - (idf(1) * sat(red) + idf(2) * sat(fox1))) < 1e-9 and abs(got[2] - idf(2) * sat(fox2)) < 1e-9 and 3 not in got


def test_search_accepts_and_cuts(spark):
    rows = [("a", "name", "port_choice"), ("a", "triggers", "which port to use"), ("a", "codePath", "src/server/port.py"), ("a", "body", "we use port 8080 for the server"), ("b", "name", "database"), ("b", "body", "the server has a database on some port"), ("c", "body", "unrelated text about cooking")]
    fields = spark.createDataFrame(rows, "doc_id string, field string, value string")
    asked = spark.createDataFrame([(1, "src/server/port.py"), (2, "which port to use for the server"), (3, "quantum chromodynamics")], "query_id int, query string")
    got = [(r.query_id, r.doc_id) for r in search.search(fields, asked).collect()]
    assert (1, "a") in got and (2, "a") in got and not any(q == 3 for q, _ in got) and (1, "c") not in got
    multi = spark.createDataFrame([(1, 0, "src/server/port.py"), (1, 1, "which port to use")], "query_id int, variant int, query string")
    best = search.recall(fields, multi).orderBy("rank").first()
    assert best.doc_id == "a" and best.variants == 2 and abs(best.score - 2 / 11) < 1e-6


def test_trigrams_and_edits_at_their_limits(spark):
    one = lambda w: spark.createDataFrame([(w,)], "fragment string")
    terms = spark.createDataFrame([("abcdef",), ("abcxyz",), ("abc",)], "term string")
    got = {r.term: r.dice for r in lanes.trigram_matches(one("abcde"), terms).collect()}
    assert got["abcdef"] == round(2 * 3 / 7, 6) and "abcxyz" not in got and "abc" not in got
    words = spark.createDataFrame([("abcdefgh",), ("abcdefghi",)], "word string")
    names = spark.createDataFrame([("abcdefgh",), ("abcdefxx",), ("abcdefgxy",), ("abcdefg",)], "term string")
    found = {(r.word, r.term): r.distance for r in lanes.fuzzy_matches(words, names).collect()}
    assert found == {("abcdefgh", "abcdefg"): 1, ("abcdefghi", "abcdefgh"): 1, ("abcdefghi", "abcdefgxy"): 2, ("abcdefghi", "abcdefg"): 2}


def test_mmr_suppresses_likeness(spark):
    t = [f"t{i}" for i in range(100)]
    rows = [(1, 1, 0.9, t), (1, 2, 0.89, t[:82]), (1, 3, 0.88, t[:81]), (1, 4, 0.2, ["z"]), (1, 5, 0.2, ["y"])]
    out = fusion.mmr(spark.createDataFrame(rows, "query_id int, doc_id int, score double, tokens array<string>"), "doc_id").orderBy("position").collect()
    assert [r.doc_id for r in out] == [1, 3, 4, 5] or [r.doc_id for r in out] == [1, 4, 5, 3]
    assert 2 not in [r.doc_id for r in out]


def test_percentiles_and_null_ratios(spark):
    for n in (0, 1, 2, 20, 21):
        rows = spark.createDataFrame([(float(i),) for i in range(1, n + 1)], "v double")
        r = report.latency(rows, "v").first()
        want = [float(math.ceil(p * n)) if n else None for p in (0.5, 0.95, 0.99)]
        assert [r.p50, r.p95, r.p99] == want and r.n == n
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0)), ratio(F.lit(0), F.lit(2))).first() == (None, 0.0)
    assert duration_hours("7d") == 168 and duration_hours("24h") == 24


def test_pairing_prefers_session_then_newest(spark):
    at = lambda s: F.to_timestamp(F.lit(f"2024-01-01 {s}"))
    recalls = spark.createDataFrame([(1, "08:00:00", "a"), (2, "09:30:00", "b"), (3, "09:00:00", "a"), (4, "07:59:59", "a")], "recall_id int, t string, session string").select("recall_id", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")).alias("at"), "session", F.lit("x").alias("topic"))
    opens = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "open_id int, session string").select("open_id", at("10:00:00").alias("at"), "session", F.lit("x").alias("topic"))
    got = {r.open_id: (r.recall_id, r.same_session) for r in report.pair_as_of(opens, recalls).collect()}
    assert got == {1: (3, True), 2: (2, False), 3: (2, False)}
    late = opens.limit(1).withColumn("at", at("12:00:00"))
    assert report.pair_as_of(late, recalls.filter("recall_id in (1, 4)")).first().recall_id is None
    edge = opens.limit(1).withColumn("at", at("10:00:00"))
    assert report.pair_as_of(edge, recalls.filter("recall_id in (1, 4)")).first().recall_id == 1


def test_topic_rules(spark):
    base = dict(name="a", file_stem="a", type="lesson", authority="observed", active=True, retired_by=None, last_verified="2024-01-01", expires_at=None, review_by=None, triggers=["two words", "more words"], authority_docs=[], history_docs=[], evidence_paths=["src/a.py"])
    breaks = {"name-file-mismatch": dict(file_stem="b"), "invalid-date": dict(last_verified="2024-02-30"), "expired-topic": dict(expires_at="2023-01-01"), "review-overdue": dict(type="preference", review_by="2023-01-01"), "unneeded-review-date": dict(review_by="2030-01-01"), "retired-active": dict(retired_by="b"), "decision-without-document": dict(type="decision-pointer"), "natural-triggers-too-few": dict(triggers=["two words", "one"]), "natural-triggers-identifiers-only": dict(triggers=["one"]), "invalid-doc-id": dict(authority_docs=["a b"]), "conflicting-doc-role": dict(authority_docs=["d"], history_docs=["d"]), "unsafe-evidence-path": dict(evidence_paths=["../x"]), "work-package-reference": dict(evidence_paths=["docs/work-package/x"])}
    schema = "name string, file_stem string, type string, authority string, active boolean, retired_by string, last_verified string, expires_at string, review_by string, triggers array<string>, authority_docs array<string>, history_docs array<string>, evidence_paths array<string>, id string"
    rows = [tuple((base | change)[k] for k in base) + (code,) for code, change in ({"fine": {}} | breaks).items()]
    df = spark.createDataFrame(rows, schema).withColumn("as_of", F.to_date(F.lit("2024-06-01")))
    got = {}
    for r in governance.violations(df, "id", governance.TOPIC_RULES).collect():
        got.setdefault(r.id, set()).add(r.code)
    assert "fine" not in got and all(code in got[code] for code in breaks)
    assert all(len(v) == 1 for k, v in got.items() if k != "natural-triggers-identifiers-only")


def test_budget_steps():
    long = {"id": "a", "excerpt": "word " * 400, "terms": list("abcdefgh"), "authority": ["x", "y", "z"], "explanation": ["because " * 40] * 3}
    out = budget.fit("q", [long])
    assert out["topics"] == 1 and out["estimated_tokens"] <= 400 and budget.estimate(out["envelope"]) == out["estimated_tokens"]
    huge = long | {"id": "i" * 2000}
    assert budget.fit("q", [huge])["abstain_reason"] == "budget-empty" and budget.fit("q", [])["abstain_reason"] == "no-trusted-candidate"
    assert budget.estimate("日本 ab") == 2 + 1


def test_budget_frame(spark):
    rows = [(1, "q", r, f"t{r}", "text " * 100, ["a"], [], ["why"]) for r in (2, 1, 3)]
    df = spark.createDataFrame(rows, "query_id int, query string, rank int, id string, excerpt string, terms array<string>, authority array<string>, explanation array<string>")
    out = budget.budgeted(df, "expanded").first()
    assert out.topics == 3 and out.envelope.index("t1") < out.envelope.index("t2")


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])], "doc_id long, vector array<double>")
    got = {(r.query_id, r.doc_id): r.score for r in vectors.cosine_top_k(rows.filter("doc_id = 1").withColumnRenamed("doc_id", "query_id"), rows, 4).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.5, (1, 4): 0.5, (1, 3): 0.0}
    assert vectors.cosine_top_k(rows.limit(0).withColumnRenamed("doc_id", "query_id"), rows, 4).count() == 0


def test_classes_and_intents(spark):
    said = {"why does src/app.py fail with ERR_TIMEOUT": "path,error,natural,decision,mixed", "getUserName": "identifier", "hello": "natural", "TypeError": "error", "lib/util.js": "path"}
    df = spark.createDataFrame([(k,) for k in said], "q string").select("q", F.array_join(classify.query_classes(F.col("q")), ",").alias("c"))
    assert {r.q: r.c for r in df.collect()} == said
    asks = {"remember this.": "clarification", "please delete that note": "delete-workflow", "don't forget to rotate": "durability-review", "save the password hunter2": "sensitive-rejection", "where is the config": "recall"}
    df = spark.createDataFrame([(k,) for k in asks], "q string").select("q", classify.intent(F.col("q"))["action"].alias("a"))
    assert {r.q: r.a for r in df.collect()} == asks


def test_text_helpers(spark):
    r = spark.createDataFrame([("  a\n b  " + "x" * 20, "a/b/c.py", "日本 abcde")], "t string, p string, w string").select(text.truncate(F.col("t"), 10).alias("t"), text.path_suffixes(F.col("p")).alias("p"), text.token_estimate(F.col("w")).alias("w"), text.redact(F.lit("use sk-abcdefgh1234 now")).alias("r")).first()
    assert r.t == "a b xxxxx…" and r.p == ["a/b/c.py", "b/c.py", "c.py"] and r.w == 2 + 2 and r.r == "use [redacted] now"


def test_allowed_answers_of_an_embedding_channel(spark):
    states = spark.createDataFrame([(1, "fresh"), (2, "pending"), (3, "fresh"), (4, "fresh"), (5, "deleted")], "doc_id int, state string")
    stored = spark.createDataFrame([(1, 8), (1, 8), (2, 8), (3, 4), (5, 8)], "doc_id int, dimensions int")
    fit = vectors.allowed(states, stored, 8)
    assert [r.doc_id for r in fit.collect()] == [1]
    answers = spark.createDataFrame([(9, 1), (9, 3), (9, 77)], "query_id int, doc_id int")
    assert sorted(r.doc_id for r in vectors.outside(answers, fit).collect()) == [3, 77]
    assert tuple(vectors.staleness(states).first()) == (5, 2, 0.4, True) and tuple(vectors.staleness(states.limit(0)).first()) == (0, 0, None, True)


def test_best_excerpts_shuffle_no_lines(spark):
    """Lines are compared where they are read: rows that are exchanged hold no text."""
    from tessella.operators import search

    docs = spark.createDataFrame([(1, "a b\nb c\n\nb c a"), (2, "c\na x\nx a"), (3, None), (4, "none here"), (5, "B; b")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "zz")], "query_id int, query string")
    terms = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.5)], "term string, idf double")
    found = search.best_excerpt(docs, queries, terms)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a b"), (1, 2, "a x"), (1, 5, "B; b"), (2, 1, "b c"), (2, 2, "c")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "line" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)


def test_paths_are_compared_as_they_stand(spark):
    """A trailing slash is part of a path: SQL's ends_with does not strip it."""
    paths = spark.createDataFrame([(1, "en/1837/"), (2, "en/1837"), (3, "1837"), (4, "a//1837"), (5, "7"), (6, ""), (7, "/1837")], "doc_id int, path string")
    asked = spark.createDataFrame([(1, "1837"), (2, "x/7"), (3, ""), (4, "/1837"), (5, "1837/")], "query_id int, path string")
    want = [(q.query_id, d.doc_id) for q in asked.collect() for d in paths.collect() if q.path and d.path and (d.path == q.path or d.path.endswith("/" + q.path) or q.path.endswith("/" + d.path))]
    assert sorted(map(tuple, lanes.suffix_matches(asked, paths).collect())) == sorted(want)


def test_a_stored_index_scores_as_the_texts_do(spark):
    """Postings are brought together by document, so the pairs of queries and documents are not shuffled."""
    from tessella.operators import index

    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} common common{i}") for i in range(30)] + [(99, None)], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "w1 common"), (2, "w2 w4 common7"), (3, "none")], "query_id int, query string")
    fields, weights = {"body": F.col("text")}, {"body": (1.0, 0.4)}
    stored = {k: v.cache() for k, v in index.build(docs, "doc_id", fields).items()}
    found = index.bm25f_stored(stored, "doc_id", weights, queries)
    rows = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 9), r.matched) for r in df.collect())
    assert rows(found) == rows(index.bm25f(docs, "doc_id", fields, weights, queries))
    assert "Exchange hashpartitioning(query_id" not in found._jdf.queryExecution().toString()
