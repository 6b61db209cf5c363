"""Events as lines: what they hold, that they are valid, and that the append keeps broken ones out."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import jsonschema
from tessella.operators import producers
from tessella.sources import event_schema, logs

CHANNELS = ("exact", "bm25f")


@pytest.fixture(scope="module")
def log():
    return producers.Log("events/v1", F.to_timestamp(F.lit("2026-01-02 03:04:05.678")), "22", "1")


def faults(rows, event):
    return rows.select(jsonschema.violations(F.col("value"), event_schema.schema("events/v1", (event,))).alias("v"))


def test_recalls(spark, log):
    measures = "total_ms double, load_ms double, plan_ms double, rank_ms double, context_ms double, estimated_tokens double, dropped_topics int, truncated boolean, hot boolean, mode string, status string, snapshot_id string, embedding struct<active:boolean,latency_ms:double,cache_hit:boolean,degraded_reason:string>"
    rows = [
        (1, "port", ["path"], 1.23456, 1.0, 2.0, 3.0, 4.0, 10.4, 2, True, True, "snapshot", "previous", "s1", (True, 2.0, False, None)),
        (2, "none", [], -1.0, float("nan"), float("inf"), None, 0.0, None, None, None, None, None, None, None, None),
        (3, "many", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, -3, False, False, "snapshot", "ready", "s1", None),
    ]
    asks = spark.createDataFrame(rows, f"query_id int, query string, classes array<string>, {measures}")
    lanes = spark.createDataFrame([(1, "exact", "a"), (1, "bm25f", "a"), (1, "bm25f", "b"), (3, "bm25f", "c")], "query_id int, channel string, doc_id string")
    answers = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")] + [(3, i, f"t{i}") for i in range(30)], "query_id int, position int, doc_id string")
    gone = spark.createDataFrame([(2, "other")], "query_id int, reason string")
    out = producers.recalls(log, asks, lanes, answers, gone, "key", CHANNELS)
    assert [r.v for r in faults(out, "recall.completed").collect()] == [[], [], []]
    got = {r.query_id: json.loads(r.value) for r in out.collect()}
    one, two, three = (got[i]["payload"] for i in (1, 2, 3))
    assert one["channels"] == {"exact": 1, "bm25f": 2} and one["rrf_candidates"] == 2 and one["returned_topics"] == ["a", "b"] and one["consumption_eligible"]
    assert one["total_ms"] == 1.235 and one["estimated_tokens"] == 10 and one["execution"] == "hot" and one["embedding"]["active"] and one["cache_hit"] is None
    assert two["abstained"] and two["abstain_reason"] == "no-trusted-candidate" and two["query_class"] == ["natural"] and two["channels"] == {"exact": 0, "bm25f": 0}
    assert two["total_ms"] == 0 and two["stage_ms"] == {"load": 0, "plan": 0, "rank": 0, "context": 0} and "embedding" not in two and not two["consumption_eligible"]
    assert three["returned_topics"] == [f"t{i}" for i in range(20)] and three["dropped_topics"] == 0 and three["abstain_reason"] is None
    assert [got[i]["process"]["component"] for i in (1, 2, 3)] == ["memory-recall-previous", "memory-recall-fallback", "memory-recall-snapshot"]
    assert {r.trace_id for r in out.collect()} == {g["trace_id"] for g in got.values()} and len({g["trace_id"] for g in got.values()}) == 3


def test_deliveries_consumptions_and_builds(spark, log):
    trace = spark.range(1).select(producers.trace_id(F.lit("x"))).first()[0]
    rows = spark.createDataFrame([(trace, None, ["b", "a", "b"], None, None), (trace, "s", [], "cli", "session"), (None, "s", ["a"], "cli", None), (trace, "s", None, None, None), (trace, "s", ["a"], "cli", "session")], "trace_id string, snapshot_id string, topics array<string>, via string, match string")
    shown, opened = producers.deliveries(log, rows), producers.consumptions(log, rows)
    assert all(r.v == [] for r in faults(shown, "recall.delivered").collect()) and all(r.v == [] for r in faults(opened, "recall.consumed").collect())
    assert [json.loads(r.value)["payload"] for r in shown.collect()] == [{"surface": "claude-hook", "topics": ["b", "a"]}, {"surface": "claude-hook", "topics": ["a"]}]
    assert [tuple(json.loads(r.value)["payload"].values()) for r in opened.collect()] == [(["b", "a"], None, "claude-hook", "recent"), (["a"], None, "cli", "session")]
    made = [(1, "s", "incremental", 1, 2, 3, 4, 99, 5.0, None, False), (2, None, None, None, -1, 0, 0, None, -5.0, "enoent", None), (3, "s", "full", 1, 1, 0, 0, 9, 1.0, "what happened?", True), (4, "s", "full", 1, 1, 0, 0, 9, 1.0, None, True)]
    out = producers.builds(log, spark.createDataFrame(made, "build_id int, snapshot_id string, mode string, changed int, compiled int, reused int, deleted int, bytes int, duration_ms double, error string, previous_used boolean"))
    assert all(r.v == [] for r in faults(out, "index.build").collect())
    got = {r.build_id: json.loads(r.value)["payload"] for r in out.collect()}
    assert [(got[i]["mode"], got[i]["success"], got[i]["fallback"], got[i]["error_code"]) for i in (1, 2, 3, 4)] == [("incremental", True, False, None), ("full", False, True, "ENOENT"), ("full", False, True, "REBUILD_FAILED"), ("full", True, True, None)]


def test_append_keeps_broken_lines_out(spark, log, tmp_path):
    trace = spark.range(1).select(producers.trace_id(F.lit("x"))).first()[0]
    rows = spark.createDataFrame([(trace, None, ["a"]), ("no-uuid", None, ["a"]), (trace, None, ["Not A Name"])], "trace_id string, snapshot_id string, topics array<string>")
    values = producers.deliveries(log, rows).select("value").union(spark.createDataFrame([("{",), (None,)], "value string"))
    folder = str(tmp_path / "log")
    bad = producers.append(values, folder, "events/v1", ("recall.delivered",))
    assert sorted(",".join(r.violations) for r in bad.collect()) == ["$ json", "$ json", "$.payload.topics[] pattern", "$.trace_id pattern"]
    assert producers.append(values.limit(1), folder, "events/v1", ("recall.delivered",)).count() == 0
    assert [p.name for p in (tmp_path / "log").iterdir() if p.is_dir()] == ["day=2026-01-02"]
    events, errors = logs.read_events(spark, f"{folder}/*")
    assert events.count() == 2 and errors.count() == 0
