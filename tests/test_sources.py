import base64
import hashlib
import hmac
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import logs, snapshots, topics

TOPIC = """---
name: port_choice
description: "Why: 8080"
metadata:
  type: lesson
  authority: observed
  triggers:
    - which port
    - 'it''s taken'
  scopes: [net, "a,b"]
  review_by: null
---
Body — ünï

second paragraph
"""


def test_topics(spark, tmp_path):
    (tmp_path / "archive/2024-01-01").mkdir(parents=True)
    (tmp_path / "port_choice.md").write_text(TOPIC)
    (tmp_path / "archive/2024-01-01/old.md").write_text(TOPIC.replace("\n", "\r\n"))
    (tmp_path / "MEMORY-net.md").write_text("# Net\n- [Port](port_choice.md) — use 8080\n- not a hook\n  - [Old](sub/old.md) gone\n")
    (tmp_path / "bad.md").write_text("---\nname: a\nname: b\n---\n")
    (tmp_path / "none.md").write_text("no front matter")
    files = topics.scan(spark, str(tmp_path))
    kinds = {r.file: (r.kind, r.active) for r in files.collect()}
    assert kinds["MEMORY-net.md"] == ("l2", True) and kinds["old.md"] == ("topic", False)
    got = {r.file: r for r in topics.parse_topics(files.filter("kind = 'topic'")).collect()}
    rec = got["port_choice.md"].record
    assert (rec.name, rec.description, rec.type, rec.triggers, rec.scopes, rec.review_by) == ("port_choice", "Why: 8080", "lesson", ["which port", "it's taken"], ["net", "a,b"], None)
    assert got["old.md"].record == rec and got["old.md"].body == got["port_choice.md"].body
    assert got["bad.md"].error.startswith("yaml-parse: duplicate") and got["none.md"].error == "frontmatter-delimiter"
    found = [(r.line, r.label, r.name, r.summary) for r in topics.hooks(files.filter("kind = 'l2'")).orderBy("line").collect()]
    assert found == [(2, "Port", "port_choice", "use 8080"), (4, "Old", "old", "gone")]
    parts = topics.chunks(spark.createDataFrame([(1, "Body — ünï\n\n\nsecond\n\n")], "id int, body string"), "id", "body").orderBy("pos").collect()
    raw = "Body — ünï\n\n\nsecond\n\n".encode()
    assert [raw[p.start_byte : p.end_byte].decode() for p in parts] == ["Body — ünï", "second"]
    one, again = (topics.manifest_digest(f).first()[0] for f in (files, files.repartition(3)))
    assert one == again and len(one) == 64


@pytest.mark.parametrize("text", ["a: [1", "a: &x 1", "- x", "a:\n  b: 1\n c: 2\nd", "a: 'x"])
def test_strict_yaml(text):
    with pytest.raises(ValueError):
        topics.parse_yaml(text)


def test_events(spark, tmp_path):
    trace = "123e4567-e89b-42d3-a456-426614174000"
    rows = [{"event": "recall.completed", "recorded_at": f"2024-01-0{d}T00:00:00.000Z", "trace_id": trace, "payload": {"abstain_reason": None, "surface": "cli"}} for d in (1, 2, 3)]
    bad = ["{", json.dumps(rows[0] | {"event": "x"}), json.dumps(rows[0] | {"trace_id": "no"}), json.dumps(rows[0] | {"recorded_at": "soon"})]
    (tmp_path / "events-2024-01-01.jsonl").write_text("\n".join([*map(json.dumps, rows), *bad]) + "\n")
    good, errors = logs.read_events(spark, str(tmp_path), F.to_timestamp(F.lit("2024-01-02 00:00:00")), F.to_timestamp(F.lit("2024-01-03 00:00:00")))
    assert sorted(r.line for r in good.collect()) == [2, 3]
    assert all("abstain_reason" in r.payload_keys for r in good.collect())
    assert sorted((r.line, r.reason) for r in errors.collect()) == [(4, "not-json"), (5, "unknown-event"), (6, "invalid-trace"), (7, "invalid-time")]
    logs.append_events(good, str(tmp_path / "out"))
    assert sorted(str(r.day) for r in spark.read.parquet(str(tmp_path / "out")).select("day").distinct().collect()) == ["2024-01-02", "2024-01-03"]


def test_retention_and_ledger(spark):
    days = spark.createDataFrame([(f"2024-02-{d:02d}", 10) for d in range(1, 21)], "d string, bytes long").select(F.to_date("d").alias("day"), "bytes")
    gone = sorted(str(r.day) for r in logs.expired_days(days, F.to_date(F.lit("2024-03-10")), 30, 105).collect())
    assert gone == [f"2024-02-{d:02d}" for d in range(1, 11)]
    trace = "123e4567-e89b-42d3-a456-426614174000"
    ledger = spark.createDataFrame([("2024-01-01 10:00:00", trace, ["a"]), ("2024-01-01 08:59:59", trace, ["a"]), ("2024-01-01 10:00:00", "x", ["a"]), ("2024-01-01 10:00:00", trace, [])], "t string, trace_id string, topics array<string>").withColumn("recorded_at", F.to_timestamp("t"))
    assert logs.fresh(ledger, F.to_timestamp(F.lit("2024-01-01 11:00:00"))).count() == 1


def test_vectors_and_query_ids(spark):
    v = [1.5, -2.0, 0.25]
    text = base64.b64encode(np.array(v, "<f4").tobytes()).decode()
    nan = base64.b64encode(np.array([np.nan, 1, 2], "<f4").tobytes()).decode()
    df = spark.createDataFrame([(1, text), (2, "###"), (3, None), (4, nan), (5, text[:8])], "i int, t string")
    got = {r.i: r.v for r in df.select("i", logs.decode_vector(F.col("t"), 3).alias("v")).collect()}
    assert got == {1: v, 2: None, 3: None, 4: None, 5: None}
    back = spark.createDataFrame([(v,)], "v array<float>").select(logs.encode_vector(F.col("v")).alias("t")).first().t
    assert back == text
    for key in ("k", "long" * 40):
        mine = spark.createDataFrame([("qüery",)], "q string").select(logs.query_id(key, F.col("q"))).first()[0]
        assert mine == hmac.new(key.encode(), "qüery".encode(), hashlib.sha256).hexdigest()


def test_snapshots(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path))
    a = spark.range(10).withColumn("x", F.lit(None).cast("string"))
    first = store.publish({"t": a})
    assert store.publish({"t": a.repartition(3)}) == first
    second = store.publish({"t": spark.range(11).withColumn("x", F.lit("y"))})
    third = store.publish({"t": spark.range(12).withColumn("x", F.lit("y"))})
    where, tables = store.read()
    assert where == "current" and tables["t"].count() == 12 and len({first, second, third}) == 3
    assert store.collect_garbage() == [first]
    spark.range(5).withColumn("x", F.lit("z")).write.mode("overwrite").parquet(str(tmp_path / "snapshots" / third / "t"))
    where, tables = store.read()
    assert where == "previous" and tables["t"].count() == 11


def test_physical_lines_of_files_in_many_splits(spark, tmp_path):
    """Numbers equal a plain read, whatever the splits: empty lines, carriage returns, long lines, no last line break."""
    from tessella.sources import logs

    files = {"a.jsonl": "x\n\ny\r\n" + "".join(f"line {i} {'z' * (i % 97)}\n" + "\n" * (i % 13 == 0) for i in range(4000)), "b.jsonl": "one\ntwo", "c.jsonl": "", "d.jsonl": "\n\n\r\nlast\n", "e.jsonl": "q" * 30_000 + "\nend\n"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    want = {(n, i + 1, v.removesuffix("\r")) for n, t in files.items() for i, v in enumerate(t.split("\n")) if v not in ("", "\r")}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = logs.lines(spark, str(tmp_path))
        got = [(r.file, r.line, r.value) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(got) == len(want) and set(got) == want
    assert {(r.file, r.line, r.value) for r in logs.lines(spark, str(tmp_path)).collect()} == want
