from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import report
from tessella.streaming import events as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The events in order of time, in five files."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(5):
        rows.filter((F.dayofmonth("ts") - 1) % 30 >= 6 * i).filter(F.dayofmonth("ts") - 1 < 6 * i + 6).coalesce(1).write.mode("append").parquet(path)
    return path, rows


def run(df, mode, spark, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.sql(f"select * from {name}").collect()


def test_windows_equal_batch(spark, source, tmp_path):
    path, rows = source
    s = stream.read_stream(spark, path, rows.schema)
    got = {(r.start, r.event_type): r.n for r in run(stream.windowed_counts(s, "ts", "1 day", None, "1 hour", "event_type"), "complete", spark, "tumbling", tmp_path)}
    want = {(r.start, r.event_type): r.n for r in report.tumbling(rows, "ts", "1 day", "event_type").collect()}
    assert got == want
    got = {(r.start, r.n) for r in run(stream.windowed_counts(s, "ts", "6 hours", "2 hours", "1 hour"), "complete", spark, "sliding", tmp_path)}
    assert got == {(r.start, r.n) for r in report.sliding(rows, "ts", "6 hours", "2 hours").collect()}


def test_append_is_exactly_once(spark, source, tmp_path):
    path, rows = source
    for _ in range(2):
        stream.append_days(stream.read_stream(spark, path, rows.schema), "ts", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_session_dedup_equals_batch(spark, source, tmp_path):
    path, rows = source
    named = lambda df: df.select("event_id", F.col("user_id").cast("string").alias("session"), F.lit("e1").alias("epoch"), F.col("event_type").alias("topic"))
    got = run(stream.session_dedup(named(stream.read_stream(spark, path, rows.schema)), "session", "epoch", "topic"), "append", spark, "dedup", tmp_path)
    want = defaultdict(set)
    for r in named(rows).collect():
        want[r.session].add(r.topic)
    assert len(got) == sum(map(len, want.values())) and {(r.session, r.topic) for r in got} == {(s, t) for s, ts in want.items() for t in ts}


def test_pairing_equals_batch(spark, source, tmp_path):
    path, rows = source
    part = lambda df, kind, name: df.filter(F.col("event_type") == kind).select(F.col("event_id").alias(name), F.col("ts").alias("at"), (F.col("user_id") % 5).cast("string").alias("topic"))
    s = lambda: stream.read_stream(spark, path, rows.schema, 10)
    got = {(r.open_id, r.recall_id) for r in run(stream.paired(part(s(), "purchase", "open_id"), part(s(), "view", "recall_id")), "append", spark, "paired", tmp_path)}
    a, b = part(rows, "purchase", "open_id").withColumnRenamed("at", "x"), part(rows, "view", "recall_id").withColumnRenamed("at", "y")
    want = {(r.open_id, r.recall_id) for r in a.join(b, "topic").filter("y <= x and y >= x - interval 2 hours").collect()}
    assert got == want and want


def test_orphans_equal_batch(spark, source, tmp_path):
    path, rows = source
    part = lambda df, kind, name: df.filter(F.col("event_type") == kind).select(F.col("event_id").alias(name), F.col("ts").alias("at"), (F.col("user_id") % 5).cast("string").alias("topic"))
    s = lambda: stream.read_stream(spark, path, rows.schema, 1)
    got = run(stream.settled(part(s(), "purchase", "open_id"), part(s(), "view", "recall_id"), late="1 day"), "append", spark, "settled", tmp_path)
    a, b = part(rows, "purchase", "open_id").withColumnRenamed("at", "x"), part(rows, "view", "recall_id").withColumnRenamed("at", "y")
    pairs = {(r.open_id, r.recall_id) for r in a.join(b, "topic").filter("y <= x and y >= x - interval 2 hours").collect()}
    assert {(r.open_id, r.recall_id) for r in got if r.recall_id is not None} == pairs
    end = min(a.agg(F.max("x")).first()[0], b.agg(F.max("y")).first()[0])
    lone = {r.open_id: r.x for r in a.collect() if r.open_id not in {o for o, _ in pairs}}
    found = {r.open_id for r in got if r.recall_id is None}
    assert found <= set(lone) and found >= {o for o, t in lone.items() if (end - t).total_seconds() > 86_400 + 60} and found


def answers(rows, spark, path):
    """Requests of 40 users to two coordinators; the snapshot is swapped in the middle of the month."""
    day = F.dayofmonth("ts")
    topic = lambda i: F.concat(F.lit("t"), ((F.col("event_id") * (i + 3)) % 11).cast("string"))
    out = rows.filter("user_id % 50 < 40").select((F.col("user_id") % 2).cast("string").alias("coordinator"), F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("session"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("request_id"), F.when(day <= 15, "v1").otherwise("v2").alias("snapshot"), F.col("ts").alias("at"), F.array_distinct(F.array(*[topic(i) for i in range(3)])).alias("topics"))
    for i in range(5):
        out.filter((F.dayofmonth("at") - 1) % 30 >= 6 * i).filter(F.dayofmonth("at") - 1 < 6 * i + 6).coalesce(1).write.mode("append").parquet(path)
    return out


def test_resident_sessions_equal_a_loop_over_a_snapshot_swap(spark, source, tmp_path):
    _, rows = source
    path = str(tmp_path / "answers")
    batch = answers(rows, spark, path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = stream.read_stream(spark, path, batch.schema, 1)
        got = {r.request_id: (list(r.delivered), r.deduplicated) for r in run(stream.resident_sessions(s, "2 days", "1 day", 6, 5), "append", spark, "resident", tmp_path)}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want, sessions = {}, {}
    for r in sorted(batch.collect(), key=lambda r: (r["at"], r.request_id)):
        mine = sessions.setdefault(r.coordinator, {})
        now = r["at"].timestamp()
        old = mine.pop(r.session, None)
        seen = old[2] if old and old[0] == r.snapshot and now - old[1] <= 2 * 86_400 else []
        fresh = [t for t in r.topics if t not in seen]
        mine[r.session] = (r.snapshot, now, (seen + fresh)[-5:])
        if len(mine) > 6:
            del mine[min((k for k in mine if k != r.session), key=lambda k: (mine[k][1], k))]
        want[r.request_id] = (fresh, len(fresh) < len(r.topics))
    assert got == want and any(d for _, d in want.values()) and len(want) > 100
