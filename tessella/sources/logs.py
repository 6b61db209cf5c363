"""Append-only logs: event days, feedback inbox, ledger; and vectors in base64."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "schema string, event string, recorded_at timestamp, trace_id string, snapshot_id string, payload string"
#: Event types, and what a trace id looks like.
EVENTS = ("recall.completed", "recall.delivered", "recall.consumed", "feedback.recorded", "index.build", "maintenance.completed", "gate.completed")
UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines: file, line (from 1), value (without a carriage return at its end). Empty lines count but are left
    out.

    A file is read in splits by as many tasks as its size asks for. Each split numbers its own lines, in the order of the
    rows it reads, and what the earlier splits of the file hold is added: one row a split meets in the prefix sum."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value")
    splits = rows.groupBy("p", "at").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("p").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("p", "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # Within a split the ids rise by one a line, whatever else its task reads.
    first = rows.groupBy("p", "at").agg(F.min("i").alias("first"))
    return rows.join(before.join(first, ["p", "at"]), ["p", "at"]).filter("value not in ('', '\\r')").select("file", (F.col("before") + F.col("i") - F.col("first") + 1).alias("line"), F.regexp_replace("value", "\\r$", "").alias("value"))


def read_events(spark: SparkSession, path: str, since: Column | None = None, until: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of JSON lines. The window includes both ends; errors name file, line and reason."""
    parsed = lines(spark, path).withColumn("e", F.from_json("value", EVENT, {"mode": "PERMISSIVE"})).withColumn("keys", F.expr("json_object_keys(get_json_object(value, '$.payload'))"))
    e = F.col("e")
    bad = F.when(e["event"].isNull(), "not-json").when(~e["event"].isin(*EVENTS), "unknown-event").when(e["recorded_at"].isNull(), "invalid-time").when(~F.coalesce(e["trace_id"].rlike(UUID4), F.lit(False)), "invalid-trace")
    checked = parsed.withColumn("reason", bad)
    good = checked.filter("reason is null").select("file", "line", "e.*", F.col("keys").alias("payload_keys"))
    if since is not None:
        good = good.filter(F.col("recorded_at") >= since)
    if until is not None:
        good = good.filter(F.col("recorded_at") <= until)
    return good, checked.filter("reason is not null").select("file", "line", "reason")


def append_events(events: DataFrame, path: str) -> None:
    """Append as Parquet, one folder per UTC day."""
    events.withColumn("day", F.to_date("recorded_at")).write.mode("append").partitionBy("day").parquet(path)


def expired_days(days: DataFrame, as_of: Column, keep_days: int = 30, cap: int = 20 * 1024 * 1024) -> DataFrame:
    """Retention over (day, bytes): the days to drop - older than keep_days, or beyond the newest `cap` bytes. A log has
    one row per day here, so one window over all of them is small."""
    running = F.sum("bytes").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("running", running).filter((F.col("day") < F.date_sub(as_of, keep_days)) | (F.col("running") > cap)).select("day")


def fresh(ledger: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """Ledger rows within their time to live, with a valid trace and at least one topic."""
    return ledger.filter((F.col("recorded_at") >= now - F.make_dt_interval(hours=F.lit(hours))) & F.col("trace_id").rlike(UUID4) & (F.size("topics") > 0))


def encode_vector(vector: Column) -> Column:
    """float32 little-endian in base64."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def run(values):
        import base64

        import numpy as np

        return values.map(lambda v: base64.b64encode(np.asarray(v, dtype="<f4").tobytes()).decode(), na_action="ignore")

    return run(vector)


def decode_vector(text: Column, dimensions: int) -> Column:
    """The vector of canonical base64 with finite values of that many dimensions; null otherwise."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("array<float>")
    def run(values):
        import base64
        import binascii

        import numpy as np

        def one(v):
            try:
                raw = base64.b64decode(v, validate=True)
            except (binascii.Error, ValueError):
                return None
            if len(raw) != 4 * dimensions or base64.b64encode(raw).decode() != v:
                return None
            x = np.frombuffer(raw, "<f4")
            return x if np.isfinite(x).all() else None

        return values.map(one, na_action="ignore")

    return run(text)


def query_id(key: str, query: Column) -> Column:
    """HMAC-SHA256(key, query) in hex, composed from sha2 so that it stays in the JVM."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    lit = lambda b: F.unhex(F.lit(b.hex()))
    return F.sha2(F.concat(lit(outer), F.unhex(F.sha2(F.concat(lit(inner), F.encode(query, "UTF-8")), 256))), 256)
