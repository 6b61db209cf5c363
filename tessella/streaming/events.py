"""Streams over the event log: appended days, windows, pairing with a time to live, and session state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_days(stream: DataFrame, at: str, path: str, checkpoint: str):
    """Exactly-once append of a stream as Parquet, one folder per day."""
    return stream.withColumn("day", F.to_date(at)).writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, width: str, slide: str | None, late: str, *keys: str) -> DataFrame:
    """Counts per tumbling or sliding window; rows later than the watermark are dropped."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def session_counts(stream: DataFrame, at: str, gap: str, late: str, key: str) -> DataFrame:
    """Counts per session window of a key."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def paired(opens: DataFrame, recalls: DataFrame, hours: int = 2) -> DataFrame:
    """Stream-stream join: an open (open_id, at, topic) with every recall (recall_id, at, topic) of the last `hours`.
    Watermarks on both sides let Spark drop state that no later row can meet."""
    a = opens.select("open_id", F.col("at").alias("open_at"), F.col("topic").alias("open_topic")).withWatermark("open_at", f"{hours} hours")
    b = recalls.select("recall_id", F.col("at").alias("recall_at"), "topic").withWatermark("recall_at", f"{hours} hours")
    return a.join(b, F.expr(f"open_topic = topic and recall_at <= open_at and recall_at >= open_at - interval {hours} hours")).select("open_id", "recall_id", "topic", "open_at", "recall_at")


def settled(opens: DataFrame, recalls: DataFrame, hours: int = 2, late: str = "10 minutes") -> DataFrame:
    """Outer stream-stream join: every open (open_id, at, topic) with each recall (recall_id, at, topic) of the last
    `hours`, or with null once none can come any more: an orphan. Rows later than `late` are dropped on both sides.

    An open is kept until the watermark has passed it, a recall for `hours` longer; Spark emits the orphan when it drops
    the open's state."""
    a = opens.select("open_id", F.col("at").alias("open_at"), F.col("topic").alias("open_topic")).withWatermark("open_at", late)
    b = recalls.select("recall_id", F.col("at").alias("recall_at"), "topic").withWatermark("recall_at", late)
    met = a.join(b, F.expr(f"open_topic = topic and recall_at <= open_at and recall_at >= open_at - interval {hours} hours"), "left_outer")
    return met.select("open_id", "open_at", F.col("open_topic").alias("topic"), "recall_id", "recall_at")


#: Sessions that a coordinator remembers, and topics that a session remembers.
MOST_SESSIONS, MOST_SEEN = 128, 64
ANSWERED = "coordinator string, session string, request_id string, delivered array<string>, deduplicated boolean"


def remembered(sessions: dict, request, most_sessions: int, most_seen: int) -> tuple[list[str], bool, list[str]]:
    """(delivered topics, whether some were left out, sessions to forget) of one answered request; `sessions` maps a
    session to (snapshot, touched, topics seen, oldest first) and is updated."""
    snapshot, _, seen = sessions.get(request.session, (None, 0, []))
    seen = list(seen) if snapshot in (None, request.snapshot) else []  # another snapshot: all may be told again
    fresh = [t for t in request.topics if t not in seen]
    sessions[request.session] = (request.snapshot, request.touched, (seen + fresh)[-most_seen:])
    gone = []
    while len(sessions) > most_sessions:
        oldest = min((s for s in sessions if s != request.session), key=lambda s: (sessions[s][1], s))
        gone.append(oldest)
        del sessions[oldest]
    return fresh, len(fresh) < len(request.topics), gone


def resident_sessions(answers: DataFrame, idle: str = "30 minutes", late: str = "10 minutes", most_sessions: int = MOST_SESSIONS, most_seen: int = MOST_SEEN) -> DataFrame:
    """Answers (coordinator, session, request_id, snapshot, at, topics: array, best first) of a stream, without the topics
    that their session has been given: coordinator, session, request_id, delivered, deduplicated.

    Each coordinator remembers its `most_sessions` latest sessions, and each of these its `most_seen` latest topics. A
    session starts afresh when its snapshot changes, and when it has been idle (in event time, by a timer). Requests of a
    micro-batch are taken in order of time and id. Needs the RocksDB state store."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    names = [c.strip().split(" ")[0] for c in ANSWERED.split(",")]
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    class Sessions(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.known = handle.getMapState("sessions", "session string", "snapshot string, touched long, seen array<string>")

        def handleInputRows(self, key, rows, timerValues):
            pdf = pd.concat(list(rows))
            pdf["touched"] = pdf["at"].astype("datetime64[ms]").astype("int64")
            held = {k[0]: (v[0], v[1], list(v[2])) for k, v in self.known.iterator()}
            before = set(held)
            out, touched = [], set()
            for r in pdf.sort_values(["touched", "request_id"]).itertuples():
                old = held.get(r.session)
                if old and r.touched - old[1] > wait:
                    del held[r.session]
                fresh, left_out, gone = remembered(held, r, most_sessions, most_seen)
                touched = (touched | {r.session}) - set(gone)
                out.append((key[0], r.session, r.request_id, fresh, left_out))
            for s in touched:
                self.known.updateValue((s,), held[s])
                self.handle.registerTimer(int(held[s][1]) + wait + 1)
            for s in before - set(held):
                self.known.removeKey((s,))
            yield pd.DataFrame(out, columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            due = expiredTimerInfo.getExpiryTimeInMs()
            for k, v in list(self.known.iterator()):
                if v[1] + wait < due:
                    self.known.removeKey(k)
            yield pd.DataFrame([], columns=names)

        def close(self) -> None:
            pass

    rows = answers.withWatermark("at", late).groupBy("coordinator")
    return rows.transformWithStateInPandas(Sessions(), ANSWERED, "Append", "EventTime")


def session_dedup(stream: DataFrame, session: str, epoch: str, topic: str, most_topics: int = 64) -> DataFrame:
    """Rows whose topic is new to their session; a new epoch resets it, the newest `most_topics` are remembered.

    (session, epoch, topic: strings.) State is one row per session; idle sessions end after five minutes of processing
    time."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, seen = state.get if state.exists else ("", [])
        seen = list(seen)
        for pdf in batches:
            fresh = []
            for e, t in zip(pdf[epoch], pdf[topic], strict=True):
                if e != now:
                    now, seen = e, []
                fresh.append(t not in seen)
                if t in seen:
                    seen.remove(t)
                seen.append(t)
                seen = seen[-most_topics:]
            yield pdf.loc[fresh]
        state.update((now, seen))
        state.setTimeoutDuration(5 * 60 * 1000)

    return stream.groupBy(session).applyInPandasWithState(step, stream.schema, "epoch string, seen array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def answer_requests(stream: DataFrame, tables_of, answered: str, checkpoint: str, most_bytes: int = 64 * 1024):
    """Answer a stream of requests (query_id, query) micro-batch by micro-batch, and append the answers as Parquet.

    `tables_of()` opens the snapshot anew for every batch, so a newly published one is taken up without a restart. Requests
    beyond `most_bytes` are left out, as the protocol has it. Batches are ranked as one; a batch that is tried again
    overwrites its own folder, so answers are exactly once."""
    from tessella.operators import ranker

    def answer(batch: DataFrame, number: int) -> None:
        ok = batch.filter(F.octet_length("query") <= most_bytes)
        rows = ranker.answer(ok, tables_of())[0].select("query_id", "doc_id", "position", "score", "confidence")
        rows.write.mode("overwrite").parquet(f"{answered}/batch={number}")

    return stream.select("query_id", "query").writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
