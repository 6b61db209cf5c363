"""Inboxes of JSON lines: feedback, backfill and resolution receipts, usage; and what is appended to them.

Input is (line, value) as sources/logs.lines gives it. Each reader returns every line with a reason where it is rejected
(the first that applies), so good and bad lines come from one pass. Types are told by variants, which keep a missing key
apart from a null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts; keys of a backfill receipt; what digests and times look like.
VERDICTS = ("correct", "wrong", "miss")
BACKFILL_KEYS = ("feedback_line", "feedback_recorded_at", "query_sha256", "recorded_at", "schema", "target", "trigger")
SHA256 = "^[a-f0-9]{64}$"
TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z$"
FEEDBACK_SCHEMAS, BACKFILL_SCHEMAS, RESOLUTION_SCHEMAS, USAGE_SCHEMAS = ("recall-feedback/v1",), ("trigger-backfill-receipt/v1",), ("miss-resolution-receipt/v1",), ("recall-usage/v1",)


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.filter(F.trim("value") != "").withColumn("_v", F.try_parse_json("value"))


def _text(key: str) -> Column:
    """The string at a key; null if it is missing or of another type."""
    return F.when(_kind(key) == "STRING", F.try_variant_get("_v", f"$.{key}", "string"))


def _kind(key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("_v", f"$.{key}", "variant"))


def _filled(key: str) -> Column:
    return F.coalesce(F.trim(_text(key)) != "", F.lit(False))


def _is_strings(key: str) -> Column:
    return F.coalesce(_kind(key).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))


def _reasons(*checks: tuple[str, Column]) -> Column:
    """The first code whose condition does not hold."""
    out = F.lit(None).cast("string")
    for code, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def feedback_inbox(lines: DataFrame, active: DataFrame | None = None, schemas: Sequence[str] = FEEDBACK_SCHEMAS) -> DataFrame:
    """(line, query, verdict, expected, returned, reject_reason, duplicate). `active` (name): topics that may be expected; none
    given or an empty table allows all. Of equal query, verdict and expected all but the first are duplicates, and kept."""
    rows = _parsed(lines)
    expected = F.nullif(_text("expected"), F.lit(""))
    checks = [("invalid-json", F.col("_v").isNotNull()), ("unsupported-schema", _text("schema").isin(*schemas)), ("invalid-verdict", _text("verdict").isin(*VERDICTS)), ("empty-query", _filled("query")), ("invalid-returned", _is_strings("returned")), ("missing-expected", (_text("verdict") == "correct") | expected.isNotNull())]
    rows = rows.select("line", _text("query").alias("query"), _text("verdict").alias("verdict"), expected.alias("expected"), F.try_variant_get("_v", "$.returned", "array<string>").alias("returned"), _reasons(*checks).alias("reject_reason"))
    if active is not None:
        any_ = active.agg((F.count(F.lit(1)) > 0).alias("_any"))  # one row
        rows = rows.join(active.select(F.col("name").alias("expected"), F.lit(True).alias("_known")).distinct(), "expected", "left").crossJoin(any_)
        gone = F.col("reject_reason").isNull() & F.col("expected").isNotNull() & F.col("_any") & F.col("_known").isNull()
        rows = rows.withColumn("reject_reason", F.when(gone, "inactive-expected").otherwise(F.col("reject_reason"))).drop("_known", "_any")
    order = Window.partitionBy("query", "verdict", "expected", F.col("reject_reason").isNull()).orderBy("line")
    return rows.withColumn("duplicate", F.col("reject_reason").isNull() & (F.row_number().over(order) > 1)).select("line", "query", "verdict", "expected", "returned", "reject_reason", "duplicate")


def backfill_receipts(lines: DataFrame, schemas: Sequence[str] = BACKFILL_SCHEMAS) -> DataFrame:
    """(line, feedback_line, target, trigger, query_sha256, reject_reason): exactly the known keys; one receipt a feedback
    line, the first good one."""
    rows = _parsed(lines)
    number = F.try_variant_get("_v", "$.feedback_line", "bigint")
    checks = [("invalid-json", F.col("_v").isNotNull()), ("unsupported-schema", _text("schema").isin(*schemas)), ("wrong-keys", F.array_sort(F.json_object_keys("value")) == F.array(*map(F.lit, BACKFILL_KEYS))), ("invalid-line", (_kind("feedback_line") == "BIGINT") & (number >= 1)), ("invalid-fields", _text("recorded_at").rlike(TIME) & _text("feedback_recorded_at").rlike(TIME) & (_text("target") != "") & (_text("trigger") != "") & _text("query_sha256").rlike(SHA256))]
    rows = rows.select("line", number.alias("feedback_line"), _text("target").alias("target"), _text("trigger").alias("trigger"), _text("query_sha256").alias("query_sha256"), _reasons(*checks).alias("reject_reason"))
    order = Window.partitionBy("feedback_line", F.col("reject_reason").isNull()).orderBy("line")
    again = F.col("reject_reason").isNull() & (F.row_number().over(order) > 1)
    return rows.withColumn("reject_reason", F.when(again, "duplicate-receipt").otherwise(F.col("reject_reason")))


def resolution_receipts(lines: DataFrame, schemas: Sequence[str] = RESOLUTION_SCHEMAS) -> DataFrame:
    """(line, feedback_line, reject_reason)."""
    checks = [("invalid-json", F.col("_v").isNotNull()), ("unexpected-schema", _text("schema").isin(*schemas))]
    return _parsed(lines).select("line", F.try_variant_get("_v", "$.feedback_line", "bigint").alias("feedback_line"), _reasons(*checks).alias("reject_reason"))


def usage_lines(lines: DataFrame, schemas: Sequence[str] = USAGE_SCHEMAS) -> DataFrame:
    """(line, abstained, hits, valid): a usage line holds the query's digest and never the query, and abstains exactly where
    nothing was returned."""
    kind = "array<struct<name:string,score:double>>"
    found = F.try_variant_get("_v", "$.returned", kind)
    is_list = F.startswith(_kind("returned"), F.lit("ARRAY"))
    good = F.coalesce(F.forall(found, lambda x: F.coalesce(F.length(x["name"]) > 0, F.lit(False)) & x["score"].isNotNull()), F.lit(False))
    abstained = F.when(_kind("abstained") == "BOOLEAN", F.try_variant_get("_v", "$.abstained", "boolean"))
    no_query = ~F.array_contains(F.json_object_keys("value"), "query")
    valid = _text("schema").isin(*schemas) & F.try_to_timestamp(_text("recordedAt")).isNotNull() & _text("query_sha256").rlike(SHA256) & abstained.isNotNull() & is_list & good & (abstained == (F.size(found) == 0)) & no_query
    return _parsed(lines).select("line", abstained.alias("abstained"), F.size(found).alias("hits"), F.coalesce(valid, F.lit(False)).alias("valid"))


def usage_summary(checked: DataFrame) -> DataFrame:
    """One row: total, abstained, with_hits, invalid and the abstain rate (0 over nothing, as the log's readers expect)."""
    ok = F.col("valid")
    n, k = F.count_if(ok), F.count_if(ok & F.col("abstained"))
    return checked.agg(n.alias("total"), k.alias("abstained"), F.count_if(ok & ~F.col("abstained")).alias("with_hits"), F.count_if(~ok).alias("invalid"), F.coalesce(F.round(k / F.nullif(n, F.lit(0)), 6), F.lit(0.0)).alias("abstain_rate"))


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns)).alias("value")


def feedback_line(rows: DataFrame, at: Column, schema: str = FEEDBACK_SCHEMAS[0]) -> DataFrame:
    """(value) of feedback (query, verdict, expected, returned) to append."""
    time = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("recordedAt")
    return rows.select(_json(F.lit(schema).alias("schema"), time, "query", "verdict", "expected", "returned"))


def usage_line(rows: DataFrame, at: Column, schema: str = USAGE_SCHEMAS[0]) -> DataFrame:
    """(value) of recalls (query, returned: name and score) to append; the query leaves only its digest."""
    time = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("recordedAt")
    return rows.select(_json(F.lit(schema).alias("schema"), time, F.sha2("query", 256).alias("query_sha256"), (F.size("returned") == 0).alias("abstained"), "returned"))


def append_lines(values: DataFrame, folder: str) -> None:
    """Append lines (value) to a folder of text files."""
    values.select("value").write.mode("append").text(folder)


def remembered(recalls: DataFrame, at: Column, most: int = 20) -> DataFrame:
    """Ledger rows of recalls (trace_id, session_id, snapshot_id, returned, source): distinct topics, at most `most`, those
    with none left out."""
    topics = F.slice(F.filter(F.array_distinct("returned"), lambda t: t != ""), 1, most)
    rows = recalls.select(at.alias("recorded_at"), "trace_id", "session_id", "snapshot_id", topics.alias("topics"), F.when(F.col("source") == "claude-hook", F.col("source")).otherwise("cli").alias("source"))
    return rows.filter(F.size("topics") > 0)


def pruned(ledger: DataFrame, fresh: DataFrame, cap: int = 256 * 1024) -> DataFrame:
    """The ledger as it is while its lines take at most `cap` bytes, else its fresh rows (sources/logs.fresh) alone."""
    size = ledger.agg((F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*ledger.columns))) + 1), F.lit(0)) > cap).alias("_over"))  # one row
    keys = [c for c in ledger.columns if c != "topics"]
    kept = fresh.select(*keys, "topics").withColumn("_fresh", F.lit(True))
    rows = ledger.withColumn("_fresh", F.lit(False)).unionByName(kept).crossJoin(size)
    return rows.filter(F.col("_fresh") == F.col("_over")).drop("_fresh", "_over")


def upgraded_postings(nested: DataFrame) -> DataFrame:
    """Postings of the first format (term, postings: document_id and fields with frequencies) in the current long form."""
    each = nested.select("term", F.explode("postings").alias("p")).select("term", F.col("p.document_id").alias("doc_id"), F.explode("p.fields").alias("f"))
    rows = each.select("term", "doc_id", F.col("f.field").alias("field"), F.col("f.frequency").cast("long").alias("tf"))
    lengths = rows.groupBy("doc_id", "field").agg(F.sum("tf").alias("len"))
    return rows.join(lengths, ["doc_id", "field"]).select("term", "doc_id", "field", "len", "tf")
