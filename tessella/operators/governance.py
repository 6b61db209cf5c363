"""Audit rules, routing, quotas, reviews, feedback and health of a curated collection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.math import ratio


@dataclass(frozen=True)
class Rule:
    """A condition (SQL) that a row violates where it is true."""

    level: str
    code: str
    condition: str


def violations(rows: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """(key, level, code): all rules in one pass over the rows."""
    hit = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(r.condition), F.lit(False)), F.struct(F.lit(r.level).alias("level"), F.lit(r.code).alias("code"))) for r in rules]))
    return rows.select(key, F.explode(hit).alias("v")).select(key, "v.*")


def audit_status(found: DataFrame) -> DataFrame:
    """One row: errors, warnings and passed or failed."""
    errors = F.count_if(F.col("level") == "error")
    return found.agg(errors.alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"), F.when(errors > 0, "failed").otherwise("passed").alias("status"))


#: The semantic rules of a topic, over columns name, file_stem, type, authority, active, retired_by,
#: last_verified, expires_at, review_by, triggers, authority_docs, history_docs, evidence_paths and the literal as_of.
TOPIC_RULES = (
    Rule("error", "name-file-mismatch", "name <> file_stem"),
    Rule("error", "invalid-date", "last_verified is not null and try_to_date(last_verified, 'yyyy-MM-dd') is null"),
    Rule("error", "expired-topic", "active and try_to_date(expires_at, 'yyyy-MM-dd') < as_of"),
    Rule("error", "review-overdue", "active and try_to_date(review_by, 'yyyy-MM-dd') < as_of"),
    Rule("warning", "unneeded-review-date", "review_by is not null and type not in ('preference', 'feedback')"),
    Rule("error", "retired-active", "active and retired_by is not null"),
    Rule("error", "decision-without-document", "type = 'decision-pointer' and coalesce(size(authority_docs), 0) = 0"),
    Rule("warning", "natural-triggers-too-few", "coalesce(size(filter(triggers, t -> t rlike '[ ]')), 0) < 2"),
    Rule("warning", "natural-triggers-identifiers-only", "size(triggers) > 0 and not exists(triggers, t -> t rlike '[ ]')"),
    Rule("error", "invalid-doc-id", "exists(concat(authority_docs, history_docs), d -> not d rlike '^[A-Za-z0-9._-]+$')"),
    Rule("error", "conflicting-doc-role", "arrays_overlap(authority_docs, history_docs)"),
    Rule("error", "unsafe-evidence-path", "exists(evidence_paths, p -> p like '/%' or p rlike '(^|/)[.][.](/|$)')"),
    Rule("error", "work-package-reference", "exists(evidence_paths, p -> p rlike '(^|/)work-packages?(/|$)')"),
)


def routing(active: DataFrame, routes: DataFrame) -> DataFrame:
    """active (name) against routes (name, place): unrouted, non-active and duplicate routes: name, code, n."""
    lost = active.join(routes, "name", "left_anti").select("name", F.lit("unrouted").alias("code"), F.lit(0).cast("long").alias("n"))
    counted = routes.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    stray = counted.join(active, "name", "left_anti").select("name", F.lit("non-active").alias("code"), "n")
    return lost.unionByName(stray).unionByName(counted.filter("n > 1").select("name", F.lit("duplicate-route").alias("code"), "n"))


def broken_links(docs: DataFrame, key: str, text: str, active: DataFrame, most: int = 10) -> DataFrame:
    """(key, target): [[target]] links to names that are not active, the first `most` per document by name."""
    links = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)\]\]"), F.lit(1)))).alias("target"))
    broken = links.join(active.select(F.col("name").alias("target")), "target", "left_anti")
    order = Window.partitionBy(key).orderBy("target")
    return broken.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def quota(groups: DataFrame, baseline: DataFrame, target: int) -> DataFrame:
    """(name, n) against baseline (name, allowed): the cap is the larger of target and baseline; exceeded or not."""
    joined = groups.join(baseline, "name", "left").withColumn("cap", F.greatest(F.lit(target).cast("long"), F.coalesce("allowed", F.lit(0)).cast("long")))
    return joined.select("name", "n", "cap", (F.col("n") > F.col("cap")).alias("exceeded"))


def ratchet(groups: DataFrame, baseline: DataFrame) -> DataFrame:
    """The new baseline (name, allowed): never above the old one, except for names that it does not have."""
    return groups.join(baseline, "name", "left").select("name", F.least("n", F.coalesce("allowed", "n")).alias("allowed"))


def upcoming_reviews(rows: DataFrame, due: str, as_of: Column, days: int = 60) -> DataFrame:
    """Rows due within `days`: with days_left and overdue."""
    left = F.datediff(F.col(due), as_of)
    return rows.withColumn("days_left", left).withColumn("overdue", left < 0).filter(F.col("days_left") <= days)


def review_state(topics: DataFrame, receipts: DataFrame) -> DataFrame:
    """topics (name, content, review_by) against receipts: missing, stale, mismatch or confirmed."""
    r = receipts.select("name", F.col("content").alias("was"), F.col("review_by").alias("due"))
    both = topics.join(r, "name", "full_outer")
    state = F.when(F.col("was").isNull(), "missing").when(F.col("content").isNull(), "stale").when((F.col("content") != F.col("was")) | ~F.col("review_by").eqNullSafe(F.col("due")), "mismatch").otherwise("confirmed")
    return both.select("name", state.alias("state"))


def feedback(rows: DataFrame, active: DataFrame, receipts: DataFrame) -> DataFrame:
    """(line, query, verdict, expected) with a reject_reason, a duplicate flag (later rows of equal query, verdict and
    expected) and whether a receipt (line) resolved it."""
    known = active.select(F.col("name").alias("expected"), F.lit(True).alias("_known"))
    checked = rows.join(known, "expected", "left").join(receipts.select("line", F.lit(True).alias("_done")).distinct(), "line", "left")
    reason = F.when(F.col("query").isNull() | (F.trim("query") == ""), "empty-query").when(~F.coalesce(F.col("verdict").isin("correct", "wrong", "miss"), F.lit(False)), "unknown-verdict").when((F.col("verdict") == "miss") & F.col("expected").isNull(), "miss-without-expected").when(F.col("expected").isNotNull() & F.col("_known").isNull(), "unknown-topic")
    order = Window.partitionBy("query", "verdict", "expected").orderBy("line")
    out = checked.withColumn("reject_reason", reason).withColumn("duplicate", F.row_number().over(order) > 1).withColumn("resolved", F.coalesce("_done", F.lit(False)))
    return out.drop("_known", "_done")


def feedback_summary(checked: DataFrame) -> DataFrame:
    """One row of counts; actionable: valid wrong or missed rows without a receipt."""
    good = F.col("reject_reason").isNull()
    bad = F.col("verdict").isin("wrong", "miss")
    return checked.agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid"), F.count_if(good & F.col("duplicate")).alias("duplicates"), F.count_if(good & F.col("resolved")).alias("resolved"), F.count_if(good & bad & ~F.col("resolved")).alias("actionable"), F.round(ratio(F.count_if(good & bad), F.count_if(good)), 6).alias("wrong_rate"))


def health(docs: DataFrame, key: str, kind: str, scope: str, size: str) -> DataFrame:
    """Long metrics (metric, name, value): documents and bytes in all, by kind and by scope."""
    parts = docs.groupingSets([[], [F.col(kind)], [F.col(scope)]], F.col(kind), F.col(scope)).agg(F.count(F.lit(1)).alias("documents"), F.sum(size).cast("long").alias("bytes"), F.grouping(kind).alias("gk"), F.grouping(scope).alias("gs"))
    metric = F.when(F.col("gk") == 0, F.lit(kind)).when(F.col("gs") == 0, F.lit(scope)).otherwise("all")
    return parts.select(metric.alias("metric"), F.coalesce(kind, scope).alias("name"), "documents", "bytes")


#: Limits of index files, hook lines and topics, and what a topic's file is named.
INDEX_BYTES, L1_LINES, L2_LINES, HOOK_LENGTH, TOPIC_BYTES = 25 * 1024, 200, 120, 160, 16 * 1024
TOPIC_FILE = r"^[a-z0-9]+(?:_[a-z0-9]+)*\.md$"


def file_issues(files: DataFrame) -> DataFrame:
    """(level, code, subject) of scanned Markdown files (sources/topics.scan; `file`, `kind`, `active`, `bytes`, `content`):
    a missing first index, indexes and topics beyond their limits, long hooks, topics that are not in snake case."""
    rows = files.filter("active").withColumn("lines", F.size(F.split("content", "\n", -1)))
    long_hooks = F.size(F.filter(F.split("content", "\r?\n", -1), lambda x: F.startswith(x, F.lit("- [")) & (F.length(x) > HOOK_LENGTH)))
    found = [
        ("l1-bytes", (F.col("kind") == "catalog") & (F.col("bytes") > INDEX_BYTES)), ("l1-lines", (F.col("kind") == "catalog") & (F.col("lines") > L1_LINES)), ("l2-bytes", (F.col("kind") == "l2") & (F.col("bytes") > INDEX_BYTES)), ("l2-lines", (F.col("kind") == "l2") & (F.col("lines") > L2_LINES)),
        ("l2-hook-length", (F.col("kind") == "l2") & (long_hooks > 0)), ("topic-filename", (F.col("kind") == "topic") & ~F.col("file").rlike(TOPIC_FILE)), ("topic-bytes", (F.col("kind") == "topic") & (F.col("bytes") > TOPIC_BYTES)),
    ]
    hit = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in found]))
    out = rows.select(F.lit("error").alias("level"), F.explode(hit).alias("code"), F.col("file").alias("subject"))
    none = rows.agg(F.count_if(F.col("kind") == "catalog").alias("n")).filter("n = 0")
    return out.unionByName(none.select(F.lit("error").alias("level"), F.lit("l1-missing").alias("code"), F.lit("MEMORY.md").alias("subject")))


def link_issues(files: DataFrame) -> DataFrame:
    """(level, code, subject) of the links of second indexes: to files that are not there, or into the archive."""
    links = files.filter("kind = 'l2' and active").select("file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\]\(([^)#]+\.md)(?:#[^)]+)?\)"), F.lit(1)))).alias("target"))
    known = files.select(F.element_at(F.split("path", "/"), -1).alias("base"), F.col("active")).groupBy("base").agg(F.max("active").alias("active"))
    rows = links.withColumn("base", F.element_at(F.split("target", "/"), -1)).join(known, "base", "left")
    code = F.when(F.col("active").isNull(), "l2-broken-link").when(F.startswith("target", F.lit("archive/")), "l2-archive-link")
    return rows.select(F.lit("error").alias("level"), code.alias("code"), F.concat_ws(" -> ", "file", "target").alias("subject")).filter("code is not null")


def missing_evidence(evidence: DataFrame, listing: DataFrame) -> DataFrame:
    """(name, path) of code evidence whose path no file listing (path) holds."""
    return evidence.select("name", "path").distinct().join(listing.select("path").distinct(), "path", "left_anti").select("name", "path")


def golden_coverage(topics: DataFrame, golden: DataFrame) -> DataFrame:
    """Of topics (name, scopes) and golden cases (expected): topics in all and expected by some case, overall (scope null) and by
    scope, and their share (null over nothing)."""
    asked = topics.join(golden.select(F.col("expected").alias("name")).distinct().withColumn("_hit", F.lit(True)), "name", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    whole = asked.agg(F.count(F.lit(1)).alias("topics"), F.count_if("_hit").alias("evaluated")).select(F.lit(None).cast("string").alias("scope"), "topics", "evaluated")
    each = asked.select(F.explode("scopes").alias("scope"), "_hit").groupBy("scope").agg(F.count(F.lit(1)).alias("topics"), F.count_if("_hit").alias("evaluated"))
    return whole.unionByName(each).withColumn("coverage", F.round(ratio(F.col("evaluated"), F.col("topics")), 6))


def evidence_counts(topics: DataFrame) -> DataFrame:
    """One row over topics (evidence: array of path, symbols, tests): topics with evidence, entries, symbols, entries without
    symbols, tests."""
    each = topics.select(F.explode("evidence").alias("e"))
    row = each.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.size("e.symbols")), F.lit(0)).cast("long").alias("symbols"), F.count_if(F.size("e.symbols") == 0).alias("coarse"), F.coalesce(F.sum(F.size("e.tests")), F.lit(0)).cast("long").alias("tests"))
    return topics.agg(F.count_if(F.size("evidence") > 0).alias("topics")).crossJoin(row)  # one row each


def semantic_digest(*parts: Column) -> Column:
    """What a review confirms: a topic's text and metadata without the columns that change by themselves (dates of checking,
    sessions), which the caller leaves out. Line ends and outer white space of texts do not count."""
    clean = lambda c: F.trim(F.regexp_replace(c.cast("string"), "\r\n", "\n"))
    return F.sha2(F.to_json(F.struct(*[F.coalesce(clean(c), F.lit("")).alias(f"p{i}") for i, c in enumerate(parts)])), 256)


def receipt_id(name: Column, review_by: Column, reviewed_on: Column, content: Column, source: Column, reason: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", name, review_by, reviewed_on, content, source, reason), 256), 1, 24)


def _receipts(rows: DataFrame, reviewed_on: Column, source: str, reason: Column) -> DataFrame:
    made = rows.select("name", F.col("review_by").cast("string").alias("review_by"), reviewed_on.cast("string").alias("reviewed_on"), "content", F.lit(source).alias("source"), reason.alias("reason"))
    return made.withColumn("receipt_id", receipt_id(F.col("name"), F.col("review_by"), F.col("reviewed_on"), F.col("content"), F.col("source"), F.col("reason")))


def bootstrap_receipts(topics: DataFrame, lock: DataFrame, reason: str = "baseline of a migration; no new confirmation") -> DataFrame:
    """The lock (name, review_by, reviewed_on, content, source, reason, receipt_id) with a baseline for each reviewable topic
    (name, review_by, last_verified, content) that it lacks."""
    new = topics.join(lock.select("name"), "name", "left_anti")
    return lock.unionByName(_receipts(new, F.col("last_verified"), "baseline", F.lit(reason)).select(lock.columns))


def confirm_receipt(lock: DataFrame, topic: DataFrame, review_by: str, reason: str, today: str) -> DataFrame:
    """The lock with a confirmation of one topic (name, content) until review_by: a real date after today, within 365 days, for
    a reason of at least ten characters."""
    import datetime

    due, now = datetime.date.fromisoformat(review_by), datetime.date.fromisoformat(today)
    if not now < due <= now + datetime.timedelta(days=365):
        raise ValueError("the review must be due after today, and within 365 days")
    if len(reason.strip()) < 10:
        raise ValueError("a reason has at least ten characters")
    made = _receipts(topic.withColumn("review_by", F.lit(review_by)), F.lit(today), "confirmed", F.lit(reason.strip()))
    return lock.join(topic.select("name"), "name", "left_anti").unionByName(made.select(lock.columns))


def reviewed_text(content: Column, review_by: str, today: str) -> Column:
    """A topic's Markdown with new dates of checking and of the next review in its front matter."""
    return F.regexp_replace(F.regexp_replace(content, r"(?m)^(\s{2}last_verified:)[ \t]*.*$", f"$1 {today}"), r"(?m)^(\s{2}review_by:)[ \t]*.*$", f"$1 {review_by}")


def public_changes(changes: DataFrame, most: int = 60) -> DataFrame:
    """Of paired cases (case_id, kind, group, partition, change, rank_a, rank_b, abstained_a, abstained_b) those that changed, the
    first `most` of each kind of change by id, with the id cut to twelve characters, and how many there are."""
    rows = changes.filter("change not in ('same', 'unchanged')")
    order = Window.partitionBy("change").orderBy("case_id")
    total = F.count(F.lit(1)).over(Window.partitionBy("change"))
    out = rows.withColumn("_n", F.row_number().over(order)).withColumn("total", total).filter(F.col("_n") <= most)
    return out.withColumn("case_id", F.substring(F.col("case_id").cast("string"), 1, 12)).drop("_n")
