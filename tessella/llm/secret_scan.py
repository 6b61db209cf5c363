"""Secret scans over an incremental blob ledger.

Every version of a file is content-addressed. The ledger (a Parquet table) holds, for each blob, the rule versions that
have scanned it and what they found; only unseen pairs of blob and rule version are scanned, and findings are joined
back to every path that ever held the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._scale import keep, remove, scratch_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` (it must not match the empty string) whose group `group` has at
    least `least` characters. `hint`: a literal that every match holds, to skip texts at once."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds (in the order of the contract), then the ones that this scanner adds.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)
FINDING = "array<struct<start:bigint,kind:int,end:bigint>>"
MATCH = "array<struct<kind:int,pos:int,gap:int,hit:int,part:int>>"
LEDGER = "blob string, rules array<string>, findings array<struct<start:bigint,rule:string,end:bigint>>"


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """The matches in order, as lengths in code points: of the text since the one before, of the match itself and of its
    checked group. Positions are their running sums, taken later over rows: a list that grows match by match would be
    copied match by match."""
    pattern = F.lit(rule.pattern)
    matched = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.least else matched
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matched.alias("hit"), checked.alias("part"))
    out = F.transform(F.filter(parts, lambda p: p["hit"].isNotNull()), lambda p, i: F.struct(F.lit(order).alias("kind"), i.alias("pos"), F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("hit"), F.length(p["part"]).alias("part")))
    some = text.contains(rule.hint) if rule.hint else text.rlike(rule.pattern)
    return F.when(some, out).otherwise(F.array().cast(MATCH))


def _read(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.range(0).select(F.from_json(F.lit("{}"), LEDGER).alias("r")).select("r.*")
        raise


def scan(versions: DataFrame, content: str, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add blob (sha-256 of the content, null counts as empty) and spans (array of start, kind, end: code points, end
    exclusive, kind as the rule's place in `rules`; ordered by start, then kind).

    `ledger` is a Parquet folder to which one row per newly scanned blob is appended: blob, rules (name@version scanned
    then) and their findings. Running again scans nothing; a new rule version scans each blob once for that rule; what
    two runs appended at the same time counts once. All rows of `versions` and its other columns are kept; the names
    blob and spans are replaced. Time is linear in the text and its matches: a text's matches are rows, sorted in the
    task that holds the text."""
    spark = versions.sparkSession
    versions = versions.drop("blob", "spans")
    body = F.coalesce(F.col(content).cast("string"), F.lit(""))
    versions = versions.withColumn("blob", F.sha2(body, 256))
    names = [r.name for r in rules]
    # One text per blob, combined before the shuffle: copies cost one scan however many there are.
    blobs = versions.groupBy("blob").agg(F.any_value(body).alias("_text"))
    seen = _read(spark, ledger).filter("rules is not null").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_seen"))
    blobs = blobs.join(seen, "blob", "left")
    todo = F.array_except(F.array(*map(F.lit, names)), F.coalesce("_seen", F.array().cast("array<string>")))
    blobs = blobs.withColumn("rules", todo).filter(F.size("rules") > 0)
    found = [F.when(F.array_contains("rules", r.name), _matches(F.col("_text"), r, i)).otherwise(F.array().cast(MATCH)) for i, r in enumerate(rules)]
    mark = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("pos"), F.lit(0).alias("gap"), F.lit(0).alias("hit"), F.lit(0).alias("part"))).cast(MATCH)
    rows = blobs.select("blob", "rules", F.explode(F.concat(mark, *found)).alias("m")).select("blob", F.when(F.col("m.kind") < 0, F.col("rules")).alias("rules"), "m.*")
    so_far = Window.partitionBy("blob", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # the blob's partitioning serves
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(so_far))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind") + 1)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("kind") + 1)
    finding = F.when(F.when(F.col("kind") >= 0, F.col("part") >= least), F.struct((F.col("end") - F.col("hit")).alias("start"), name.alias("rule"), F.col("end").alias("end")))
    rows.withColumn("f", finding).groupBy("blob").agg(F.max("rules").alias("rules"), F.collect_list("f").alias("findings")).write.mode("append").parquet(ledger)
    # Join back only the blobs with findings, of the rule versions asked for.
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    hits = _read(spark, ledger).filter(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).select("blob", "f.*").filter(F.col("rule").isin(names)).distinct()
    hits = hits.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", place[F.col("rule")].alias("kind"), "end"))).cast(FINDING).alias("spans"))
    return versions.join(keep(hits, "hits"), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(FINDING)))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans and all spans.

    Null and empty texts have no spans; repeated rows give repeated rows; other columns are ignored; an empty table
    gives no rows. Without a ledger folder an empty one in the shared folder is used, so every text is scanned; it is
    removed once its findings are joined."""
    import uuid

    own = ledger is None
    ledger = ledger or f"{scratch_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    out = scan(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "text", ledger)
    if own:
        remove(docs.sparkSession, ledger)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The digest in DuckDB SQL: between the pieces of a split and the matches lie all positions."""
    spans = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        part = f"regexp_extract_all(t, '{p}', {r.group})"
        spans.append(f"""select doc_id, {i} as kind, unnest(list_transform(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1), lambda i: {{'s': list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda g: length(g)))
      + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}', 0)[1:i - 1], lambda h: length(h))), 0), 'n': length(regexp_extract_all(t, '{p}', 0)[i]), 'part': length({part}[i])}})) as x from d where regexp_matches(t, '{p}')""")
    names = ", ".join(f"'{r.kind}'" for r in RULES)
    least = ", ".join(str(r.least) for r in RULES)
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), raw as ({' union all '.join(spans)}),
ok as (select doc_id, kind, cast(x.s as bigint) as s, cast(x.s + x.n as bigint) as e from raw where x.part >= [{least}][kind + 1]),
g as (select doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
  string_agg([{names}][kind + 1] || ':' || s || ':' || e, ',' order by s, kind) as spans, coalesce(string_agg([{names}][kind + 1] || ':' || s || ':' || e, ',' order by s, kind) filter (where kind < 3), '') as base from ok group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g on d.doc_id = g.doc_id"""


ORACLE = _oracle()
