"""Quality rules with adaptive thresholds.

Instead of fixed cutoffs, every (language, source) group gets fences from quantile sketches of its own documents: counts
by bins of fixed width. Sketches are mergeable: groups with too few documents take the sketch merged over their language,
or over everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._scale import keep

#: Counts of a text `t`, each taken once: words and lines are bound to lambda variables. Windows of three words are
#: first compared by hash; only where two hashes agree are the windows themselves sorted and compared.
_COUNTS = r"""
transform(array(regexp_extract_all({t}, r'[^\x20\x09-\x0D]+', 0)), w -> named_struct(
  'n_words', cast(size(w) as bigint),
  'n_repeat_words', case when size(w) < 4 then 0L
    when size(array_distinct(transform(sequence(1, size(w) - 2), i -> xxhash64(element_at(w, i), element_at(w, i + 1), element_at(w, i + 2))))) = size(w) - 2 then 0L
    else transform(array(sort_array(transform(sequence(1, size(w) - 2), i -> named_struct('g', concat_ws(' ', element_at(w, i), element_at(w, i + 1), element_at(w, i + 2)), 'p', i)))),
      s -> transform(array(sort_array(transform(filter(s, (x, k) -> (k > 0 and x.g = s[k - 1].g) or (k < size(s) - 1 and x.g = s[k + 1].g)), x -> x.p))),
        p -> case when size(p) = 0 then 0L else aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (n, x) -> n + x) end)[0])[0]
  end))[0]"""


def counts(name: str) -> Column:
    """Struct of the counts of a non-null text column."""
    lines = F.filter(F.split(F.col(name), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    parts = F.transform(F.array(lines), lambda own: F.struct(F.size(own).cast("long").alias("n_lines"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines")))[0]
    bare = F.length(F.regexp_replace(F.col(name), r"[\x20\x09-\x0D]+", ""))
    return F.struct(
        F.expr(_COUNTS.format(t=name)).alias("w"),
        bare.cast("long").alias("word_chars"),
        (F.length(name) - F.length(F.regexp_replace(F.col(name), r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(name) - F.length(F.regexp_replace(F.col(name), r"[A-ZÀ-ÖØ-Þ]+", ""))).cast("long").alias("n_upper"),
        parts.alias("l"),
    )


def text_counts(docs: DataFrame, text: str) -> DataFrame:
    """Add the counts as columns. Null text counts as empty: all counts are 0."""
    held = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    held = held.withColumn("_c", counts("_t")).drop("_t")
    return held.select(*[c for c in held.columns if c != "_c"], F.col("_c.w.n_words").alias("n_words"), "_c.word_chars", "_c.n_symbols", "_c.n_upper", F.col("_c.l.n_lines").alias("n_lines"), F.col("_c.l.n_dup_lines").alias("n_dup_lines"), F.col("_c.w.n_repeat_words").alias("n_repeat_words"))


@dataclass(frozen=True)
class Measure:
    """A ratio part / whole of a document, in steps of 1 / resolution: its bin is the number of whole steps. It fails
    above q75 + width * spread (and, if `both`, below q25 - width * spread), where spread is the distance of the
    quartiles, at least `least` bins."""

    name: str
    part: str
    whole: str
    resolution: int
    least: int
    both: bool = False

    @property
    def bin(self) -> str:
        return f"({self.part} * {self.resolution}) div greatest({self.whole}, 1)"


MEASURES = (
    Measure("symbols", "n_symbols", "word_chars", 1000, 10),
    Measure("upper", "n_upper", "word_chars", 1000, 30),
    Measure("dup_lines", "n_dup_lines", "n_lines", 1000, 120),
    Measure("repeats", "n_repeat_words", "n_words", 1000, 80),
    Measure("word_length", "word_chars", "n_words", 100, 60, True),
)
WIDTH, LEAST_DOCS, MIN_WORDS, MOST_REPEAT = 4, 200, 50, 0.5


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """From bins (by..., m, bin, n): per group and measure the number of documents, q25 and q75 (nearest rank, as bins).
    Merging sketches is adding up their bins, so every choice of `by` reads the same table."""
    merged = sketch.groupBy(*by, "m", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "m")
    so_far = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumn("cum", so_far).withColumn("total", F.sum("n").over(group))
    at = lambda k: F.min(F.when(4 * F.col("cum") >= k * F.col("total"), F.col("bin")))
    return ranked.groupBy(*by, "m").agg(F.max("total").alias("n"), at(1).alias("q25"), at(3).alias("q75"))


def fences(measured: DataFrame, groups: list[str], width: int = WIDTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per group (nulls are a group) with an array of structs lo and hi, one for each measure, in bins; written to
    the shared folder.

    A sketch is the number of documents in each bin: as exact as the bins are narrow, the same in every run, and
    mergeable by addition. Its size depends on the resolution, not on the documents (the word length, which has no upper
    end, adds a bin for each length that occurs). A group of fewer than `least_docs` documents is judged by its first
    key's sketch, merged over the rest, and where that is small too by the sketch of all."""
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(m.name).alias("bin")) for i, m in enumerate(MEASURES)]))
    sketch = keep(measured.select(*groups, one.alias("x")).select(*groups, "x.*").groupBy(*groups, "m", "bin").agg(F.count(F.lit(1)).alias("n")), "sketches")
    own, wide, whole = quartiles(sketch, *groups), quartiles(sketch, groups[0]), quartiles(sketch)
    first = groups[0]
    wide = wide.select(F.col(first).alias("_first"), F.col("m").alias("_m"), *[F.col(c).alias(f"{c}_first") for c in ("n", "q25", "q75")])
    whole = whole.select("m", *[F.col(c).alias(f"{c}_all") for c in ("q25", "q75")])
    rows = own.join(wide, F.col(first).eqNullSafe(F.col("_first")) & (F.col("m") == F.col("_m"))).join(F.broadcast(whole), "m")  # a row per measure
    best = lambda q: F.when(F.col("n") >= least_docs, F.col(q)).when(F.col("n_first") >= least_docs, F.col(f"{q}_first")).otherwise(F.col(f"{q}_all"))
    least = F.element_at(F.array(*[F.lit(m.least) for m in MEASURES]), F.col("m") + 1)
    spread = F.greatest(best("q75") - best("q25"), least)
    both = F.element_at(F.array(*[F.lit(m.both) for m in MEASURES]), F.col("m") + 1)
    lo, hi = F.when(both, best("q25") - width * spread).otherwise(F.lit(-1)), best("q75") + width * spread
    fence = rows.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("m", lo.alias("lo"), hi.alias("hi")))).alias("_fences"))
    return keep(fence, "fences")


def adaptive_filter(docs: DataFrame, text: str, groups: list[str], width: int = WIDTH, least_docs: int = LEAST_DOCS, min_words: int = MIN_WORDS, most_repeat: float = MOST_REPEAT, carry_text: bool = True) -> DataFrame:
    """Add the counts (and leave out the text unless carry_text), base_failed (fewer than min_words words, or a share of repeated words above most_repeat) and kept
    (not base_failed and within all fences of the group). Only documents that pass the base rules shape the fences.
    Columns with the names of counts, measures or verdicts are replaced."""
    docs = docs.drop(*[m.name for m in MEASURES], "_fences")
    rows = text_counts(docs, text).withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") > most_repeat * F.col("n_words")))
    rows = keep((rows if carry_text else rows.drop(text)).select("*", *[F.expr(f"cast({m.bin} as bigint)").alias(m.name) for m in MEASURES]), "counts")
    limits = fences(rows.filter("not base_failed"), groups, width, least_docs)
    joined = rows.alias("r").join(limits.alias("f"), [F.col(f"r.{g}").eqNullSafe(F.col(f"f.{g}")) for g in groups], "left")
    inside = F.lit(True)
    for i, m in enumerate(MEASURES):
        inside = inside & F.col(f"r.{m.name}").between(F.col("f._fences")[i]["lo"], F.col("f._fences")[i]["hi"])
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select("r.*", kept.alias("kept")).drop(*[m.name for m in MEASURES])


def rules_digest(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and verdicts. Null and empty texts fail the base rules; null lang or source
    are groups of their own; repeated rows are judged alike; other columns are ignored."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    counted = adaptive_filter(slim, "text", ["lang", "source"], carry_text=False)
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The digest in DuckDB SQL. Windows of three words that occur twice mark their words; quartiles are nearest ranks."""
    bins = " union all ".join(f"select rid, lang, source, base_failed, {i} as m, ({m.part} * {m.resolution}) // greatest({m.whole}, 1) as bin, {m.least} as least, {str(m.both).lower()} as two from f" for i, m in enumerate(MEASURES))

    def ranks(*by: str) -> str:
        keys = ", ".join([*by, "m"])
        return f"""select {keys}, max(total) as n, min(bin) filter (where 4 * cum >= total) as q25, min(bin) filter (where 4 * cum >= 3 * total) as q75, any_value(least) as least, bool_or(two) as two
  from (select {keys}, bin, any_value(least) as least, bool_or(two) as two, sum(count(*)) over (partition by {keys} order by bin) as cum, sum(count(*)) over (partition by {keys}) as total from b where not base_failed group by {keys}, bin) group by {keys}"""

    best = lambda q: f"case when o.n >= {LEAST_DOCS} then o.{q} when w.n >= {LEAST_DOCS} then w.{q} else a.{q} end"
    return rf"""with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
s as (select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d), w as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) as p from s),
g as (select rid, p, w, lead(w) over (partition by rid order by p) as w2, lead(w, 2) over (partition by rid order by p) as w3 from w),
r as (select rid, p from (select rid, p, count(*) over (partition by rid, w, w2, w3) as k from g where w3 is not null) where k > 1),
rep as (select rid, count(distinct q) as n from (select rid, unnest([p, p + 1, p + 2]) as q from r) group by rid),
l as (select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
c as (select d.rid, d.doc_id, d.lang, d.source, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]+', '', 'g')) as bigint) as n_upper,
  cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
  from d join s on s.rid = d.rid join l on l.rid = d.rid left join rep on rep.rid = d.rid),
f as (select *, n_words < {MIN_WORDS} or n_repeat_words > {MOST_REPEAT} * n_words as base_failed from c),
b as ({bins}),
fence as (select o.lang, o.source, o.m, {best('q25')} as q25, {best('q75')} as q75, o.least, o.two from ({ranks('lang', 'source')}) o
  join ({ranks('lang')}) w on w.lang is not distinct from o.lang and w.m = o.m join ({ranks()}) a on a.m = o.m),
bad as (select distinct rid from b join fence x on x.lang is not distinct from b.lang and x.source is not distinct from b.source and x.m = b.m
  where b.bin > x.q75 + {WIDTH} * greatest(x.q75 - x.q25, x.least) or (x.two and b.bin < x.q25 - {WIDTH} * greatest(x.q75 - x.q25, x.least)))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rid not in (select rid from bad) as kept from f"""


ORACLE = _oracle()
