"""Line dedup by site-relative frequency.

A line that stands on more than `max_ratio` of a host's pages is boilerplate of that site and is dropped there; the same
line stays on other sites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._scale import WORD, keep

#: Elements without text, elements that end a line, and what is trimmed from a line.
HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(?:br|p|div|li|ul|ol|h[1-6]|article|nav|title|table|tr|td|th|footer|header|section|body|head|html)\b[^>]*>"
TAG = r"<[^>]*>"
EDGE = r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"
HOST = r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    """The host in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """The visible lines of a page, trimmed, without empty ones. Null counts as an empty page."""
    text = F.coalesce(html.cast("string"), F.lit(""))
    for pattern, by in ((HIDDEN, ""), (BLOCK, "\n"), (TAG, "")):
        text = F.regexp_replace(text, pattern, by)
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, EDGE, "")), lambda x: x != "")


def _key(line: Column) -> Column:
    """128 bits that stand for a line, so that only hashes are shuffled."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def drop_site_lines(pages: DataFrame, host: str, lines: str, max_ratio: float | Callable[[Column], Column] = 0.1, min_pages: int = 5, has_word: str = r"[^\x20\x09-\x0D]") -> DataFrame:
    """Replace the array column `lines` by the lines that stay, and add n_lines and n_dropped (long).

    A line is dropped from every page of a host if more than max_ratio of the host's pages, and at least min_pages, hold
    it; small hosts thus lose nothing. Pages with a null host keep all lines, as do lines without a word; repeated rows
    are pages of their own. max_ratio may depend on the line. Column names host_lines, n_lines and n_dropped are replaced.

    Each page gives a line's hash once; counts are combined before the shuffle. A host has at most (lines a page) /
    max_ratio boilerplate lines, so the list that is joined back is short."""
    pages = pages.drop("host_lines", "n_lines", "n_dropped")
    sites = pages.filter(F.col(host).isNotNull())
    totals = sites.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("_pages"))
    told = (lambda x: F.struct(_key(x).alias("k"), max_ratio(x).alias("most"))) if callable(max_ratio) else (lambda x: F.struct(_key(x).alias("k")))
    held = sites.select(F.col(host).alias("_host"), F.explode(F.transform(F.array_distinct(F.filter(F.col(lines), lambda x: x.rlike(has_word))), told)).alias("_key"))
    by = ["_host", "_key.k.a", "_key.k.b", *["_key.most"] * callable(max_ratio)]
    often = held.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_pages)
    often = often.join(totals, "_host").filter(F.col("_n") > (F.col("most") if callable(max_ratio) else max_ratio) * F.col("_pages"))
    listed = keep(often.groupBy("_host").agg(F.collect_list(F.struct("a", "b")).alias("host_lines")), "site-lines")
    joined = pages.join(listed, F.col(host) == F.col("_host"), "left").withColumn("_old", F.col(lines))
    stays = F.when(F.col("host_lines").isNull(), F.col("_old")).otherwise(F.filter("_old", lambda x: ~F.array_contains("host_lines", _key(x)) | ~x.rlike(has_word)))
    out = joined.withColumn(lines, stays)
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    return out.withColumn("n_lines", size("_old")).withColumn("n_dropped", size("_old") - size(lines)).drop("_old", "_host", "host_lines")


def page_lines(pages: DataFrame) -> DataFrame:
    """Per page: host, n_lines, n_dropped and the text that stays. Null html gives an empty text; a url without a host
    drops nothing."""
    slim = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines"))
    return drop_site_lines(slim, "host", "lines").select("page_id", "host", "n_lines", "n_dropped", F.array_join("lines", "\n").alias("text"))


ORACLE = rf"""
with p as (
  select page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') as host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g'),
      '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)), lambda x: regexp_replace(x, '{EDGE}', '', 'g')), lambda x: x <> '') as lines
  from pages),
t as (select host, count(*) as total from p where host is not null group by host),
l as (select p.page_id, p.host, unnest(list_distinct(p.lines)) as line from p where host is not null),
f as (select l.host, list(l.line) as bad from (select host, line, count(*) as n from l group by host, line) l
  join t on t.host = l.host where l.n >= 5 and l.n > 0.1 * t.total group by l.host),
o as (select p.page_id, p.host, p.lines, list_filter(p.lines, lambda x: not list_contains(coalesce(f.bad, []), x)) as stay
  from p left join f on p.host = f.host)
select page_id, host, cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(stay) as bigint) as n_dropped,
  array_to_string(stay, chr(10)) as text from o
"""


#: Plain texts: from so many words on a line is less likely to be common by chance, or is a passage.
SENTENCE, PASSAGE = 8, 20


def n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def drop_passages(docs: DataFrame, host: str, lines: str, key: str = "doc_id", least: int = 5) -> DataFrame:
    """Drop lines of at least PASSAGE words that stand in `least` or more unlike documents of a host, whatever its size,
    from all of these but the first by `key` (nulls last). Adds n_passages (long).

    Documents are unlike if the smallest hash of their other lines differs; equal texts count once. Copies with small
    edits mostly share that hash, so a line counts as a passage only if more than half of its texts are unlike: near
    copies are left whole for the stage that finds them. The first document keeps the passage, so no content is lost,
    and a document of nothing but passages stays whole, since its copies are near duplicates.

    Lines meet documents as rows of hashes, since a host may have any number of passages."""
    hashes = F.array_sort(F.array_distinct(F.transform(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x))))
    marked = docs.withColumn("_text", _key(F.array_join(lines, "\n")))
    long_ = F.transform(F.filter(F.array_distinct(lines), lambda x: n_words(x) >= PASSAGE), _key)
    sent = marked.filter(F.col(host).isNotNull()).select(F.col(host).alias("_host"), F.col(key).alias("_id"), "_text", F.slice(hashes, 1, 2).alias("_least"), F.explode(long_).alias("_line"))
    other = F.filter("_least", lambda h: h != F.col("_line.a"))
    sent = keep(sent.select("_host", "_id", "_text", "_line", F.when(F.size(other) > 0, other[0]).alias("_other")), "passages")
    texts = sent.groupBy("_host", "_line", "_other", "_text").agg(F.min("_id").alias("_id"))
    unlike = texts.groupBy("_host", "_line", "_other").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_id"))
    found = unlike.groupBy("_host", "_line").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_unlike"), F.min("_id").alias("_first"))
    found = found.filter((F.col("_unlike") >= least) & (2 * F.col("_unlike") > F.col("_n"))).select("_host", "_line", "_first")
    gone = sent.join(found, ["_host", "_line"]).filter(F.col("_first").isNotNull() & F.coalesce(F.col("_id") > F.col("_first"), F.lit(True)))
    gone = keep(gone.groupBy("_host", "_id", "_text").agg(F.collect_set("_line").alias("_gone")).withColumnRenamed("_text", "_of"), "gone")
    same = (F.col(host) == F.col("_host")) & F.col(key).eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of"))
    out = marked.join(gone, same, "left")
    stays = F.filter(lines, lambda x: ~F.array_contains("_gone", _key(x)))
    some = F.col("_gone").isNotNull() & F.exists(stays, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_stays", F.when(some, stays).otherwise(F.col(lines))).withColumn("n_passages", (F.greatest(F.size(lines), F.lit(0)) - F.greatest(F.size("_stays"), F.lit(0))).cast("long"))
    return out.withColumn(lines, F.col("_stays")).drop("_stays", "_text", "_of", "_gone", "_host", "_id")


def text_lines(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 5, key: str = "doc_id") -> DataFrame:
    """The same for plain texts: lines end at \\n, the source is the site. All columns of docs are kept, whatever their
    names; n_lines and n_dropped are added where docs has no columns of these names.

    A source is far larger than a site, so the ratio falls with the length of a line: max_ratio under SENTENCE words,
    half of it below PASSAGE words; passages also go from min_pages unlike documents on (drop_passages). Null texts stay
    null, empty ones empty; rows of a null source keep all lines; repeated rows are documents of their own. An empty
    table gives no rows."""
    held = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("held")
    cut = docs.select(held, F.col(host).alias("site"), F.col(key).alias("id"), F.col(text).alias("whole"), F.split(F.col(text), "\n", -1).alias("parts"))
    out = drop_site_lines(cut, "site", "parts", lambda x: F.when(n_words(x).between(SENTENCE, PASSAGE - 1), F.lit(max_ratio / 2)).otherwise(F.lit(max_ratio)), min_pages)
    out = drop_passages(out, "site", "parts", "id", min_pages).withColumn("n_dropped", F.col("n_dropped") + F.col("n_passages"))
    stays = F.when(F.col("n_dropped") > 0, F.array_join("parts", "\n")).otherwise(F.col("whole"))
    own = [(stays if c == text else F.col(f"held.c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*own, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])
