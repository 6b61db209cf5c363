"""Candidate lanes beside BM25F: exact anchors, path suffixes, delimited triggers, trigrams, edit distance, graph."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import ascii_tokens, character_trigrams, edit_budget, edit_keys, edit_lookups, ngrams, path_suffixes
from tessella.scratch import parallel


def exact_matches(anchors: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, anchor) with the exact map (kind, normalized, documents): query_id, kind, doc_id."""
    return anchors.join(entries, F.lower(anchors["anchor"]) == entries["normalized"]).select("query_id", "kind", F.explode("documents").alias("doc_id")).distinct()


def suffix_matches(queries: DataFrame, paths: DataFrame) -> DataFrame:
    """Pairs (query_id, doc_id) where one path is the other or ends with a slash and the other. Equi-joins on suffixes
    take the place of the theta join."""
    q = queries.select("query_id", F.col("path").alias("whole"), path_suffixes(F.col("path")).alias("parts"))
    d = paths.select("doc_id", F.col("path").alias("whole"), path_suffixes(F.col("path")).alias("parts"))
    longer = d.select("doc_id", F.explode("parts").alias("whole")).join(q.filter("whole <> ''").select("query_id", "whole"), "whole")
    shorter = q.select("query_id", F.explode("parts").alias("whole")).join(d.filter("whole <> ''").select("doc_id", "whole"), "whole")
    return longer.select("query_id", "doc_id").unionByName(shorter.select("query_id", "doc_id")).distinct()


def trigger_matches(triggers: DataFrame, docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(trigger_id, key) for triggers of `words` tokens that a text holds, delimited: an equi-join on token n-grams."""
    asked = triggers.select("trigger_id", F.array_join(ascii_tokens(F.col("trigger")), " ").alias("gram"))
    held = docs.select(key, F.explode(F.array_distinct(ngrams(ascii_tokens(F.col(text)), words))).alias("gram"))
    return held.join(asked, "gram").select("trigger_id", key).distinct()


def trigram_matches(fragments: DataFrame, terms: DataFrame, least: float = 0.45, most: int = 24) -> DataFrame:
    """(fragment, term, shared, dice): set similarity of trigrams, at least min(2, n) shared; the best `most` terms per
    fragment by similarity, then term."""
    left = fragments.select("fragment", character_trigrams(F.col("fragment")).alias("g")).withColumn("n", F.size("g"))
    right = terms.select("term", character_trigrams(F.col("term")).alias("g")).withColumn("m", F.size("g"))
    both = left.select("fragment", "n", F.explode("g").alias("gram")).join(right.select("term", "m", F.explode("g").alias("gram")), "gram")
    out = both.groupBy("fragment", "n", "term", "m").agg(F.count(F.lit(1)).alias("shared")).withColumn("dice", 2 * F.col("shared") / (F.col("n") + F.col("m")))
    out = out.filter((F.col("shared") >= F.least(F.lit(2), F.col("n"))) & (F.col("dice") >= least))
    order = Window.partitionBy("fragment").orderBy(F.desc(F.round("dice", 9)), "term")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("fragment", "term", "shared", F.round("dice", 6).alias("dice"), "rank")


def fuzzy_matches(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, term, distance): 1..k edits apart, k by the word's length. Terms and words meet in a common deletion (long
    ones in a third), so a word meets the terms near it and not all terms of its length."""
    asked = words.select("word", F.explode(edit_lookups(F.col("word"))).alias("key"))
    met = asked.join(terms.select("term", F.explode(edit_keys(F.col("term"))).alias("key")), "key").select("word", "term").distinct()
    found = met.withColumn("distance", F.levenshtein("word", "term"))
    return found.filter((F.col("distance") > 0) & (F.col("distance") <= edit_budget(F.col("word")))).select("word", "term", "distance")


#: So many triggers, of so many characters in all and so many of them without an ASCII letter or digit, travel to the queries
#: at most.
CARRIED, CARRIED_CHARACTERS, CARRIED_BARE = 100_000, 8_000_000, 256


def delimited(queries: DataFrame, triggers: DataFrame, text: str = "normalized") -> DataFrame:
    """(query_id, text): triggers that a query holds between characters other than ASCII letters and digits.

    Up to CARRIED triggers travel to the queries, and each query is searched where it is read; more of them meet the heads of
    the queries' parts in a join. Both ways give the same rows; only so many triggers reach the driver. Empty triggers are never found."""
    known = triggers.filter(F.length(text) > 0).select(text).distinct()
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text).cast("long")).alias("characters"), F.count_if(~F.col(text).rlike("[a-z0-9]")).alias("bare")).first()
    if size["n"] > CARRIED or (size["characters"] or 0) > CARRIED_CHARACTERS or size["bare"] > CARRIED_BARE:
        return delimited_by_heads(queries, triggers, text)
    few = [r[0] for r in known.collect()]
    rows = parallel(queries.filter(F.length(text) > 0)).select("query_id", text)
    return rows.mapInArrow(lambda batches: _delimited_batches(batches, few), f"query_id {rows.schema['query_id'].dataType.simpleString()}, `{text}` string").distinct()


def _delimited_batches(batches: Iterator[pa.RecordBatch], triggers: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of a key and a text to those of the key and each trigger that the text holds.

    A run of ASCII letters and digits in a trigger is a whole run of any text that holds it, so a trigger is looked for where
    all its runs are; it is found by its longest. Those without any are looked for in every text."""
    runs, inner = re.compile("[a-z0-9]+"), re.compile("[a-z0-9]")
    by_run: dict[str, list[tuple[str, frozenset[str]]]] = {}
    bare = []
    for t in triggers:
        found = frozenset(runs.findall(t))
        if found:
            by_run.setdefault(max(found, key=lambda r: (len(r), r)), []).append((t, found))
        else:
            bare.append(t)

    def holds(text: str, t: str) -> bool:
        at = text.find(t)
        while at >= 0:
            end = at + len(t)
            if not (at and inner.match(text, at - 1)) and not inner.match(text, end):
                return True
            at = text.find(t, at + 1)
        return False

    for batch in batches:
        rows, out = [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            held = set(runs.findall(text))
            found = [t for t in bare if holds(text, t)]
            for run in held & by_run.keys():
                found += [t for t, needed in by_run[run] if needed <= held and holds(text, t)]
            rows += [row] * len(found)
            out += found
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], batch.schema.names)


#: Characters of a query that are read at a time.
CHUNK = 256


def delimited_by_heads(queries: DataFrame, triggers: DataFrame, text: str = "normalized") -> DataFrame:
    """delimited() for any number of triggers.

    A trigger is keyed by its head, its first 1, 2, 4, 8... characters (the most that it has), and a query emits the heads
    of those lengths at each place where a delimited part may start: a row per place and length in use, however long
    triggers are. What follows the head is then compared. Empty triggers are never found."""
    head = lambda t, n: F.xxhash64(n, F.substring(t, F.lit(1), n))
    size = F.length(text)
    tier = F.lit(1)
    for n in (2**i for i in range(1, 13)):
        tier = F.when(size >= n, n).otherwise(tier)
    known = triggers.filter(size > 0).select(text).distinct().select(F.col(text).alias("trigger"), tier.alias("tier")).withColumn("head", head(F.col("trigger"), F.col("tier")))
    tiers = [r[0] for r in known.select("tier").distinct().collect()]  # 13 at most
    if not tiers:
        return queries.select("query_id", text).limit(0)
    longest = known.agg(F.max(F.length("trigger"))).first()[0]

    ends = {n: 2 * n if 2 * n <= 4096 else longest + 1 for n in tiers}
    ahead = -(-max(ends.values()) // CHUNK) + 1
    # A long query is read in chunks with what follows them, as a place in a string is found by counting from its start.
    last = lambda c: F.substring(c, -1, 1)
    chunks = parallel(queries.filter(size > 0)).select("query_id", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("c"))
    window = F.transform("c", lambda c, j: F.struct(F.when(j > 0, last(F.get("c", j - 1))).otherwise("").alias("before"), F.length(c).alias("n"), F.array_join(F.slice("c", j + 1, ahead), "").alias("part")))
    windows = chunks.select("query_id", F.explode(window).alias("w")).select("query_id", "w.*")
    word = lambda c: c.rlike("[a-z0-9]")
    at = F.filter(F.sequence(F.lit(1), "n"), lambda i: ~word(F.when(i == 1, F.col("before")).otherwise(F.substring("part", i - 1, F.lit(1)))))

    def heads(n):
        fits = F.filter("at", lambda i: i + n - 1 <= F.length("part"))
        return F.transform(fits, lambda i: F.struct(F.lit(n).alias("tier"), F.substring("part", i, F.lit(ends[n])).alias("rest")))

    places = windows.select("query_id", "part", at.alias("at"))
    rows = places.select("query_id", F.explode(F.concat(*[heads(n) for n in tiers])).alias("p")).select("query_id", "p.*")
    met = rows.withColumn("head", head(F.col("rest"), F.col("tier"))).join(known, ["tier", "head"])
    after = F.expr("substring(rest, length(trigger) + 1, 1)")
    return met.filter(F.startswith("rest", "trigger") & ~after.rlike("[a-z0-9]")).select("query_id", F.col("trigger").alias(text)).distinct()


def two_hops(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """From seeds (id) along edges (src, dst, kind), undirected: (target, kind, hops, n). One hop counts edges; two hops
    go through a shared neighbour, have the kind of the second edge and count the neighbours. Seeds are no targets."""
    both = edges.select("src", "dst", "kind").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")).distinct()
    first = both.join(seeds.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("seed"), F.col("dst").alias("via"), "kind")
    near = first.select("seed", F.col("via").alias("target"), "kind", F.lit(1).alias("hops"), F.lit(None).cast(edges.schema["src"].dataType).alias("via"))
    far = first.select("seed", "via").distinct().join(both.withColumnRenamed("src", "via"), "via").select("seed", F.col("dst").alias("target"), "kind", F.lit(2).alias("hops"), "via")
    out = near.unionByName(far).join(seeds.withColumnRenamed("id", "target"), "target", "left_anti")
    return out.groupBy("target", "kind", "hops").agg(F.count_distinct(F.coalesce("via", "seed")).alias("n"))
