"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold their text). On that small graph, word
capacity flows from patterns to source quotas; every further repetition of a pattern's words costs more, so repetition is
spread thinly: a source takes what it shares with no other first, where others repeat the shared texts. Within a pattern,
documents are then taken in a seeded order up to the pattern's flow.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable, Sequence
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._scale import WORD, keep, literal, numbered, spread

#: The graph is solved on the driver; more patterns or sources than this are refused rather than collected. README has
#: the solver's time at this size.
MOST_PATTERNS = 100_000
#: Candidates of each power of two that may fill what a cell's last pass leaves.
SPARE = 8


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Each source's quota: `share` of all sizes by weight (repeating over the sources by code point, null last); what
    exceeds `most` times a source's size is shared again by weight among the others."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


class _Network:
    """Min-cost max-flow by successive distances: all paths of one length are filled together, so there are as many
    searches as there are different lengths, not as many as paths. Costs are whole and not negative."""

    def __init__(self):
        self.out: list[list[int]] = []
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):  # the reverse edge is its neighbour
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, e: int) -> int:
        return self.room[e ^ 1]

    def _distances(self, start: int, height: list[int]) -> list[int | None]:
        found: list[int | None] = [None] * len(self.out)
        queue = [(0, start)]
        best = {start: 0}
        while queue:
            d, a = heappop(queue)
            if found[a] is not None:
                continue
            found[a] = d
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e] > 0 and found[b] is None:
                    n = d + self.cost[e] + height[a] - height[b]
                    if n < best.get(b, 1 << 62):
                        best[b] = n
                        heappush(queue, (n, b))
        return found

    def _levels(self, start: int, height: list[int]) -> list[int]:
        level = [-1] * len(self.out)
        level[start] = 0
        queue = deque([start])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e] > 0 and level[b] < 0 and self.cost[e] + height[a] == height[b]:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def _push(self, start: int, end: int, height: list[int], level: list[int]) -> None:
        at = [0] * len(self.out)
        path: list[int] = []
        a = start
        while True:
            if a == end:
                n = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= n
                    self.room[e ^ 1] += n
                cut = next(i for i, e in enumerate(path) if not self.room[e])
                a = self.to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[a] < len(self.out[a]):
                e = self.out[a][at[a]]
                b = self.to[e]
                if self.room[e] > 0 and level[b] == level[a] + 1 and self.cost[e] + height[a] == height[b]:
                    break
                at[a] += 1
            else:
                if a == start:
                    return
                a = self.to[path.pop() ^ 1]
                at[a] += 1
                continue
            path.append(e)
            a = b

    def run(self, start: int, end: int) -> None:
        height = [0] * len(self.out)
        while True:
            found = self._distances(start, height)
            if found[end] is None:
                return
            far = max(d for d in found if d is not None)
            height = [h + (far if d is None else d) for h, d in zip(height, found, strict=True)]
            while (level := self._levels(start, height))[end] >= 0:
                self._push(start, end, height, level)


def route(passes: dict[Hashable, list[int]], rooms: dict[tuple, int], quota: dict) -> dict[tuple, int]:
    """Words that each pattern gives to each source: rooms is (pattern, source) to the most; a pattern's r-th pass has
    passes[pattern][r] words and costs r a word. All quotas are met as far as rooms and passes allow, at the least cost."""
    net = _Network()
    start, end = net.node(), net.node()
    source = {s: net.node() for s in quota}
    for s, n in source.items():
        net.edge(n, end, round(quota[s]), 0)
    pattern = {p: net.node() for p in passes}
    for p, n in pattern.items():
        for r, words in enumerate(passes[p]):
            net.edge(start, n, words, r)
    edges = {(p, s): net.edge(pattern[p], source[s], n, 0) for (p, s), n in rooms.items()}
    net.run(start, end)
    return {k: net.used(e) for k, e in edges.items()}


def flow(capacity: dict[str, int], member: dict[str, list], quota: dict, repeats: int = 2) -> dict[str, int]:
    """Words that each pattern gives, where every source of a pattern may draw on all of its words, `repeats` times."""
    found = route({p: [n] * repeats for p, n in capacity.items()}, {(p, s): n * repeats for p, n in capacity.items() for s in member[p]}, quota)
    out = dict.fromkeys(capacity, 0)
    for (p, _), n in found.items():
        out[p] += n
    return out


def widening(once: int, most: int) -> list[int]:
    """Passes over `once` different words up to `most` words in all: one, one, two, four... times, so that the number of
    passes (and of edges) stays small for texts with very many copies and every one still costs more than the last."""
    out, left, width = [], most, 1
    while left > 0:
        n = min(left, max(1, once) * width)
        out.append(n)
        left -= n
        width = 1 if len(out) < 2 else width * 2
    return out


def _cell(*names: str) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), F.col(n)), F.lit("n")) for n in names])


def mix(docs: DataFrame, members: str, size: str, key: list[str], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17, home: str | None = None, alike: str | None = None) -> DataFrame:
    """Add copies (int): how often the mix takes the document, 0..repeats.

    `members` is an array of source names (null is a name; repeats in it count once), `size` a number of words, `key`
    columns that tell documents apart. A document in no source is never taken. Rows that tie in key, members and size
    are interchangeable. Other columns are kept; columns named copies or _mix_... are replaced.

    Without `home` any source of its pattern may draw on a document. With it a document counts for that source alone, its
    members are all sources that hold its text, and `alike` is the number of rows with its text: taking several of them
    repeats the same words. Sources then come near their targets one by one: what rounding leaves in patterns that
    sources share is made up in the source's largest cell, and by whole passes over other cells where that is full."""
    spark = docs.sparkSession
    docs = docs.drop("copies", "_mix_pattern", "_mix_home", "_mix_cell")
    pattern = F.to_json(F.sort_array(F.array_distinct(F.coalesce(F.col(members), F.array().cast("array<string>")))))
    docs = docs.withColumn("_mix_pattern", pattern).withColumn("_mix_home", F.col(home) if home else F.lit(None).cast("string"))
    docs = docs.withColumn("_mix_cell", _cell("_mix_pattern", "_mix_home"))
    once = F.sum(F.col(size) / F.col(alike)) if alike else F.sum(size)
    found = docs.groupBy("_mix_cell", "_mix_pattern", "_mix_home").agg(F.sum(size).alias("words"), once.cast("double").alias("once"), F.first(members).alias("of"), F.count(F.lit(1)).alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    found.sort(key=lambda r: r["_mix_cell"])  # ties of equal cost are broken by this order alone
    named = lambda r: sorted(set(r["of"] or []), key=lambda s: (s is None, s))
    words = {r["_mix_cell"]: r["words"] or 0 for r in found}
    sizes: dict[str | None, int] = {}
    for r in found:
        for s in [r["_mix_home"]] if home else named(r):
            sizes[s] = sizes.get(s, 0) + (r["words"] or 0)
    quota = targets(sizes, weights, share, repeats)
    taken = dict.fromkeys(words, 0)
    if home:
        alone, most = {}, {}
        for r in found:
            p = r["_mix_pattern"]
            alone[p] = alone.get(p, 0.0) + (r["once"] or 0.0)
            most[p] = most.get(p, 0) + repeats * (r["words"] or 0)
        given = route({p: widening(round(alone[p]), most[p]) for p in alone}, {(r["_mix_pattern"], r["_mix_home"]): repeats * (r["words"] or 0) for r in found}, quota)
        taken = {r["_mix_cell"]: given[r["_mix_pattern"], r["_mix_home"]] for r in found}
    else:
        given = flow({r["_mix_pattern"]: r["words"] or 0 for r in found}, {r["_mix_pattern"]: named(r) for r in found}, quota, repeats)
        taken = {r["_mix_cell"]: given[r["_mix_pattern"]] for r in found}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("_mix_cell").alias("_cell"), F.col(size).cast("long").alias("_n"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate([*key, size])])
    order = keep(numbered(rows, ["_cell"], [f"_key{i}" for i in range(len(key) + 1)], "_n", buckets=spread(max((r["n"] for r in found), default=0)), seed=seed).withColumnRenamed("idx", "_idx").withColumnRenamed("before", "_before"), "order")

    group = {r["_mix_cell"]: ("n" if r["_mix_home"] is None else "v" + r["_mix_home"]) if home else r["_mix_cell"] for r in found}

    def chosen(cells) -> DataFrame:
        cut = [(c, group[c], *(divmod(taken[c], words[c]) if words[c] else (0, 0))) for c in cells]
        plan = literal(spark, cut, "_cell string, _group string, _base long, _rest long")
        return order.join(F.broadcast(plan), "_cell").withColumn("_in", F.col("_before") + F.col("_n") <= F.col("_rest"))

    whole = lambda df: {r[0]: r[1] for r in df.groupBy("_cell").agg(F.sum(F.when(F.col("_in"), F.col("_n")).otherwise(0) + F.col("_base") * F.col("_n"))).collect()}
    wanted = dict(taken)
    if home:
        cells: dict = {}
        for r in found:
            cells.setdefault(r["_mix_home"], []).append((r["words"] or 0, r["_mix_cell"]))
        wanted = {group[max(x)[1]]: round(quota[s]) for s, x in cells.items()}
        main = {max(x)[1] for x in cells.values()}
        if small := [c for c in words if c not in main]:
            got = whole(chosen(small))
            for s, held in cells.items():
                c = max(held)[1]
                others = {o: got.get(o, 0) for _, o in held if o != c}
                while (over := round(quota[s]) - sum(others.values()) - repeats * words[c]) > 0:  # more than the largest cell has
                    steps = [((n // words[o] + 1) * words[o] - n, o) for o, n in others.items() if words[o] and n < repeats * words[o]]
                    if not steps:
                        break
                    step, o = min((x for x in steps if x[0] >= over), default=max(steps))
                    others[o] += step
                    taken[o] = others[o]  # whole passes, so nothing is rounded there
                taken[c] = min(max(0, round(quota[s]) - sum(others.values())), repeats * words[c])
    picked = chosen(words)
    # What is left below a source's target is filled from its remaining documents, large ones first, and at last by the
    # smallest of them that oversteps it by less than what is missing: a few candidates for each power of two are enough.
    # The limit by rank is applied before the shuffle.
    spare = picked.filter(~F.col("_in") & (F.col("_n") > 0) & (F.col("_base") < repeats))
    nth = F.row_number().over(Window.partitionBy("_group", "level").orderBy("_idx", "_cell"))
    spare = spare.select("_group", "_cell", "_idx", "_n", F.floor(F.log2("_n")).alias("level")).withColumn("nth", nth).filter(F.col("nth") <= SPARE).collect()
    gap = dict(wanted)
    for c, n in whole(picked).items():
        gap[group[c]] -= n
    more, last = set(), {}
    for r in sorted(spare, key=lambda r: (-r["level"], r["_group"], r["nth"])):
        if r["_n"] <= gap[r["_group"]]:
            gap[r["_group"]] -= r["_n"]
            more.add((r["_cell"], r["_idx"]))
    for r in spare:
        g = r["_group"]
        if (r["_cell"], r["_idx"]) not in more and gap[g] < r["_n"] < 2 * gap[g]:
            last[g] = min(last.get(g, (r["_n"], r["_cell"], r["_idx"])), (r["_n"], r["_cell"], r["_idx"]))
    more = [(c, i, 1) for c, i in sorted(more)] + [(c, i, 1) for _, c, i in last.values()]
    out = picked.join(F.broadcast(literal(spark, more, "_cell string, _idx long, _more int")), ["_cell", "_idx"], "left")
    copies = F.col("_base") + F.when(F.col("_in"), 1).otherwise(F.coalesce("_more", F.lit(0)))
    copies = F.when(F.col("_n") > 0, copies).otherwise(0).cast("int")
    return out.select("_row.*", copies.alias("copies")).drop("_mix_pattern", "_mix_home", "_mix_cell")


def with_members(rows: DataFrame, text: str, source: str, size: str) -> DataFrame:
    """Add members (the sources that hold the row's text, nulls as a name) and alike (rows with its text). `text` names
    the text (a hash); `size` its words: texts without any are alone, whatever their number.

    Copies are counted before the shuffle. The few texts with more than a thousandth of the rows meet theirs by broadcast
    (so there are fewer than a thousand of them), the others by a join on the text."""
    real = rows.filter(F.col(size) > 0)
    held = keep(real.groupBy(F.col(text).alias("_text")).agg(F.collect_set(F.struct(F.col(source).alias("s"))).alias("_of"), F.count(F.lit(1)).alias("_k")).filter("_k > 1"), "texts")
    often = F.col("_k") * 1000 > rows.count()
    facts = held.select("_text", F.transform("_of", lambda x: x["s"]).alias("_of"), "_k")
    hot = rows.join(F.broadcast(facts.filter(often)), F.col(text) == F.col("_text"), "left")
    done = hot.filter("_text is not null")
    rest = hot.filter("_text is null").drop("_text", "_of", "_k").join(facts.filter(~often), F.col(text) == F.col("_text"), "left")
    both = done.unionByName(rest)
    many = F.col("_text").isNotNull() & (F.col(size) > 0)
    return both.withColumn("members", F.when(many, F.col("_of")).otherwise(F.array(source))).withColumn("alike", F.when(many, F.col("_k")).otherwise(F.lit(1))).drop("_text", "_of", "_k")


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per document with its source's size and target and the words that the mix takes from it.

    Null text counts as empty (never taken), null source as a source of its own, last in order; repeated rows are taken
    one by one; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    sized = keep(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("crc"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("text")), "sized")
    found = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("size")).limit(MOST_PATTERNS + 1).collect()}
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sources")
    quota = targets(found)
    known = literal(spark, [(s, found[s], quota[s]) for s in found], "source string, source_size long, target double")
    held = keep(with_members(sized, "text", "source", "size").drop("text"), "members")
    mixed = mix(held, "members", "size", ["doc_id", "crc"], home="source", alike="alike")
    return mixed.alias("m").join(F.broadcast(known.alias("k")), F.expr("m.source <=> k.source")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it: not at all, once or twice. All columns are kept.

    Null text counts as empty (never taken); null source is a source of its own; rows with equal doc_id, text and source
    share what the mix takes of them, in the order of their other columns; an empty table gives no rows. Texts are
    shuffled once: the mix works on hashes and sizes."""
    text, source = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("source").cast("string")
    known = F.unhex(F.sha2(text, 256))
    name = F.unhex(F.sha2(F.concat_ws("\x1f", F.hex(known), F.coalesce(F.concat(F.lit("v"), F.col("doc_id").cast("string")), F.lit("n")), F.coalesce(F.concat(F.lit("v"), source), F.lit("n"))), 256))
    slim = keep(docs.select(name.alias("name"), source.alias("source"), word_count(text).alias("size"), known.alias("text")), "slim")
    held = keep(with_members(slim, "text", "source", "size").drop("text"), "members")
    taken = mix(held, "members", "size", ["name"], home="source", alike="alike")
    taken = keep(taken.groupBy("name").agg(F.sum("copies").alias("_c"), F.count(F.lit(1)).alias("_k")), "taken")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), name.alias("name"))
    once = rows.join(taken.filter("_k = 1 and _c > 0"), "name").select("_row", F.col("_c").alias("_n"))
    # Repeated rows are few, but may all be of one kind: numbered() spreads them.
    twins = rows.join(taken.filter("_k > 1 and _c > 0"), "name").withColumn("_json", F.to_json("_row"))
    twins = numbered(twins, ["name"], ["_json"]).select("_row", (F.floor(F.col("_c") / F.col("_k")) + F.when(F.col("idx") < F.col("_c") % F.col("_k"), 1).otherwise(0)).alias("_n"))
    return once.unionByName(twins).filter("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")
