"""Sharding that keeps linked documents together: balanced label propagation.

Every document starts with a seeded shard as its label. In each round a document with neighbours (documents of the same
link) wants the shard that holds most of their bytes; equal links form cliques, so all members of a group want the same
one and a group moves whole. A shard admits groups, in a seeded order, while they fit its quota; a group that is refused
votes again in the next round among the shards that still have room then. Groups that are large against the quota are
moved first, the largest first, because only they could be left without a shard that holds them whole. Documents without
neighbours cut no edge wherever they are, so they even out the sizes at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._scale import drop, keep, literal, numbered, spread

#: Groups above this part of a quota are moved one by one: fewer than LARGE times the shards.
LARGE = 512
#: Rounds of votes. Each leaves about a hundredth of the groups waiting; what still waits after the last is dealt level.
ROUNDS = 4


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in rows.groupBy("_shard").agg(F.sum("_size")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _place(units: list[tuple], loads: list[int]) -> list[int]:
    """A shard for each unit (size, wanted shard, ...), in the order given: that of the least load; of several the wanted
    one, else the lowest. Adds to loads."""
    out = []
    for size, want, *_ in units:
        out.append(min(range(len(loads)), key=lambda s: (loads[s], s != want, s)))
        loads[out[-1]] += size
    return out


def _pick(at: Column, ends: list[float]) -> Column:
    """The number of the first end that is at least `at`; shards that end where the one before does are never picked,
    and what lies beyond all ends goes to the last shard with room."""
    last = max((s for s in range(len(ends)) if ends[s] > (ends[s - 1] if s else 0)), default=0)
    shard = F.lit(last)
    for s in reversed(range(len(ends))):
        if ends[s] > (ends[s - 1] if s else 0):
            shard = F.when(at <= ends[s], F.lit(s)).otherwise(shard)
    return shard.cast("int")


def _ends(rooms: list[float]) -> list[float]:
    out, at = [], 0.0
    for room in rooms:
        at += max(0.0, room)
        out.append(at)
    return out


def _fill(rows: DataFrame, loads: list[int], total: int, key: list[str], seed: int, buckets: int) -> DataFrame:
    """Deal rows of together `total` size so that all shards end level: seeded order, cut where a shard is full."""
    level, open_ = 0.0, list(range(len(loads)))
    while True:  # a shard that is over the level takes none; the others share
        level = (sum(loads[s] for s in open_) + total) / len(open_)
        if all(loads[s] <= level for s in open_):
            break
        open_ = [s for s in open_ if loads[s] <= level]
    placed = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], key, "_size", buckets=buckets, seed=seed)
    ends = _ends([level - n for n in loads])
    return placed.withColumn("_shard", _pick(F.col("before") + F.col("_size") / 2, ends)).drop("idx", "before", "_all")


def _propagate(groups: DataFrame, loads: list[int], quota: int, seed: int, buckets: int) -> DataFrame:
    """(_link, _size, _shard: the wanted one) to (_link, _shard) within the quotas; adds to loads."""
    settled, waiting = [], groups
    for turn in range(ROUNDS):
        rooms = [max(0, quota - n) for n in loads]
        # The neighbours' shard if it has room; a refused group votes by a seeded lot, in proportion to the rooms.
        lot = F.pmod(F.xxhash64(F.lit(seed + turn), "_link"), F.lit(1 << 30)) * (sum(rooms) / (1 << 30))
        want = _pick(lot, _ends(rooms))
        if not turn:
            want = F.when(F.col("_shard").isin([s for s, n in enumerate(rooms) if not n]), want).otherwise(F.col("_shard")) if min(rooms) == 0 else F.col("_shard")
        voted = numbered(waiting.withColumn("_shard", want), ["_shard"], ["_link"], "_size", buckets=buckets, seed=seed + turn)
        room = F.element_at(F.array(*map(F.lit, rooms)), F.col("_shard") + 1)
        voted = keep(voted.withColumn("_in", F.col("before") + F.col("_size") <= room).drop("idx", "before"), "votes")
        settled.append(voted.filter("_in").select("_link", "_size", "_shard"))
        waiting = voted.filter("not _in").drop("_in")
        for s, n in enumerate(_loads(settled[-1], len(loads))):
            loads[s] += n
        left = waiting.agg(F.sum("_size")).first()[0]
        if not left:
            break
    else:
        settled.append(keep(_fill(waiting, loads, left, ["_link"], seed, buckets).select("_link", "_size", "_shard"), "rest"))
        for s, n in enumerate(_loads(settled[-1], len(loads))):
            loads[s] += n
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select("_link", "_shard")


def balanced_shards(docs: DataFrame, link: str, size: str, key: list[str], shards: int = 8, seed: int = 5) -> DataFrame:
    """Add shard (int, 0..shards-1; a column of that name is replaced). Documents with the same non-null `link` are
    neighbours; `size` is a positive long; `key` columns tell documents apart (rows that tie in all of them are
    interchangeable). All other columns are kept, whatever their names; an empty table gives no rows.

    No link is cut unless its documents exceed a shard's quota, an equal part of the total; only such a group is split,
    into pieces of a quota. This comes before even sizes, so where large groups do not fit side by side a shard can
    exceed its quota; otherwise sizes differ by the smallest documents or groups. Only the groups above 1/512 of a quota
    (fewer than 512 times the shards) come to the driver."""
    docs = docs.drop("shard")
    keys = [f"_key{i}" for i in range(len(key))]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(link).cast("string").alias("_link"), F.col(size).cast("long").alias("_size"), *[F.col(k).alias(n) for k, n in zip(key, keys, strict=True)])
    rows = keep(held.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(shards)).cast("int")), "docs")
    total, n = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    quota, buckets = -(-total // shards), spread(n)
    # Votes: bytes by link and shard, combined before the shuffle.
    by_shard = rows.filter("_link is not null").groupBy("_link", "_shard").agg(F.sum("_size").alias("w"), F.count(F.lit(1)).alias("k"))
    best = F.max(F.struct("w", F.xxhash64(F.lit(seed), "_link", "_shard").alias("h"), "_shard"))
    groups = by_shard.groupBy("_link").agg(F.sum("w").alias("_size"), F.sum("k").alias("k"), best.alias("best"))
    groups = keep(groups.filter("k > 1").select("_link", "_size", F.col("best._shard").alias("_shard")), "links")
    is_large = F.col("_size") * (LARGE * shards) > total
    large = [(r["_size"], r["_shard"], r["_link"], 0) for r in groups.filter(is_large).collect()]
    beyond = [x for n, _, x, _ in large if n > quota]
    units = [u for u in large if u[0] <= quota]
    is_beyond = F.coalesce(F.col("_link").isin(beyond), F.lit(False)) if beyond else F.lit(False)
    if beyond:
        piece = F.floor((F.col("before") + F.col("_size") / 2) / quota).cast("int")
        pieces = keep(numbered(rows.filter(is_beyond), ["_link"], keys, "_size", buckets=buckets, seed=seed).withColumn("_piece", piece).drop("idx", "before", "_shard"), "pieces")
        units += [(r["n"], -1, r["_link"], r["_piece"]) for r in pieces.groupBy("_link", "_piece").agg(F.sum("_size").alias("n")).collect()]
    units.sort(key=lambda u: (-u[0], *u[2:]))
    loads = [0] * shards
    places = literal(rows.sparkSession, [(x, p, s) for (_, _, x, p), s in zip(units, _place(units, loads), strict=True)], "_link string, _piece int, _shard int")
    small = keep(_propagate(groups.filter(~is_large), loads, quota, seed, buckets), "small")
    # The large groups' rows meet their few places by broadcast, so no task gets a whole one.
    found = rows.filter(~is_beyond).drop("_shard").join(F.broadcast(places.drop("_piece")), "_link", "left")
    rest = found.filter("_shard is null").drop("_shard")
    state = rest.filter("_link is not null").join(small, "_link", "left")
    state = state.unionByName(rest.filter("_link is null").withColumn("_shard", F.lit(None).cast("int"))).unionByName(found.filter("_shard is not null"))
    if beyond:
        state = state.unionByName(pieces.join(F.broadcast(places), ["_link", "_piece"]).drop("_piece"))
    state = keep(state, "groups")
    drop(rows, groups, small)
    linked, single = state.filter("_shard is not null"), state.filter("_shard is null").drop("_shard")
    # Unlinked documents fill up: large ones first, so that small ones level the rest.
    loads, parts = _loads(linked, shards), [linked]
    size_class = F.floor(F.log2("_size")).cast("int")
    by_class, cuts, seen = {r["c"]: r["w"] for r in single.groupBy(size_class.alias("c")).agg(F.sum("_size").alias("w")).collect()}, [], 0
    for c in sorted(by_class):
        seen += by_class[c]
        if len(cuts) < 4 and seen >= shards * 2 ** (c + 2):  # enough below this class's end to level what it leaves
            cuts.append(c)
            seen = 0
    bounds = [None, *reversed(cuts)]
    for i, top in enumerate(bounds):
        lower = bounds[i + 1] if i + 1 < len(bounds) else None
        part = single.filter((F.lit(True) if top is None else size_class <= top) & (F.lit(True) if lower is None else size_class > lower))
        part_total = sum(w for c, w in by_class.items() if (top is None or c <= top) and (lower is None or c > lower))
        if part_total:
            part = keep(_fill(part, loads, part_total, keys, seed, buckets), "level")
            loads = [a + b for a, b in zip(loads, _loads(part, shards), strict=True)]
            parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("_row.*", F.col("_shard").alias("shard"))


def shard_digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Law `bytes`: one row per document with its shard and slot. Null text has size 1 and links to no other; empty
    texts are equal texts; repeated rows are repeated documents; other columns are ignored; an empty table gives no
    rows."""
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.sha2(text, 256).alias("link"))
    placed = keep(balanced_shards(slim, "link", "size", ["doc_id", "text_crc32"], shards), "placed")
    slots = numbered(placed, ["shard"], ["doc_id", "text_crc32"], buckets=spread(placed.count() // shards))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("idx").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
