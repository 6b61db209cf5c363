"""Near duplicates with BagMinHash.

A document is the multiset of its five-word shingles. Each shingle owns a Poisson process over (weight, time): the weight
axis is cut into the dyadic blocks [0,1), [1,2), [2,4), [4,8)..., and a point of a block falls into one of its unit cells
by fair bits, so that a shingle found w times sees the points of the cells below w - the same points in every document.
A point also names one of the signature's components, which keeps its earliest point. Two documents agree in a component
with the probability of their weighted Jaccard similarity. Bands of components give candidates; candidates are verified
by the exact overlap of their multisets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._scale import drop, keep, keep_buckets, literal
from tessella.llm.components import components

SHINGLE, BANDS, ROWS = 5, 28, 5
SIMILAR = (4, 5)  # 0.8
BATCH = 400  # rows of an Arrow batch of texts or bags
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """64-bit hash of each word; as many as fit are remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 100_000:
            self[word] = h
        return h


_hashes = _Hashes()


def bag(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs. A text of fewer words is one shingle; a text without
    words has none."""
    h = np.array(list(map(_hashes.__getitem__, _WORDS.findall(text or ""))), dtype=np.uint64)
    if not len(h):
        return h, np.zeros(0, np.int64)
    k = min(size, len(h))
    s = np.full(len(h) - k + 1, _U(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            s = _mix(s * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(s, return_counts=True)


def occurrences(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: one hash for each occurrence."""
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return np.sort(_mix(np.repeat(shingles, counts) + at.astype(np.uint64) * _U(0xD1B54A32D192ED03)))


def signature(shingles: np.ndarray, counts: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash: m hashes of the earliest points."""
    total = float(counts.sum())
    until = m * (np.log(m) + 4) / total  # nearly always enough points to fill all components
    top = int(counts.max()) - 1
    while True:
        times, ids, slots = [], [], []
        for block in range(top.bit_length() + 1):
            low, width = (1 << block) >> 1, max(1, (1 << block) >> 1)
            chosen = counts > low
            own, weight = shingles[chosen], counts[chosen]
            with np.errstate(over="ignore"):
                seed = _mix(own ^ _mix(np.full(1, block + 1, np.uint64)))
                step = max(2, min(2048, int(until * width) + 2))
                begin, k = np.zeros(len(own)), 0
                while len(own):
                    number = _mix(seed[:, None] + np.arange(k + 1, k + step + 1, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15))
                    gap = -np.log(((number >> _U(11)).astype(np.float64) + 0.5) / 2.0**53) / width
                    t = begin[:, None] + np.cumsum(gap, axis=1)
                    near = t <= until
                    at, number = np.nonzero(near)[0], number[near]
                    mark = _mix(number ^ _U(0xA0761D6478BD642F))
                    hit = low + ((mark >> _U(32)) & _U(width - 1)).astype(np.int64) < weight[at]
                    times.append(t[near][hit])
                    ids.append(number[hit])
                    slots.append(((mark[hit] & _U(0xFFFFFFFF)) * _U(m) >> _U(32)).astype(np.int64))
                    on = t[:, -1] <= until
                    seed, begin, weight, own, k = seed[on], t[on, -1], weight[on], own[on], k + step
        t, i, s = np.concatenate(times), np.concatenate(ids), np.concatenate(slots)
        first = np.argsort(-t, kind="stable")
        out, full = np.zeros(m, np.uint64), np.zeros(m, bool)
        out[s[first]], full[s] = i[first], True
        if full.all():
            return out
        until *= 2


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band, different between bands."""
    bands = sig.reshape(-1, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, len(bands) + 1, dtype=np.uint64)
        for r in range(rows):
            key = _mix(key * _U(0x9E3779B97F4A7C15) + bands[:, r])
    return key


def nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each component, sixteen to a word."""
    low = np.zeros(-(-len(sig) // 16) * 16, np.uint64)
    low[: len(sig)] = sig & _U(15)
    return (low.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * _U(4))).sum(1, dtype=np.uint64)


def _apart(a: str, b: str, words: int = -(-BANDS * ROWS // 16)):
    """In how many components two sketches differ (those that differ in their four bits)."""
    out = F.lit(0)
    for i in range(words):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        out = out + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return out


#: Two alike texts differ in 26 of 140 sketched components on average; in more than this with a probability of 1e-7, far
#: below the share of such pairs that meet in no band (1.5e-5)
MOST_APART = 52


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tkey, text) to (doc_id, tkey, n, bands, sketch)."""
    for batch in batches:
        n, bands, offsets, sketches = [], [], [0], []
        for text in batch.column(2).to_pylist():
            shingles, counts = bag(text)
            n.append(int(counts.sum()))
            sig = signature(shingles, counts) if len(shingles) else np.zeros(BANDS * ROWS, np.uint64)
            bands.append(band_keys(sig) if len(shingles) else np.zeros(1, np.uint64))
            sketches.append(nibbles(sig).view(np.int64))
            offsets.append(offsets[-1] + len(bands[-1]))
        flat = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "tkey", "n", "bands", "sketch"])


#: Bits of a text's marks, in words of 64
MARKS = 16


def marks(bag_: np.ndarray) -> np.ndarray:
    """One bit for each occurrence's hash. A bit that another text lacks stands for an occurrence that it lacks."""
    bits = np.zeros(64 * MARKS, np.uint8)
    bits[(bag_ % _U(64 * MARKS)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _lacking(a: str, b: str):
    """How many bits of a's marks b lacks: so many occurrences of a, at least, are not in b."""
    out = F.lit(0)
    for i in range(MARKS):
        out = out + F.bit_count(F.col(a)[i].bitwiseAND(F.bitwise_not(F.col(b)[i])))
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, text) to (nid, bag, marks): the sorted occurrences and their marks."""
    for batch in batches:
        bags = [occurrences(*bag(text)) for text in batch.column(1).to_pylist()]
        offsets = np.cumsum([0, *map(len, bags)]).astype(np.int32)
        flat = np.concatenate(bags) if bags else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))), pa.array([marks(b) for b in bags], pa.list_(pa.int64()))], ["nid", "bag", "marks"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, bag_a, bag_b) to the pairs of at least the similarity."""
    for batch in batches:
        stay = []
        (x, at_x), (y, at_y) = ((c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
        for i in range(batch.num_rows):
            p, q = x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]]
            p, q = (p, q) if len(p) <= len(q) else (q, p)
            both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(q) else 0
            stay.append(SIMILAR[1] * both >= SIMILAR[0] * (len(p) + len(q) - both))
        yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))


def _own(bags: DataFrame, among: DataFrame) -> DataFrame:
    """(nid, own): how many occurrences of a text no other text of `among` (nid) has."""
    held = bags.join(among, "nid", "left_semi").select("nid", F.explode("bag").alias("h"))
    single = held.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("nid").alias("nid")).filter("k = 1")
    return single.groupBy("nid").agg(F.count(F.lit(1)).alias("own"))


def _relabelled(label: DataFrame, new: DataFrame) -> DataFrame:
    """Components (node, label) after new links: only the components that the links join are walked."""
    known = label
    for side in ("a", "b"):
        new = new.join(known.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")), side, "left").withColumn(f"{side}_label", F.coalesce(f"{side}_label", side))
    new = keep(new, "joined")
    moved = keep(components(new.select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))), "moved")
    ends = new.select(F.col("a").alias("node"), F.col("a_label").alias("label")).unionByName(new.select(F.col("b").alias("node"), F.col("b_label").alias("label")))
    every = label.unionByName(ends).distinct()
    target = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    out = keep(every.join(target, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    drop(new, moved)
    return out


def text_key(text):
    """Names a text; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, class_id, links (verified pairs that the document's text is in), class_size and stays: one row per
    row of `docs`.

    Classes are the connected components of texts whose multisets of five-word shingles are 0.8 or more alike; class_id
    is the smallest doc_id in it (null only if all are null), `stays` marks one row of each class. Null counts as empty;
    texts without words are alike; repeated rows are copies. Other columns are ignored.

    Copies are one node each. In each bucket of a band, leaders are compared with all members that are not connected yet
    and then leave it; a bucket is done when its members are connected or compared. So a bucket of k near copies costs k
    comparisons, not k squared, and no pair of a bucket is skipped unless its texts are connected already, meet in an
    earlier band, or cannot be alike: what a text shares with another is at most its occurrences less those that it has
    alone, or whose mark the other lacks. Past the first wave a sketch of the signatures, too, rules out pairs far from alike; it misses an alike pair
    once in ten million, the bands once in seventy thousand. The number of leaders grows from wave to wave, so a bucket of unlike
    texts takes few waves."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tkey"), F.col("text").cast("string").alias("text"))
    rows = keep(texts.mapInArrow(_sketches, "doc_id long, tkey string, n long, bands array<long>, sketch array<long>"), "sketches", BATCH)
    nodes = keep(rows.groupBy("tkey").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).withColumn("nid", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("nid", "n", F.explode("bands").alias("key"))
    shared = keep(banded.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "shared")
    found = keep(banded.join(shared, "key"), "found")
    drop(shared)
    # The text that meets most others leads: in a group of near copies that is the one in its middle.
    central = found.groupBy("nid").agg(F.sum("k").alias("met"))
    left = keep(found.drop("k").join(central, "nid").withColumn("o", F.col("n")), "buckets")
    drop(found)
    need = keep(left.select("nid").distinct().join(nodes.select("nid", "tkey"), "nid"), "need")
    held = texts.groupBy("tkey").agg(F.any_value("text").alias("text")).join(need, "tkey")
    bags = keep_buckets(held.select("nid", "text").mapInArrow(_bags, "nid long, bag array<long>, marks array<long>"), "bags", "nid", need.count(), BATCH)
    drop(need)
    links = literal(spark, [], "a long, b long")
    label = literal(spark, [], "node long, label long")
    wave, spent = 0, []
    while True:
        marked = left.join(label, left["nid"] == label["node"], "left").select(left["*"], F.coalesce("label", "nid").alias("label"))
        marked = marked.withColumn("salt", F.pmod(F.xxhash64("nid"), F.lit(1 if wave == 0 else 16**wave // 2)))
        columns = ["nid", "n", "o", "label", *(["bands", "sketch", "marks"] if wave else [])]
        ahead = F.max(F.struct("met", *columns)).alias("first")
        heads = keep(marked.groupBy("key", "salt").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), ahead), "heads")
        # Buckets that still join different components.
        mixed = heads.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("key")
        lead = keep(heads.join(mixed, "key").select("key", *[F.col(f"first.{c}").alias(f"leader_{c}") for c in columns]), "leaders")
        if lead.isEmpty():
            break
        done = lead.select("key", F.col("leader_nid").alias("nid"))
        marked = marked.join(lead.select("key").distinct(), "key", "left_semi")
        if wave:  # two leaders of a bucket meet once
            marked = keep(marked.join(done.withColumn("leads", F.lit(True)), ["key", "nid"], "left"), "marked")
        most = F.least("o", "leader_o")  # of what they share
        able = (SIMILAR[0] + SIMILAR[1]) * most >= SIMILAR[0] * (F.col("n") + F.col("leader_n"))
        fit = (F.col("nid") != F.col("leader_nid")) & (F.col("label") != F.col("leader_label")) & able
        if wave:
            fit = fit & (F.col("leads").isNull() | (F.col("nid") > F.col("leader_nid"))) & (_apart("sketch", "leader_sketch") <= MOST_APART) & (F.array_intersect("bands", "leader_bands")[0] == F.col("key"))
            shared = F.least(F.col("n") - _lacking("marks", "leader_marks"), F.col("leader_n") - _lacking("leader_marks", "marks"))  # at most
            fit = fit & ((SIMILAR[0] + SIMILAR[1]) * shared >= SIMILAR[0] * (F.col("n") + F.col("leader_n")))
        tried = marked.join(lead, "key").filter(fit)
        # Each pair once; a leader may be in very many, a member is in few, so members meet their bags without a shuffle
        # of these, and leaders (few texts) by a join that is split where it is skewed.
        met = tried.groupBy(F.least("nid", "leader_nid").alias("a"), F.greatest("nid", "leader_nid").alias("b")).agg(F.min("leader_nid").alias("head"))
        pairs = keep(met.select("a", "b", "head", F.when(F.col("head") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member")), "pairs")
        heads_of = keep(bags.join(pairs.select(F.col("head").alias("nid")).distinct(), "nid", "left_semi"), "leader-bags")
        full = pairs.join(bags.select(F.col("nid").alias("member"), F.col("bag").alias("bag_m")), "member").join(heads_of.select(F.col("nid").alias("head"), F.col("bag").alias("bag_h")), "head")
        new = keep(full.select("a", "b", "bag_m", "bag_h").mapInArrow(_verified, "a long, b long"), "links", BATCH)
        links = links.unionByName(new)
        before, label = label, _relabelled(label, new)
        rest = marked.filter("leads is null").drop("salt", "label", "leads") if wave else marked.drop("salt", "label").join(done, ["key", "nid"], "left_anti")
        if wave == 0:
            rest = keep(rest, "rest")
            spent.append(rest)
            own = keep(_own(bags, rest.select("nid").distinct()), "own")
            spent.append(own)
            rest = rest.join(own, "nid", "left").withColumn("o", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
            # Even a text that lies wholly within this one shares too little where so much of it is its own.
            rest = rest.filter(SIMILAR[1] * F.col("o") >= SIMILAR[0] * F.col("n")).join(nodes.select("nid", "bands", "sketch"), "nid").join(bags.select("nid", "marks"), "nid")
        following = keep(rest, "buckets")
        # Nothing reads this wave's tables any more.
        drop(heads, lead, pairs, heads_of, left, *([marked, before] if wave else []), *spent)
        left, spent = following, []
        wave += 1
    drop(bags, left, heads, lead)
    links = keep(links, "all-links")
    ends = links.select(F.col("a").alias("nid")).unionByName(links.select(F.col("b").alias("nid"))).groupBy("nid").agg(F.count(F.lit(1)).alias("links"))
    named = nodes.select("tkey", "nid").join(label, nodes["nid"] == label["node"], "left").join(ends, "nid", "left")
    named = keep(named.select("tkey", F.coalesce("label", "nid").alias("label"), F.coalesce("links", F.lit(0)).cast("long").alias("links")), "named")
    member = keep(rows.select("doc_id", "tkey").join(named, "tkey").withColumn("rid", F.monotonically_increasing_id()), "members")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("rep")
    best = keep(member.groupBy("label").agg(rep, F.count(F.lit(1)).alias("class_size")), "classes")
    return member.join(best, "label").select("doc_id", "tkey", F.col("rep.doc_id").alias("class_id"), "links", "class_size", (F.col("rid") == F.col("rep.rid")).alias("stays"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without those that repeat another one nearly: one row of each class stays, that of the smallest
    doc_id; of several rows with its id and text the first as JSON text. All columns are kept, whatever their names.

    Null counts as empty; texts without words are alike; a null doc_id comes after all others; an empty table gives no
    rows."""
    picked = keep(near_duplicate_classes(docs).filter("stays").select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey")), "picked")
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_tkey"))
    out = held.alias("h").join(picked.alias("p"), (F.col("h._tkey") == F.col("p._tkey")) & F.col("h._id").eqNullSafe(F.col("p._id")), "left_semi")
    return out.groupBy("_tkey", "_id").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")


def dedup_digest(docs: DataFrame) -> DataFrame:
    """Per document its class, its number of verified links, the size of its class and whether it stays."""
    return near_duplicate_classes(docs).select("doc_id", "class_id", "links", "class_size", "stays")
