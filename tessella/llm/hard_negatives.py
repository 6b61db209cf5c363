"""Hard negatives by exact search in k-means inverted lists with stored centroid radii.

Vectors lie in lists by their nearest centroid, in blocks of bounded size. An anchor visits lists by falling upper bound
<a, c> + |a| r (Cauchy-Schwarz: no member of a list of radius r around c scores more), skips lists that lie outside its
score window, and is done when the bound falls strictly below its k-th score. Visits run in a few rounds, each a join of
blocks of anchors with blocks of vectors, since thresholds are known only after a round; what is left after the last
round is nothing, so the result is exact whatever the centroids are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._scale import keep

#: Bounds of the centroids' fit: rows of the sample (those first by a hash of their id), lists, and Lloyd's steps.
SAMPLE_ROWS, MOST_LISTS, STEPS = 20_000, 512, 8
#: Vectors in a block, anchors in a block, and blocks of anchors that meet one copy of a block of vectors.
BLOCK, ANCHORS, MEET = 512, 256, 16
#: Pairs of blocks in an Arrow batch.
BATCH = 32
#: Lists that an anchor has visited at most after each round; then all that are left.
ROUNDS = (4, 32)
#: Bound of a component (times 256), so that sums over 2^13 dimensions are exact as doubles.
MOST = 1 << 20

ROW = "vec_id long, label long, q array<int>"


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, label (long, moved on by one where vec_id is divisible by 7), q (floor of 256 x) of the rows that take part."""
    whole = F.size("embedding").cast("boolean") & ~F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    q = F.transform("embedding", lambda x: F.when(F.abs(x) < MOST / 256, F.floor(x * 256).cast("int")).otherwise(F.raise_error(F.lit(f"a component is {MOST // 256} or more"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), q.alias("q"))


def centroids(rows: DataFrame, n: int) -> np.ndarray:
    """Lloyd's k-means on the sample; at most MOST_LISTS centroids, about half the root of the number of rows.

    Centroids are whole numbers, so that products with them are exact and an anchor's order of lists is the same in every
    round, however its rows are batched."""
    sample = rows.select("q").orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label").limit(SAMPLE_ROWS).collect()
    width = max((len(r["q"]) for r in sample), default=0)
    x = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        x[i, : len(r["q"])] = r["q"]
    x = np.unique(x, axis=0)
    k = min(len(x), max(8, min(MOST_LISTS, int(n**0.5 / 2))))
    c = x[np.random.default_rng(0).choice(len(x), k, replace=False)] if len(x) else x
    for _ in range(STEPS):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1) if len(x) else np.zeros(0, int)
        n_near = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n_near[:, None] > 0, sums / np.maximum(n_near, 1)[:, None], c)
    return np.rint(c)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros (which leaves their products as they are)."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = max(int(lengths.max(initial=0)), width or 0)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _fit_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (a, b))


def _assigned(rows: DataFrame, sent) -> DataFrame:
    """Each row with its list and its distance from the centroid."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = _fit_width(_matrix(batch.column(2)), sent.value)
            near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
            away = np.sqrt(((x - c[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away)], names=["vec_id", "label", "q", "list", "away"])

    return rows.mapInArrow(assign, f"{ROW}, list int, away double")


def _struct(*columns: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*columns)))


class Index:
    """Kept inverted lists: blocks (list, part, members sorted by id) and statistics of the lists."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.rows = keep(rows.dropDuplicates(["vec_id", "label", "q"]), "vectors")
        n = self.rows.count()
        self.centroids = centroids(self.rows, n)
        self.sent = spark.sparkContext.broadcast(self.centroids)
        placed = keep(_assigned(self.rows, self.sent), "lists") if n else self.rows.withColumn("list", F.lit(0)).withColumn("away", F.lit(0.0))
        found = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()  # MOST_LISTS rows
        self.sizes = {r["list"]: (r["n"], r["r"]) for r in found}
        self.parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, (m, _) in self.sizes.items() for x in (i, -(-m // BLOCK))]), F.col("list")), F.lit(1)) if found else F.lit(1)
        parted = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), self.parts).cast("int"))
        self.blocks = keep(parted.groupBy("list", "part").agg(_struct("vec_id", "label", "q").alias("members")), "blocks")


def _visits(asks: DataFrame, index: Index, lo: int, hi: int) -> DataFrame:
    """Rows (list, anchor_id, label, q, windows) of the lists at places lo..hi-1 of each anchor's order that its windows
    may need. windows: array of (id, least, most, kth): scores wanted, and the k-th best one so far or null."""
    sent = index.sent
    known = sorted(index.sizes)
    radii = np.array([index.sizes[i][1] for i in known])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            a, c = _fit_width(_matrix(batch.column(2)), sent.value)
            middle = a @ c[known].T
            slack = np.sqrt((a * a).sum(1))[:, None] * radii + 1e-9 * np.abs(middle) + 1
            upper, lower = middle + slack, middle - slack
            order = np.argsort(-upper, axis=1, kind="stable")[:, lo:hi]
            upper, lower = np.take_along_axis(upper, order, 1), np.take_along_axis(lower, order, 1)
            windows = batch.column(3)
            w = windows.flatten()
            owner = np.repeat(np.arange(batch.num_rows), windows.value_lengths().to_numpy(zero_copy_only=False))
            need = np.maximum(w.field("least").to_numpy(zero_copy_only=False), w.field("kth").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
            fits = (upper[owner] >= need[:, None]) & (lower[owner] <= w.field("most").to_numpy(zero_copy_only=False)[:, None])
            wanted = np.zeros(order.shape, bool)
            np.logical_or.at(wanted, owner, fits)
            row, place = np.nonzero(wanted)
            lists = pa.array(np.array(known, np.int32)[order[row, place]])
            yield pa.RecordBatch.from_arrays([lists, *[col.take(pa.array(row)) for col in batch.columns]], names=["list", "anchor_id", "label", "q", "windows"])

    return asks.mapInArrow(visit, f"list int, anchor_id long, label long, q array<int>, windows {WINDOWS}")


WINDOWS = "array<struct<id:long,least:long,most:long,kth:long>>"
HITS = "anchor_id long, anchor_label long, window long, vec_id long, label long, score long"


def _scorer(same: bool, k: int):
    """Arrow function from (anchors, members) blocks to the best k members of each window: of the anchor's own label but
    for the anchor itself, or of other labels."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                anchors, members = batch.column(0)[i].values, batch.column(1)[i].values
                a, x = _fit_width(_matrix(anchors.field("q")), _matrix(members.field("q")))
                exact = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] < 2**53
                s = (a.astype(float) @ x.T.astype(float)).astype(np.int64) if exact else a @ x.T
                ids, labels = (members.field(f).to_numpy(zero_copy_only=False) for f in ("vec_id", "label"))
                own, of = (anchors.field(f).to_numpy(zero_copy_only=False) for f in ("anchor_id", "label"))
                fits = (labels == of[:, None]) == same
                if same:
                    me, it = np.nonzero(ids == own[:, None])
                    fits[me, it] &= (x[it] != a[me]).any(1)
                s[~fits] = -(2**62)
                order = np.argsort(-s, axis=1, kind="stable")  # members come sorted by id
                s = np.take_along_axis(s, order, 1)
                windows = anchors.field("windows")
                w = windows.flatten()
                row = np.repeat(np.arange(len(own)), windows.value_lengths().to_numpy(zero_copy_only=False))
                most, least = (w.field(f).to_numpy(zero_copy_only=False)[:, None] for f in ("most", "least"))
                at = (s[row] > most).sum(1)[:, None] + np.arange(k)
                inside = np.minimum(at, s.shape[1] - 1)
                got = s[row[:, None], inside]
                one, place = np.nonzero((at < s.shape[1]) & (got >= least) & (got > -(2**62)))
                hit = order[row[one], at[one, place]]
                out = [own[row[one]], of[row[one]], w.field("id").to_numpy(zero_copy_only=False)[one], ids[hit], labels[hit], got[one, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["anchor_id", "anchor_label", "window", "vec_id", "label", "score"])

    return score


def _met(visits: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """Blocks of visiting anchors against blocks of vectors; both bounded, hot lists in many of them."""
    visits = keep(visits, "visits")
    found = {r["list"]: r["n"] for r in visits.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not found:
        return visits.sparkSession.createDataFrame([], HITS)
    number = lambda of: F.element_at(F.create_map(*[F.lit(x) for i, m in found.items() for x in (i, max(1, -(-m // of)))]), F.col("list"))
    block = F.pmod(F.xxhash64("anchor_id", "label"), number(ANCHORS)).cast("int")
    anchors = visits.withColumn("block", block).groupBy("list", "block").agg(F.collect_list(F.struct("anchor_id", "label", "q", "windows")).alias("anchors"))
    anchors = anchors.withColumn("meet", F.col("block") % number(ANCHORS * MEET)).withColumn("part", F.explode(F.sequence(F.lit(0), index.parts - 1)))
    members = index.blocks.where(F.col("list").isin(list(found))).withColumn("meet", F.explode(F.sequence(F.lit(0), number(ANCHORS * MEET) - 1)))
    pairs = anchors.join(members, ["list", "part", "meet"]).select("anchors", "members")
    return pairs.mapInArrow(_scorer(same, k), HITS)


KEY = ["anchor_id", "anchor_label", "window"]


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), "vec_id", "label")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def search(asks: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """The best k of every window of every anchor (anchor_id, label, q, windows); exact."""
    lists = len(index.sizes)
    bounds = [0, *[r for r in ROUNDS if r < lists], lists]
    asks, best = keep(asks, "asks"), None
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        hits = _met(_visits(asks, index, lo, hi), index, same, k)
        best = keep(_best(hits if best is None else hits.unionByName(best.drop("place")), k), "best", BATCH)
        if hi < lists:
            kth = best.where(F.col("place") == k).select("anchor_id", F.col("anchor_label").alias("label"), F.col("window").alias("id"), F.col("score").alias("kth"))
            open_ = asks.select("anchor_id", "label", "q", F.explode("windows").alias("w")).select("anchor_id", "label", "q", "w.id", "w.least", "w.most")
            windows = open_.join(kth, ["anchor_id", "label", "id"], "left").groupBy("anchor_id", "label", "q").agg(F.collect_list(F.struct("id", "least", "most", "kth")).alias("windows"))
            asks = keep(windows, "asks")
    return best if best is not None else asks.sparkSession.createDataFrame([], f"{HITS}, place int")


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 5) -> DataFrame:
    """For each anchor and each of its first positives the first k negatives whose score lies in [0.8 p, p].

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Rows with a null id, a null label, a null
    vector, an empty one or a component that is null or not finite take no part; components of 4,096 and more are
    refused. Vectors of unlike lengths count as filled up with zeros. Repeated rows (same id, label and components) count
    once; other rows that share an id are rows of their own, ties among them go to the smaller label, and an anchor's id
    and label name it. Other columns are ignored. Empty tables and tables without anchors give no rows."""
    index = Index(quantized(vectors))
    anchors = index.rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "q")
    low, high = F.lit(-(2**61)), F.lit(2**61)
    one = F.array(F.struct(F.lit(0).cast("long").alias("id"), low.alias("least"), high.alias("most"), F.lit(None).cast("long").alias("kth")))
    good = search(anchors.withColumn("windows", one), index, True, positives)
    least = F.expr("cast(ceil(cast(80 as decimal(4,0)) * score / 100) as long)")
    wanted = good.groupBy("anchor_id", F.col("anchor_label").alias("label")).agg(F.collect_list(F.struct(F.col("place").cast("long").alias("id"), least.alias("least"), F.col("score").alias("most"), F.lit(None).cast("long").alias("kth"))).alias("windows"))
    bad = search(anchors.join(wanted, ["anchor_id", "label"]), index, False, k)
    pairs = bad.alias("n").join(good.alias("p"), F.expr("n.anchor_id = p.anchor_id and n.anchor_label = p.anchor_label and n.window = p.place"))
    return pairs.select("n.anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("n.place").cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


ORACLE = r"""
with rows as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) q
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select a.vec_id anchor_id, a.label own, b.vec_id, b.label, list_inner_product(a.q, b.q)::bigint score
  from rows a join rows b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
good as (select * from scored where label = own qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
found as (
  select g.anchor_id, g.vec_id positive_id, s.vec_id negative_id, g.score positive_score, s.score negative_score,
    row_number() over (partition by g.anchor_id, g.vec_id order by s.score desc, s.vec_id) as rank
  from good g join scored s on s.anchor_id = g.anchor_id and s.label <> s.own
   and 80 * g.score <= 100 * s.score and 100 * s.score <= 100 * g.score)
select anchor_id, positive_id, rank::integer rank, negative_id, positive_score, negative_score from found where rank <= 5
"""
