"""Best-fit packing of token pieces into sequences of fixed capacity.

Best-fit decreasing puts each piece, longest first, into the tightest open sequence that still has room; a segment tree
over the remaining capacities finds that sequence in logarithmic time. There are at most `capacity` different lengths,
so the same packing can be planned from the histogram of lengths: the plan's size depends on the capacity alone, and
every piece finds its place by its number among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._scale import keep, numbered, spread


class Capacities:
    """Segment tree: how many open sequences have each remaining capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        at = remaining + self.size
        while at:
            self.tree[at] += n
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest remaining capacity of at least `need` among the open sequences, or -1."""
        at = need + self.size
        if self.tree[at]:
            return need
        while at > 1 and (at & 1 or not self.tree[at + 1]):  # up until a right sibling has an open sequence
            at >>= 1
        if at <= 1:
            return -1
        at += 1
        while at < self.size:  # down to the leftmost one
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.size


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over (length: count). Rows (length, lo, hi, first, each, base): the pieces of that length
    with numbers lo..hi-1 go, `each` to a sequence, into sequences first, first+1, ... from offset base on."""
    open_runs: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: (first sequence, how many)
    tree, rows, made = Capacities(capacity), [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_runs.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length in sorted(histogram, reverse=True):
        lo, left = 0, histogram[length]
        while left:
            r = tree.tightest(length)
            if r < 0:
                r, each = capacity, capacity // length
                first, n = made, -(-left // each)
                made += n
            else:
                each = r // length
                first, n = open_runs[r].pop()
                tree.add(r, -n)
            full, some = min(n, left // each), 0
            if full < n and left - full * each:
                some = left - full * each
            placed = full * each + some
            rows.append((length, lo, lo + placed, first, each, capacity - r))
            put(r - each * length, first, full)
            put(r - some * length, first + full, 1 if some else 0)
            put(r, first + full + (1 if some else 0), n - full - (1 if some else 0))
            lo, left = lo + placed, left - placed
    return rows


#: Scripts whose letters, digits and spaces all regex engines agree on; other texts take the slower encoder.
_PLAIN = re.compile("[^\n\t\x20-\x7e\xa1-ɏ]")


@lru_cache(2)
def _encoders(path: str):
    """The tokenizer, and where its vocabulary lies beside it as ranks the same vocabulary in a faster encoder."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True  # their strings in a text are ordinary text
    ranks = re.sub(r"\.json$", ".tiktoken", path)
    if not os.path.exists(ranks):
        return slow, None
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return slow, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def encode(text: str, path: str) -> list[int]:
    """Ids of the whole text, without special tokens."""
    slow, fast = _encoders(path)
    return fast.encode_ordinary(text) if fast and not _PLAIN.search(text) else slow.encode(text, add_special_tokens=False).ids


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cutter(path: str, capacity: int, end_id: int):
    """Arrow function from (doc_id, text) to pieces; only texts over `capacity` ids are cut, the first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array(encode(text or "", path) + [end_id], dtype="<u4")
                head = (len(ids) - 1) % capacity + 1
                for piece, start in enumerate([0, *range(head, len(ids), capacity)]):
                    part = ids[start : head if not piece else start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _PIECES, strict=True)], schema=_PIECES)

    return cut


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cutter(path, capacity, end_id), PIECES)


def best_fit(pieces: DataFrame, capacity: int, key: list[str], length: str = "length", buckets: int | None = None) -> DataFrame:
    """Add sequence_id and offset to a kept table of pieces whose lengths are 1..capacity.

    Only the histogram of lengths (at most `capacity` rows) comes to the driver. Pieces that tie in `key` and length are
    interchangeable. Numbering is spread over `buckets` tasks for each length, by default as many as the most
    frequent length needs. An empty table gives no rows."""
    spark = pieces.sparkSession
    rows = pieces.groupBy(length).agg(F.count(F.lit(1)).alias("n")).collect()
    if bad := [r for r in rows if r[0] is None or not 1 <= r[0] <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:3]}")
    places = spark.createDataFrame(plan({r[0]: r["n"] for r in rows}, capacity), f"`{length}` long, lo long, hi long, first long, each long, base long")
    spots = numbered(pieces, [length], key, buckets=buckets or spread(max((r["n"] for r in rows), default=0))).alias("p").join(F.broadcast(places.alias("q")), F.expr(f"p.`{length}` = q.`{length}` and p.idx >= q.lo and p.idx < q.hi"))
    k = F.expr("p.idx - q.lo")
    return spots.select("p.*", (F.col("q.first") + F.floor(k / F.col("q.each"))).cast("long").alias("sequence_id"), (F.col("q.base") + k % F.col("q.each") * F.col(f"q.{length}")).cast("long").alias("offset")).drop("idx")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenize, cut and pack whole documents: one row per piece with its sequence and offset.

    Null text counts as empty (one piece that holds the end id alone); repeated rows are packed as often as they occur;
    other columns are ignored. The pieces are written once to the shared folder, so texts are tokenized once."""
    return best_fit(keep(token_pieces(docs, path, capacity, end_id), "pieces"), capacity, ["doc_id", "piece", "ids_crc32"])
