"""Shared building blocks: cut lineage in the cluster's shared folder, and number rows without a hot task."""

from __future__ import annotations

import json
import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without one gets a folder of its
    own; on a cluster a machine's own disk would not be shared, so that is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours."""
    where, files = _place(spark, path)
    files.delete(where, True)


#: Rows of an Arrow batch, where rows hold whole texts or their shingles.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The setting above belongs to the session, so of the writes that change it one runs at a time.
_ONE_WRITE = threading.Lock()


def _write(spark: SparkSession, write, batch_rows: int | None) -> None:
    if not batch_rows:
        write()
        return
    with _ONE_WRITE:
        before = spark.conf.get(BATCH_ROWS)
        spark.conf.set(BATCH_ROWS, str(batch_rows))
        try:
            write()
        finally:
            spark.conf.set(BATCH_ROWS, before)


def _named(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, files = _place(spark, path)
    files.deleteOnExit(where)
    return path


def keep(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: short lineage that survives lost executors.

    batch_rows: at most so many rows an Arrow batch in this job. Batches pass through direct buffers that grow with
    them, so wide rows need short batches. The table is removed by drop(), or when the application ends."""
    spark = df.sparkSession
    path = _named(spark, name)
    _write(spark, lambda: df.write.parquet(path), batch_rows)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def keep_buckets(df: DataFrame, name: str, key: str, rows: int, batch_rows: int | None = None) -> DataFrame:
    """keep() in hash buckets of `key`: a join on it shuffles the other side only. `rows` is about the number of rows."""
    spark = df.sparkSession
    path = _named(spark, name)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 50_000))
    made = path.rsplit("/", 1)[1].replace("-", "_")
    _write(spark, lambda: df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(made), batch_rows)
    out = spark.table(made)
    out._kept, out._table = path, made
    return out


def drop(*kept: DataFrame) -> None:
    """Delete tables of keep() that nothing reads any more."""
    for df in kept:
        if table := getattr(df, "_table", None):
            df.sparkSession.sql(f"drop table if exists {table}")
        remove(df.sparkSession, df._kept)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as a JSON constant of the plan, so that no row passes through Python on an executor."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = ", ".join(f"{n}: {f.strip().split(' ', 1)[1]}" for n, f in zip(names, schema.split(","), strict=True))
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{kind}>>")).alias("r")).select("r.*")


def spread(rows: int) -> int:
    """Buckets for numbered(): enough that each holds half a million rows at most, and no fewer than 256."""
    return max(256, -(-rows // 500_000))


def numbered(df: DataFrame, by: list[str], key: list[str], weight: str | None = None, buckets: int = 256, seed: int = 0) -> DataFrame:
    """Number the rows of each group in a seeded order that depends on the key columns alone.

    Adds idx (long, from 0 without gaps within `by`) and, with a weight, before (the weights of the rows that come
    earlier in the group). The order is by bucket, then hash, then the key columns, so a group of any size is spread over
    `buckets` tasks; only one row per group and bucket meets in the prefix sum. `by` must hold no nulls. Rows that tie
    in all key columns are interchangeable. Column names that begin with _nr_ are reserved."""
    h = F.xxhash64(F.lit(seed), *key)
    marked = df.withColumn("_nr_h", h).withColumn("_nr_b", F.pmod(F.col("_nr_h"), F.lit(buckets)).cast("int"))
    amount = F.col(weight).cast("long") if weight else F.lit(0).cast("long")
    sums = marked.groupBy(*by, "_nr_b").agg(F.count(F.lit(1)).alias("_nr_n"), F.sum(amount).alias("_nr_w"))
    earlier = Window.partitionBy(*by).orderBy("_nr_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_nr_b", F.coalesce(F.sum("_nr_n").over(earlier), F.lit(0)).alias("_nr_n0"), F.coalesce(F.sum("_nr_w").over(earlier), F.lit(0)).alias("_nr_w0"))
    local = Window.partitionBy(*by, "_nr_b").orderBy("_nr_h", *key)
    out = marked.withColumn("_nr_i", F.row_number().over(local) - 1)
    if weight:
        out = out.withColumn("_nr_c", F.sum(amount).over(local.rowsBetween(Window.unboundedPreceding, 0)) - amount)
    out = out.join(offsets, [*by, "_nr_b"]).withColumn("idx", F.col("_nr_n0") + F.col("_nr_i"))
    if weight:
        out = out.withColumn("before", F.col("_nr_w0") + F.col("_nr_c"))
    return out.drop("_nr_h", "_nr_b", "_nr_i", "_nr_c", "_nr_n0", "_nr_w0")
