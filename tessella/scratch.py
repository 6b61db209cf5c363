"""Intermediate tables in the shared folder of the cluster: short lineage that survives lost executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without one gets a folder of its own, since a machine's own disk is not
    shared on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def place(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back; the table is removed when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = place(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of the files below the paths: whether a source has changed."""
    import hashlib

    found = []
    for path in paths:
        where, files = place(spark, path)
        listed = files.listFiles(where, True)
        while listed.hasNext():
            s = listed.next()
            found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def parallel(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small input has fewer partitions than these (a single file's row group is one); larger
    inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
