"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []

#: Unpacked bytes beyond which a stored table is not broadcast, whatever the size of its files: rows by the width that Spark expects of their types and
#: what a place in a hash table takes.
UNPACKED_TO_BROADCAST, PLACE = 32 << 20, 64


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where a session sets none, one on this machine alone (as in tests) gets a temporary
    folder; on a cluster, whose machines would not see it, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        at = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new place under the shared folder; no two calls give the same one."""
    _written.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back: it is computed once, and lost executors lose none of it.

    Spark decides on broadcasts by the size of files, but a few megabytes of compressed keys and nulls can be millions of rows, which the driver
    would gather. So the rows are counted as they are written, and a table that is large unpacked is not broadcast; what it is joined with may be.
    """
    path, seen = fresh_path(df.sparkSession, label), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    unpacked = seen.get.get("rows", 0) * (PLACE + out._jdf.schema().defaultSize())
    return _not_broadcast(out) if unpacked > UNPACKED_TO_BROADCAST else out


def _not_broadcast(df: DataFrame) -> DataFrame:
    """``df`` with Spark's own hint against broadcasts of this side of a join, which has no name in SQL (the hint MERGE would be one against both sides)."""
    jvm = df.sparkSession._jvm
    logical = jvm.org.apache.spark.sql.catalyst.plans.logical
    hint = logical.HintInfo(jvm.scala.Some(getattr(getattr(logical, "NO_BROADCAST_HASH$"), "MODULE$")))
    plan = logical.ResolvedHint(df._jdf.queryExecution().analyzed(), hint)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(df._jdf.sparkSession(), plan), df.sparkSession)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly, where it has fewer partitions than the session has cores: a short file is one partition,
    but long expressions over its rows are work for all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def drop_stored(spark: SparkSession) -> int:
    """Delete what this driver has stored so far; results that still read it can't be read any more. Returns how many."""
    count = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        count += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return count
