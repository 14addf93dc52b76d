"""Intermediate tables: written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, in local runs, a new temporary folder; a cluster needs it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='millrace-')}")
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df written as Parquet, in folders by the columns of by, and read back: what reads it doesn't make it again, a lost
    executor costs nothing, and columns and folders are still pruned."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that a split holds, and so a task has at least where input is large.
SPLIT = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, if it is smaller than a split for each of them: a small file of one row group would be read,
    and worked on, by a single task. Larger input has splits enough and stays as it is, so what is sent is bounded."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if cores > 1 and size < SPLIT * cores else df


#: Bytes, by the statistics of the plan (those of Parquet files as they are packed), of a group of rows by key.
GROUP = 1 << 20
MOST_GROUPS = 1 << 15


def groups(df: DataFrame) -> int:
    """Groups of bounded size that df is dealt into."""
    return max(1, min(-(-int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // GROUP), MOST_GROUPS))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df in n groups by keys, if that is more than the shuffle partitions: their number is fixed in a session, so what a
    task holds, sorts and counts would grow with the input."""
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
