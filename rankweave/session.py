"""Session helpers: shared work folder, size checks before a broadcast."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side is hinted only when it is proven to hold at most this many
# (narrow) rows; beyond it the same join runs as a shuffle join.
MAX_BROADCAST_ROWS = 200_000


def workspace(spark: SparkSession) -> str:
    """Folder for the written tables of this application, below `spark.checkpoint.dir`.

    Only a local-mode session may fall back to a temporary folder; on a cluster
    a machine-local folder would be lost with its machine. The folder goes when the
    driver ends, or earlier by `clear_workspace`.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = f"{(shared or _local_folder()).rstrip('/')}/rankweave-{spark.sparkContext.applicationId}"
    if folder not in _cleared_at_exit:
        _cleared_at_exit.add(folder)
        atexit.register(_clear, spark, folder)
    return folder


def clear_workspace(spark: SparkSession) -> None:
    """Delete all written tables; results that still read them can no longer be used."""
    _clear(spark, workspace(spark))


def _clear(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception as error:  # at exit the session may be gone already
        logging.getLogger(__name__).debug("%s stays: %s", folder, error)


_cleared_at_exit: set[str] = set()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="rankweave-")


def holds_at_most(df: DataFrame, rows: int) -> bool:
    """True when `df` has no more than `rows` rows; reads at most `rows` + 1."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after checking the size; otherwise leave it to AQE."""
    return F.broadcast(df) if holds_at_most(df, rows) else df


def shuffle_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, whoever reads it."""
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that has fewer splits than cores.

    Only such a small input is shuffled; a large one already has its splits.
    For plain table reads: asking a plan with shuffles for its splits runs it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

