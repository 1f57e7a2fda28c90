"""Incremental import: new item files become batches of a table.

Each micro-batch writes its own `batch_id` folder and a retried batch
overwrites just that, so the import is idempotent and never rewrites earlier
data. Readers take the newest version of each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.schema import RAW_ITEM
from rankweave.sources.corpus_store import newest


ARRIVAL = "arrival"


def stream_items(spark: SparkSession, source: str, files_per_batch: int = 10) -> DataFrame:
    """`files_per_batch` bounds a batch, in files. `arrival` orders rows by file time, file and place in it."""
    arrival = F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    rows = spark.readStream.schema(RAW_ITEM).option("maxFilesPerTrigger", files_per_batch).json(source)
    return rows.select("*", arrival.alias(ARRIVAL))


def import_available(stream: DataFrame, target: str, checkpoint: str,
                     check: Callable[[DataFrame], DataFrame], refused: str | None = None) -> None:
    """Process all files present, batch by batch, and stop.

    `check` gives each row a `problem`, null for a good one. Good rows go to
    `target`; the others to `refused`, where they can be counted and looked at.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if ARRIVAL in batch.columns:
            batch = batch.withColumn(ARRIVAL, F.struct(f"{ARRIVAL}.*", F.monotonically_increasing_id().alias("row")))
        checked = check(batch)
        checked.filter("problem IS NULL").drop("problem").write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        if refused:
            checked.filter("problem IS NOT NULL").write.mode("overwrite").parquet(f"{refused}/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_rows(spark: SparkSession, target: str, key: str) -> DataFrame:
    """Newest version of every key: of the last batch, and there the last to arrive.

    Rows without a key have no versions: all of them stay.
    """
    rows = spark.read.parquet(target)
    order = [c for c in ("batch_id", ARRIVAL) if c in rows.columns]
    return newest(rows, key, F.struct(*order)).drop(*order)


def compact(spark: SparkSession, target: str, compacted: str, key: str) -> DataFrame:
    """The newest versions as a table of their own, so that readers need not group all batches."""
    current_rows(spark, target, key).write.mode("overwrite").parquet(compacted)
    return spark.read.parquet(compacted)
