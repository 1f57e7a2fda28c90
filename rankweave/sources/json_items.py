"""Reading item files and setting bad rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.schema import RAW_ITEM

SAMPLE_ERRORS = 5


def load_items(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Items with every field a VARIANT.

    JSON Lines splits over tasks; `array` reads files that hold one JSON array
    each, a task per file, and fails on a file that is not JSON. A missing
    path fails the read.
    """
    reader = spark.read.schema(RAW_ITEM)
    if array:
        reader = reader.option("multiLine", True).option("mode", "FAILFAST")
    return reader.json(path)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _absent(v: Column) -> Column:
    return v.isNull() | (_kind(v) == "VOID")


def _is_text(v: Column) -> Column:
    return ~_kind(v).startswith("ARRAY") & ~_kind(v).startswith("OBJECT")


def check_items(raw: DataFrame) -> DataFrame:
    """Typed items with `problem`: null for a good row, else what is wrong.

    Genres must be an array, ids and dates whole numbers or their text, the
    other fields plain values.
    """
    text = lambda name: F.try_variant_get(F.col(name), "$", "string")
    number = lambda name: F.try_variant_get(F.col(name), "$", "bigint")
    bad = F.lit(None).cast("string")
    for name, fine in (
        ("release_date", number("release_date").isNotNull()),
        ("poster", _is_text(F.col("poster"))),
        ("genres", _kind(F.col("genres")).startswith("ARRAY")),
        ("overview", _is_text(F.col("overview"))),
        ("title", _is_text(F.col("title"))),
        ("id", number("id").isNotNull()),
    ):
        bad = F.when(~_absent(F.col(name)) & ~fine, name).otherwise(bad)
    if "_corrupt_record" in raw.columns:
        bad = F.when(F.col("_corrupt_record").isNotNull(), "not JSON").otherwise(bad)
    return raw.select(
        number("id").alias("id"), text("title").alias("title"), text("overview").alias("overview"),
        F.try_variant_get(F.col("genres"), "$", "array<string>").alias("genres"),
        text("poster").alias("poster"), number("release_date").alias("release_date"),
        bad.alias("problem"),
        *[c for c in raw.columns if c not in
          ("id", "title", "overview", "genres", "poster", "release_date", "_corrupt_record")],
    )


def good_items(checked: DataFrame) -> DataFrame:
    return checked.filter("problem IS NULL").drop("problem")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.filter("problem IS NOT NULL")


def error_sample(checked: DataFrame) -> DataFrame:
    """The first few refused rows, for a message."""
    return quarantine(checked).limit(SAMPLE_ERRORS)
