"""Corpus tables: setup, drop, add, upsert, delete."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.vectors import is_valid_vector
from rankweave.schema import CORPUS
from rankweave.session import broadcast_if_small

DIMENSION = 768


def setup(spark: SparkSession, table: str, dim: int = DIMENSION) -> None:
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({CORPUS}) USING parquet TBLPROPERTIES ('vector_size' = '{dim}')"
    )


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def reset(spark: SparkSession, table: str, dim: int = DIMENSION) -> None:
    """Drop, then set up; only a failed setup stops."""
    try:
        drop(spark, table)
    except Exception as error:
        warnings.warn(f"could not drop {table}: {error}")
    setup(spark, table, dim)


def dimension(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table} ('vector_size')").collect()  # one row
    return int(rows[0]["value"])


def split_by_dimension(df: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector fits the column (or is null), and the others."""
    fits = F.col("embedding").isNull() | is_valid_vector(F.col("embedding"), dim)
    return df.filter(fits), df.filter(~fits)


def add_documents(df: DataFrame, table: str) -> DataFrame:
    """Append the documents that fit; return those that do not."""
    good, bad = split_by_dimension(df, dimension(df.sparkSession, table))
    good.select(*df.sparkSession.table(table).columns).write.mode("append").insertInto(table)
    return bad


def newest(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the last by `order`; rows without a key all stay."""
    row = F.struct(*[c for c in df.columns if c != key])
    keyed = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, order).alias("row")).select(key, "row.*")
    return keyed.unionByName(df.filter(F.col(key).isNull())).select(*df.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """Incoming rows replace existing ones of the same key, and earlier incoming ones.

    Of incoming rows with equal keys the one with the largest `order` stays; without
    an order column, the largest row by its values. A small batch is broadcast, so
    adding it does not move the corpus.
    """
    others = [c for c in incoming.columns if c != key]
    incoming = newest(incoming, key, F.col(order) if order else F.struct(*others)).select(*existing.columns)
    keys = broadcast_if_small(incoming.select(key))
    return existing.join(keys, key, "left_anti").unionByName(incoming)


def delete_by_metadata(df: DataFrame, key: str, value: str, column: str = "metadata") -> DataFrame:
    """Rows left after deleting those whose metadata entry equals `value`."""
    entry = F.try_variant_get(F.try_parse_json(column), f"$.{key}", "string")
    return df.filter(~entry.eqNullSafe(value))
