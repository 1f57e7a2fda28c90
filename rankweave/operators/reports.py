"""Counts over corpora, imports and hits; all combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.scalars import release_year


def coverage_report(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Row count and, per (column, name), how many rows have a value."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count(column).alias(name) for column, name in columns.items()]
    )


def import_report(checked: DataFrame) -> DataFrame:
    """Rows read and rows refused; the total counts both."""
    return checked.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("problem").isNotNull()).alias("errors")
    )


def facet_genres(df: DataFrame) -> DataFrame:
    return df.select(F.explode("genres").alias("genre")).groupBy("genre").agg(F.count(F.lit(1)).alias("n"))


def facet_year(df: DataFrame) -> DataFrame:
    return df.select(release_year(F.col("release_date")).alias("year")).groupBy("year").agg(
        F.count(F.lit(1)).alias("n")
    )


def hit_counts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of every query, 0 included."""
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("hits"))
