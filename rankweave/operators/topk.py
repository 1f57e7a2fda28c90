"""Ranking. Scores are rounded before they are compared and ties fall back to
the document id, so the order does not depend on partitions or on summation
order. Per-query windows run as a group limit: each task keeps k rows per
query before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)


def top_k(df: DataFrame, k: int | None, score: str = "score", by: str = "query_id",
          doc: str = "doc_id", descending: bool = True) -> DataFrame:
    """Add `rank` (1 first) per query and keep the first k; k None keeps all."""
    order = F.desc(score) if descending else F.asc(score)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, doc)))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def best(df: DataFrame, k: int, score: str = "score", doc: str = "doc_id") -> DataFrame:
    """Global top k without a window: one `TakeOrderedAndProject`."""
    return df.orderBy(F.desc(score), doc).limit(k)


def sort_by_field(df: DataFrame, field: str, doc: str = "doc_id", descending: bool = False) -> DataFrame:
    return df.orderBy(F.desc(field) if descending else F.asc(field), doc)
