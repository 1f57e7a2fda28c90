"""Joining items to enrichment payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import enrichment
from rankweave.functions.scalars import no_strings


def nest_payload(keywords: DataFrame, cast: DataFrame, crew: DataFrame) -> DataFrame:
    """Payload per item from flat rows (item_id, ord, ...).

    An item may own a third of all rows, so a group limit keeps only what the
    reductions can use before anything is collected: the first named keywords,
    the first cast members, the first director.
    """
    kind = lambda name: F.lit(name).alias("kind")
    null = F.lit(None).cast("string")
    rows = (
        keywords.filter("name IS NOT NULL").select("item_id", "ord", kind("keyword"), "name", null.alias("role"))
        .unionByName(cast.select("item_id", "ord", kind("cast"), "name", F.col("character").alias("role")))
        .unionByName(crew.filter("job = 'Director'").select("item_id", "ord", kind("crew"), "name", F.col("job").alias("role")))
    )
    place = F.row_number().over(Window.partitionBy("item_id", "kind").orderBy("ord"))
    most = F.when(F.col("kind") == "keyword", enrichment.MAX_KEYWORDS).when(
        F.col("kind") == "cast", enrichment.MAX_CAST).otherwise(1)
    kept = (
        rows.withColumn("place", place)
        .filter(F.col("place") <= max(enrichment.MAX_KEYWORDS, enrichment.MAX_CAST))
        .filter(F.col("place") <= most)
    )

    def collected(kind, *fields):
        entry = F.when(F.col("kind") == kind, F.struct("place", "name", "role"))
        return F.transform(
            F.sort_array(F.collect_list(entry)),
            lambda e: F.struct(*[e[column].alias(alias) for column, alias in fields]),
        )

    nested = kept.groupBy("item_id").agg(
        collected("keyword", ("name", "name")).alias("k"),
        collected("cast", ("name", "name"), ("role", "character")).alias("a"),
        collected("crew", ("role", "job"), ("name", "name")).alias("w"),
    )
    return nested.select(
        "item_id",
        F.struct(
            F.struct(F.col("k").alias("keywords")).alias("keywords"),
            F.struct(F.col("a").alias("cast"), F.col("w").alias("crew")).alias("credits"),
        ).alias("payload"),
    )


def reduce_payload(payloads: DataFrame) -> DataFrame:
    payload = F.col("payload")
    return payloads.select(
        "item_id",
        enrichment.keywords(payload).alias("keywords"),
        enrichment.characters(payload).alias("characters"),
        enrichment.director(payload).alias("director"),
    )


def enrich(items: DataFrame, payloads: DataFrame) -> DataFrame:
    """Left join: an item without enrichment keeps empty lists and no director.

    Items without an id match nothing and stay out of the join, where they
    would all meet in one partition.
    """
    found = reduce_payload(payloads)
    known = items.filter("id IS NOT NULL").join(found, items["id"] == found["item_id"], "left").drop("item_id")
    return (
        known.unionByName(items.filter("id IS NULL"), allowMissingColumns=True)
        .withColumn("keywords", F.coalesce("keywords", no_strings()))
        .withColumn("characters", F.coalesce("characters", no_strings()))
    )
