"""Item and query preparation over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import scalars
from rankweave.session import broadcast_if_small, shuffle_partitions, written

PUSHED_IDS = 2_000


def number_missing_ids(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Give rows without `id` the numbers after the largest id, in `order`.

    `order` is a unique integer, of any density. Rows are cut at quantiles of it into
    as many ranges as there are shuffle partitions and numbered within each; the sizes
    of the ranges give the offsets. No task ever holds more than its range.
    """
    ranges = ranges or shuffle_partitions(df.sparkSession)
    cuts = [i / ranges for i in range(1, ranges)] or [0.5]
    found = df.agg(F.max("id").alias("last"), F.percentile_approx(F.when(F.col("id").isNull(), F.col(order)), cuts).alias("cuts")).head()
    borders = F.array(*[F.lit(c).cast("long") for c in sorted(set(found["cuts"] or [0]))])
    missing = df.filter("id IS NULL").withColumn("range", F.size(F.filter(borders, lambda b: b <= F.col(order))))
    sizes = {r["range"]: r["count"] for r in missing.groupBy("range").count().collect()}  # one row per range
    before, offsets = found["last"] or 0, []
    for r in range(ranges + 1):
        offsets.append(F.lit(before).cast("long"))
        before += sizes.get(r, 0)
    place = F.row_number().over(Window.partitionBy("range").orderBy(order))
    numbered = missing.withColumn("id", F.get(F.array(*offsets), F.col("range")) + place).drop("range")
    return df.filter("id IS NOT NULL").unionByName(numbered)


def item_defaults(df: DataFrame, order: str) -> DataFrame:
    """Fill missing fields; an empty title stays empty."""
    return (
        number_missing_ids(df, order)
        .withColumn("title", F.coalesce("title", F.lit(scalars.DEFAULT_TITLE)))
        .withColumn("overview", F.coalesce("overview", F.lit("")))
        .withColumn("genres", F.coalesce("genres", scalars.no_strings()))
    )


def import_limit(df: DataFrame, limit: int | None, order: str = "id") -> DataFrame:
    """First `limit` items by `order`; None or 0 keeps all."""
    return df.orderBy(order).limit(limit) if limit else df


def metadata_unpack(df: DataFrame, column: str = "metadata") -> DataFrame:
    """Columns out of metadata JSON, for rows that have any.

    Text entries as text, numbers cast, genres kept as JSON. A number that
    does not cast becomes null and `cast_failed` is set, as it is for metadata
    that is not JSON.
    """
    v = F.col("v")
    text = lambda key: F.try_variant_get(v, f"$.{key}", "string")
    number = lambda key: F.try_variant_get(v, f"$.{key}", "bigint")
    failed = lambda key: text(key).isNotNull() & number(key).isNull()
    return (
        df.filter(F.col(column).isNotNull())
        .withColumn("v", F.try_parse_json(column))
        .withColumn("tmdb_id", number("movie_id"))
        .withColumn("title", text("title"))
        .withColumn("overview", text("overview"))
        .withColumn("genres", F.to_json(F.try_variant_get(v, "$.genres", "variant")))
        .withColumn("poster", text("poster"))
        .withColumn("release_date", number("release_date"))
        .withColumn("cast_failed", v.isNull() | failed("movie_id") | failed("release_date"))
        .drop("v")
    )


def query_prepare(queries: DataFrame) -> DataFrame:
    """(query_id, q, ratio, limit) as given, to usable values and `accepted`."""
    return queries.select(
        "query_id", "q",
        scalars.prepared_ratio(F.col("ratio")).alias("semantic_ratio"),
        scalars.prepared_limit(F.col("limit")).alias("limit"),
        scalars.filled(F.col("q")).alias("accepted"),
    )


def with_payload(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """The final hits with the payload of their documents, null where there is none.

    The hits are few against the corpus and written first, so that they can be
    counted without searching twice. A checked number of ids reaches the scan of
    the corpus as a filter, which skips what is stored elsewhere; more ids are
    semi-joined. Either way only the payload of hits meets them.
    """
    hits = written(hits, "hits")
    ids = hits.select("doc_id").distinct()
    few = [r[0] for r in ids.limit(PUSHED_IDS + 1).collect()]
    if len(few) <= PUSHED_IDS:
        payload = corpus.filter(F.col("doc_id").isin(few))
    else:
        payload = corpus.join(broadcast_if_small(ids), "doc_id", "left_semi")
    return hits.join(payload, "doc_id", "left")


def hit_projection(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    date = F.col("release_date") if "release_date" in corpus.columns else F.lit(None).cast("long").alias("release_date")
    payload = corpus.select("doc_id", "title", "overview", "genres", "poster", date)
    return with_payload(hits, payload).select(
        *hits.columns,
        F.coalesce("title", F.lit(scalars.DEFAULT_TITLE)).alias("title"),
        F.coalesce("overview", F.lit("")).alias("overview"),
        F.coalesce("genres", scalars.no_strings()).alias("genres"),
        "poster",
        "release_date",
    )


def result_cards(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "doc_id", "title",
        scalars.card_genres(F.col("genres")).alias("genres"),
        scalars.card_poster(F.col("poster")).alias("poster"),
        scalars.card_score(F.col("score")).alias("score"),
    )
