"""Fusing ranked lists: reciprocal rank fusion and the weighted sum.

A list is (query_id, doc_id, rank, score). Lists are united and grouped once, so
any number of them costs one shuffle of at most `CUT` rows per query and list, or
as many as the query's own `limit` asks for if that is more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.topk import SCORE_DIGITS, rounded, top_k
from rankweave.session import written

CUT = 100
RRF_K = 10
SEMANTIC_RATIO = 0.3
RAW_DIGITS = 9
LISTS = ("lexical", "semantic", "fuzzy")


def list_weight(name: Column, ratio: Column, fuzzy_weight: float) -> Column:
    """Weights of the three lists; they sum to 1."""
    rest = 1.0 - fuzzy_weight
    return (
        F.when(name == "lexical", rest * (1.0 - ratio))
        .when(name == "semantic", rest * ratio)
        .otherwise(F.lit(fuzzy_weight))
    )


def with_settings(queries: DataFrame, limit: int | None = None) -> DataFrame:
    """Queries with `ratio`, `floor` and `cut`: their own values where they have any."""
    own = lambda name, kind: F.col(name) if name in queries.columns else F.lit(None).cast(kind)
    return queries.withColumns({
        "ratio": F.coalesce(own("semantic_ratio", "double"), F.lit(SEMANTIC_RATIO)),
        "floor": own("min_score", "double"),
        "cut": F.greatest(F.lit(max(CUT, limit or 0)).cast("long"), own("limit", "long")),
    })


def list_cut(queries: DataFrame, limit: int | None = None) -> int:
    """How long lists must be: `CUT`, or the largest limit if that is more."""
    own = queries.agg(F.max("limit")).head()[0] if "limit" in queries.columns else 0
    return max(CUT, limit or 0, own or 0)


def asking(queries: DataFrame, name: str, fuzzy_weight: float = 0.0) -> DataFrame:
    """The queries in which list `name` has a weight; the others need not be searched."""
    return with_settings(queries).filter(list_weight(F.lit(name), F.col("ratio"), fuzzy_weight) > 0).select(*queries.columns)


def contributions(queries: DataFrame, lists: dict[str, DataFrame], k: int = RRF_K,
                  fuzzy_weight: float = 0.0, limit: int | None = None) -> DataFrame:
    """One row per (query, document, list) with its share of the fused score.

    `queries` may carry a `semantic_ratio`, a `min_score` and a `limit` of its own
    per row. A list of weight 0 is left out, so it adds no zero-score hits.
    """
    rows = None
    for name in LISTS:
        if name in lists:
            part = lists[name].select("query_id", "doc_id", F.lit(name).alias("list"), "rank", "score")
            rows = part if rows is None else rows.unionByName(part)
    settings = with_settings(queries, limit).select("query_id", "ratio", "floor", "cut")
    weight = list_weight(F.col("list"), F.col("ratio"), fuzzy_weight)
    return (
        rows.join(settings, "query_id")
        .filter("rank <= cut")
        .withColumn("weight", weight)
        .filter("weight > 0")
        .withColumn("contribution", F.col("weight") / (k + F.col("rank")))
    )


def fuse(queries: DataFrame, lists: dict[str, DataFrame], k: int = RRF_K, fuzzy_weight: float = 0.0,
         limit: int | None = 20, normalize: bool = True, min_score: float = 0.0,
         breakdown: bool = True) -> DataFrame:
    """Reciprocal rank fusion: hits (query_id, doc_id, rank, score[, score_breakdown]).

    Normalised, a document that leads every list scores 100. `min_score`
    applies after normalising; a query's own `min_score` takes its place.
    """
    parts = contributions(queries, lists, k, fuzzy_weight, limit)
    # Plain RRF scores are small and keep more digits.
    scale, digits = (100.0 * (k + 1), SCORE_DIGITS) if normalize else (1.0, RAW_DIGITS)
    detail = F.struct("rank", "score", F.round(scale * F.col("contribution"), digits).alias("contribution"))
    details = [F.max(F.when(F.col("list") == name, detail)).alias(name) for name in LISTS if breakdown]
    fused = parts.groupBy("query_id", "doc_id").agg(
        F.round(scale * F.sum("contribution"), digits).alias("score"), F.max("floor").alias("floor"), *details
    )
    kept = fused.filter(F.col("score") >= F.coalesce("floor", F.lit(min_score)))
    columns = ["query_id", "doc_id", "rank", "score"]
    if breakdown:
        kept = kept.withColumn("score_breakdown", F.struct(*LISTS))
        columns.append("score_breakdown")
    return top_k(kept, limit).select(*columns)


def both_scores(queries: DataFrame, lists: dict[str, DataFrame], k: int = RRF_K, fuzzy_weight: float = 0.0) -> DataFrame:
    """The normalised and the plain score of every fused document, from one search."""
    total = F.sum("contribution")
    return contributions(queries, lists, k, fuzzy_weight).groupBy("query_id", "doc_id").agg(
        F.round(100.0 * (k + 1) * total, SCORE_DIGITS).alias("score"), F.round(total, RAW_DIGITS).alias("raw_score"))


def weighted_sum(keyword: DataFrame, semantic: DataFrame, keyword_weight: float = 0.5,
                 semantic_weight: float = 0.5, limit: int | None = 20) -> DataFrame:
    """All keyword matches joined fully with the nearest vectors, scores added.

    A document outside the vector list counts as similarity 0, even if it has
    a vector; a negative similarity lowers the total.
    """
    kw = keyword.select("query_id", "doc_id", F.col("score").alias("kw"))
    vec = semantic.select("query_id", "doc_id", F.col("score").alias("sim"))
    both = kw.join(vec, ["query_id", "doc_id"], "full").select(
        "query_id", "doc_id",
        (F.coalesce("kw", F.lit(0.0)) * keyword_weight).alias("weighted_keyword_score"),
        (F.coalesce("sim", F.lit(0.0)) * semantic_weight).alias("weighted_semantic_score"),
    )
    total = F.col("weighted_keyword_score") + F.col("weighted_semantic_score")
    return top_k(both.withColumn("total_score", total), limit, score="total_score")


def keyword_only(keyword: DataFrame, limit: int | None = 20) -> DataFrame:
    """Queries without a vector: the keyword score alone, in the same columns."""
    hits = keyword.select(
        "query_id", "doc_id",
        F.col("score").alias("weighted_keyword_score"),
        F.lit(0.0).alias("weighted_semantic_score"),
        F.col("score").alias("total_score"),
    )
    return top_k(hits, limit, score="total_score")


def overlap(queries: DataFrame, lists: dict[str, DataFrame], k: int = 20) -> DataFrame:
    """Per query and pair of strategies: shared hits in the top k, mean rank gap.

    Every query has every pair; one without a shared hit has overlap 0 and no gap.
    Lists hold at most k rows per query, so the self-join stays small; they
    are written first, to be searched for only once.
    """
    rows = None
    for name, hits in lists.items():
        part = hits.filter(F.col("rank") <= k).select("query_id", "doc_id", "rank", F.lit(name).alias("strategy"))
        rows = part if rows is None else rows.unionByName(part)
    rows = written(rows, "strategies")
    a = rows.select("query_id", "doc_id", F.col("strategy").alias("left_strategy"), F.col("rank").alias("ra"))
    b = rows.select("query_id", "doc_id", F.col("strategy").alias("right_strategy"), F.col("rank").alias("rb"))
    found = (
        a.join(b, ["query_id", "doc_id"]).filter("left_strategy < right_strategy")
        .groupBy("query_id", "left_strategy", "right_strategy")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("gap"))
    )
    names = sorted(lists)
    pairs = [F.struct(F.lit(x).alias("left_strategy"), F.lit(y).alias("right_strategy")) for x in names for y in names if x < y]
    every = queries.select("query_id", F.inline(F.array(*pairs)))
    shared = F.coalesce("n", F.lit(0))
    return every.join(found, ["query_id", "left_strategy", "right_strategy"], "left").select(
        "query_id", "left_strategy", "right_strategy", shared.alias("shared"),
        rounded(shared / F.lit(k)).alias("overlap"), rounded(F.col("gap")).alias("mean_rank_gap"))
