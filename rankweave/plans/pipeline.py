"""End-to-end plans: index a corpus, answer a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.scalars import content_document, doc_identity, metadata_pack
from rankweave.functions.vectors import hash_embed
from rankweave.operators.enrich import enrich
from rankweave.operators.fusion import CUT, asking, fuse, keyword_only, list_cut, overlap, weighted_sum
from rankweave.operators.fuzzy import fuzzy_search
from rankweave.operators.items import hit_projection, query_prepare
from rankweave.operators.knn import nearest
from rankweave.operators.lexical import all_terms_match, bm25_search, native_search
from rankweave.plans.index import TermIndex
from rankweave.session import written

Transform = Callable[[DataFrame], DataFrame]


def indexer(source: DataFrame, transformers: Iterable[Transform] = (), filters: Iterable[Column] = (),
            vectorizer: Transform | None = None) -> DataFrame:
    """Loader -> transformers -> filters -> vectorizer; write the result yourself."""
    for step in transformers:
        source = source.transform(step)
    for condition in filters:
        source = source.filter(condition)
    return source.transform(vectorizer) if vectorizer else source


def with_embedding(dim: int, column: str = "content", target: str = "embedding",
                   embed: Callable[[Column, int], Column] = hash_embed) -> Transform:
    return lambda df: df.withColumn(target, embed(F.col(column), dim))


def corpus_of(items: DataFrame, source: str, payloads: DataFrame | None = None) -> DataFrame:
    """Items (defaults filled) to corpus rows, without the vector."""
    if payloads is not None:
        items = enrich(items, payloads)
        extra = [F.col("keywords"), F.col("characters"), F.col("director")]
    else:
        extra = []
    cols = [F.col(c) for c in ("title", "overview", "genres", "release_date")]
    return items.withColumn("content", content_document(*cols, *extra)).select(
        doc_identity(F.lit(source), F.col("id")).alias("doc_id"), F.col("id").alias("item_id"),
        "content", "title", "overview", "genres", "poster", "release_date",
        metadata_pack(F.col("content"), F.col("title"), F.col("overview"), F.col("genres"),
                      F.col("poster"), F.col("release_date"), F.col("id")).alias("metadata"),
    )


def ranked_lists(queries: DataFrame, corpus: DataFrame, index: TermIndex, cut: int | None = None,
                 strategy: str = "bm25", fuzzy_index: TermIndex | None = None,
                 max_distance: float | None = None, fuzzy_weight: float = 0.0) -> dict[str, DataFrame]:
    """The lists to fuse, each searched for the queries in which it has a weight.

    `cut` is their length; by default it covers the largest `limit` of a query.
    """
    search = {"bm25": bm25_search, "native": native_search}[strategy]
    cut = cut or list_cut(queries)
    asked = lambda name: asking(queries, name, fuzzy_weight)
    lists = {
        "lexical": search(asked("lexical"), index, cut),
        "semantic": nearest(corpus, asked("semantic"), cut, max_distance=max_distance),
    }
    if fuzzy_index is not None and fuzzy_weight > 0:
        lists["fuzzy"] = fuzzy_search(queries, fuzzy_index, cut)
    return lists


def hybrid_rrf(queries: DataFrame, corpus: DataFrame, index: TermIndex,
               fuzzy_index: TermIndex | None = None, strategy: str = "bm25",
               max_distance: float | None = None, fuzzy_weight: float = 0.0, limit: int | None = 20,
               **options) -> DataFrame:
    """Lexical and semantic ranking of (query_id, q, query_vec), fused.

    Lists are as long as `limit` or a query's own limit asks for, `CUT` at least.
    """
    lists = ranked_lists(queries, corpus, index, list_cut(queries, limit), strategy, fuzzy_index, max_distance, fuzzy_weight)
    return fuse(queries, lists, fuzzy_weight=fuzzy_weight, limit=limit, **options)


def hybrid_weighted(queries: DataFrame, corpus: DataFrame, index: TermIndex,
                    keyword_weight: float = 0.5, semantic_weight: float = 0.5, limit: int = 20) -> DataFrame:
    """Weighted sum for queries with a vector, keyword search for the others."""
    with_vector = queries.filter("query_vec IS NOT NULL")
    keyword = all_terms_match(with_vector, index)
    both = weighted_sum(keyword, nearest(corpus, with_vector, CUT), keyword_weight, semantic_weight, limit)
    rest = keyword_only(all_terms_match(queries.filter("query_vec IS NULL"), index), limit)
    return both.unionByName(rest)


def retrieve(raw_queries: DataFrame, corpus: DataFrame, index: TermIndex, dim: int,
             embed: Callable[[Column, int], Column] = hash_embed, **options) -> DataFrame:
    """Prepare, embed, search and project (query_id, q, ratio, limit).

    Each query's own limit applies; refused queries give no hits.
    """
    asked = query_prepare(raw_queries).filter("accepted")
    queries = asked.withColumn("query_vec", embed(F.col("q"), dim))
    hits = hybrid_rrf(queries, corpus, index, limit=None, **options)
    hits = hits.join(asked.select("query_id", "limit"), "query_id").filter("rank <= limit").drop("limit")
    return hit_projection(hits, corpus)


def compare_strategies(queries: DataFrame, corpus: DataFrame, index: TermIndex, k: int = 20) -> DataFrame:
    """Overlap and rank differences of the strategies on the same queries."""
    bm25 = written(bm25_search(queries, index, CUT), "bm25")
    semantic = written(nearest(corpus, queries, CUT), "semantic")
    return overlap(queries, {
        "bm25": bm25,
        "native": native_search(queries, index, k),
        "semantic": semantic,
        "hybrid": fuse(queries, {"lexical": bm25, "semantic": semantic}, limit=k, breakdown=False),
    }, k)
