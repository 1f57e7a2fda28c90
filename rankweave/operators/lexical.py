"""Lexical search of a table of queries (query_id, q) against a term index.

Queries are taken in blocks whose terms are few enough to broadcast, and whose pairs
with the documents of a shard are few enough for a task; to the postings they prune
these to the buckets of their terms. Postings are sharded by
document, so each task scores its documents completely and the first shuffle
carries the k best per query and task. However many queries there are, no posting
is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.topk import rounded, top_k
from rankweave.plans.index import TermIndex
from rankweave.session import MAX_BROADCAST_ROWS, written

K1 = 1.2
B = 0.75
COVER_LENGTH = 16.0
#: Pairs (query, document) that a block of queries may have in a shard, on average: a task holds them while it sums.
MAX_PAIRS = 8 << 20


def query_terms(queries: DataFrame, index: TermIndex) -> DataFrame:
    """(query_id, term, n_terms, bucket): distinct terms of each query."""
    terms = F.array_distinct(index.analyzer.terms(F.col("q")))
    return (
        queries.select("query_id", terms.alias("terms"))
        .select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
        .filter("term != ''")
        .withColumn("bucket", index.bucket_of(F.col("term")))
    )


def shard_pairs(wanted: DataFrame, n_terms: int, n_queries: int, index: TermIndex) -> int:
    """At most so many pairs (query, document) with a common term lie in a shard, on average; 0 without shards.

    Short texts are many in a shard, but hold few terms: past `MAX_PAIRS` the postings of the query terms are counted.
    """
    if not index.shards:
        return 0
    pairs = n_queries * index.n_docs // index.shards
    if pairs <= MAX_PAIRS:
        return pairs
    asked = F.broadcast(wanted) if n_terms <= MAX_BROADCAST_ROWS else wanted
    postings = index.terms.join(asked, ["bucket", "term"]).agg(F.coalesce(F.sum("df"), F.lit(0))).head()[0]
    return min(pairs, postings // index.shards)


def in_blocks(queries: DataFrame, index: TermIndex, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Search blocks of queries with about half as many terms as may be broadcast, and `MAX_PAIRS` pairs in a shard.

    One block is searched where its result is used; of several, each is written
    before the next begins.
    """
    wanted = query_terms(queries, index)
    asked = wanted.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("query_id").alias("queries")).head()
    n = -(-2 * asked["terms"] // max(1, MAX_BROADCAST_ROWS))
    n = max(n, -(-shard_pairs(wanted, asked["terms"], asked["queries"], index) // MAX_PAIRS))
    if n <= 1:
        return search(queries)
    block = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return reduce(DataFrame.unionByName, [written(search(queries.filter(block == b)), "block") for b in range(n)])


def matches(queries: DataFrame, index: TermIndex, columns: list[str]) -> DataFrame:
    """Postings of the query terms: one row per (query, field, term, document)."""
    return index.postings.select("bucket", "field", "term", "doc_id", *columns).join(
        F.broadcast(query_terms(queries, index)), ["bucket", "term"]
    )


def all_terms_match(queries: DataFrame, index: TermIndex) -> DataFrame:
    """Documents holding every term of the query, with the mean of tf/(tf+1).

    A query without terms (stop words only) matches nothing.
    """
    return in_blocks(queries, index, lambda block: _all_terms_match(block, index))


def _all_terms_match(queries: DataFrame, index: TermIndex) -> DataFrame:
    found = matches(queries, index, ["tf"])
    if len(index.fields) > 1:  # a term in several fields of a document is one term
        found = found.groupBy("query_id", "doc_id", "term").agg(F.sum("tf").alias("tf"), F.max("n_terms").alias("n_terms"))
    tf = F.col("tf").cast("double")
    return (
        found.groupBy("query_id", "doc_id")
        .agg(F.count(F.lit(1)).alias("found"), F.max("n_terms").alias("n_terms"),
             F.sum(tf / (tf + 1)).alias("weight"))
        .filter("found = n_terms")
        .select("query_id", "doc_id", rounded(F.col("weight") / F.col("n_terms")).alias("score"))
    )


def keyword_search(queries: DataFrame, index: TermIndex, k: int | None = 20) -> DataFrame:
    """Match all terms, rank by term frequency."""
    return in_blocks(queries, index, lambda block: top_k(_all_terms_match(block, index), k))


def bm25_weights(wanted: DataFrame, index: TermIndex) -> DataFrame:
    """Query terms with their idf and the field's mean length."""
    df = F.col("df").cast("double")
    idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
    return index.terms.join(wanted, ["bucket", "term"]).select(
        "bucket", "field", "term", "query_id", idf.alias("idf"), "avg_len"
    )


def bm25_scores(queries: DataFrame, index: TermIndex, boosts: dict[str, float] | None = None,
                k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of every document that holds any query term."""
    return in_blocks(queries, index, lambda block: _bm25_scores(block, index, boosts, k1, b))


def _bm25_scores(queries: DataFrame, index: TermIndex, boosts: dict[str, float] | None = None,
                 k1: float = K1, b: float = B) -> DataFrame:
    wanted = query_terms(queries, index)
    weights = F.broadcast(bm25_weights(F.broadcast(wanted), index))  # as many, once per field
    tf = F.col("tf").cast("double")
    norm = k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len"))
    part = F.col("idf") * tf * (k1 + 1) / (tf + norm)
    if boosts:
        boost = F.lit(0.0)
        for field, value in boosts.items():
            boost = F.when(F.col("field") == field, value).otherwise(boost)
        part = part * boost
    return (
        index.postings.select("bucket", "field", "term", "doc_id", "tf", "doc_len")
        .join(weights, ["bucket", "field", "term"])
        .groupBy("query_id", "doc_id")
        .agg(rounded(F.sum(part)).alias("score"))
    )


def bm25_search(queries: DataFrame, index: TermIndex, k: int | None = 20, **options) -> DataFrame:
    return in_blocks(queries, index, lambda block: top_k(_bm25_scores(block, index, **options), k))


def cover_density(hits: Column, n_terms: Column, cover_length: float) -> Column:
    """Sum of min(1, cover_length / length) over the minimal covers.

    `hits` is a sorted array of (pos, slot); slot 0..n-1 names the query term.
    Going right, the shortest interval ending here starts at the oldest of the
    last positions; it is a new minimal cover when that start has moved.
    """
    start = F.struct(
        F.array_repeat(F.lit(0), n_terms).alias("last"),
        F.lit(0).alias("pos"),
        F.lit(0).alias("from"),
        F.lit(0.0).alias("score"),
    )

    def settle(state):
        left = F.array_min(state["last"])
        gain = F.least(F.lit(1.0), F.lit(cover_length) / (state["pos"] - left + 1))
        grown = left > state["from"]
        return (F.when(grown, left).otherwise(state["from"]),
                F.when(grown, state["score"] + gain).otherwise(state["score"]))

    def step(state, hit):
        begin, score = settle(state)
        last = F.transform(state["last"], lambda p, i: F.when(i == hit["slot"], hit["pos"]).otherwise(p))
        return F.struct(last.alias("last"), hit["pos"].alias("pos"), begin.alias("from"), score.alias("score"))

    return F.aggregate(hits, start, step, lambda state: settle(state)[1])


def native_search(queries: DataFrame, index: TermIndex, k: int | None = 20,
                  cover_length: float = COVER_LENGTH) -> DataFrame:
    """Match all terms, rank by cover density.

    Positions are gathered within the shard, only those of query terms: never
    more than one document's own length. Positions of different fields have no
    common order, so the index must have one field.
    """
    if len(index.fields) != 1:
        raise ValueError("cover density needs an index with one field")
    return in_blocks(queries, index, lambda block: _native_search(block, index, k, cover_length))


def _native_search(queries: DataFrame, index: TermIndex, k: int | None, cover_length: float) -> DataFrame:
    # Positions are read for documents that hold all terms of some query only. Grouped by
    # document, both sides lie in the shard; rows without an id, which no join finds, are few.
    chosen = _all_terms_match(queries, index).groupBy("doc_id").agg(F.collect_set("query_id").alias("chosen"))
    postings = index.postings.select("bucket", "term", "doc_id", "positions")
    wanted = F.broadcast(query_terms(queries, index))
    rows = postings.join(chosen.hint("shuffle_hash"), "doc_id").join(wanted, ["bucket", "term"]).filter(
        F.array_contains("chosen", F.col("query_id")))
    nameless = postings.filter("doc_id IS NULL").join(wanted, ["bucket", "term"])

    def gather(rows: DataFrame) -> DataFrame:
        return (
            rows.groupBy("query_id", "doc_id")
            .agg(F.max("n_terms").alias("n_terms"), F.collect_list("positions").alias("lists"))
            .filter(F.size("lists") == F.col("n_terms"))
        )

    gathered = gather(rows).unionByName(gather(nameless))
    slots = F.transform(
        "lists", lambda positions, i: F.transform(positions, lambda p: F.struct(p.alias("pos"), i.alias("slot")))
    )
    hits = F.array_sort(F.flatten(slots))
    scored = gathered.select("query_id", "doc_id", "n_terms", hits.alias("hits")).select(
        "query_id", "doc_id", rounded(cover_density(F.col("hits"), F.col("n_terms"), cover_length)).alias("score")
    )
    return top_k(scored, k)


def infix_search(docs: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows whose text holds `needle` anywhere, also inside a word."""
    return docs.filter(F.contains(F.lower(column), F.lit(needle.lower())))


def title_lookup(docs: DataFrame, title: str) -> DataFrame:
    """Equality on the title; reaches the Parquet scan as a pushed filter."""
    return docs.filter(F.col("title") == title)
