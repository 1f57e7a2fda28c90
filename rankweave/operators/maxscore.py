"""BM25 top-k that skips what cannot enter the top k: block upper bounds and essential terms.

At index time postings are cut into blocks of `block_docs` consecutive doc_ids; for each
(field, term, block) the table `block_bounds` keeps the largest term-frequency part of a
BM25 contribution in it (idf aside, which a query multiplies in) and its number of postings.

A search, for each query:
1. bounds every block by the sum over its terms of idf x largest part;
2. scores exactly the postings of the blocks of highest bound, as many blocks as hold at
   least k documents; the k-th score found, theta, is a lower bound of the final k-th score;
3. keeps the blocks whose bound reaches theta, and splits the query terms: taken by
   rising largest contribution, those whose summed largest contributions stay below theta
   are not essential, since a document holding only them cannot reach theta. Candidates
   are the documents of kept blocks with an essential term; postings of other terms are
   read for candidates only;
4. scores the candidates exactly and ranks them like `lexical.bm25_search`.

The answers equal `bm25_search` (same rounding, ties by doc_id); bounds are compared with a
margin of one unit of the last rounded digit, so rounding cannot lose a tie. Everything is
joins, windows and aggregates; postings are joined with broadcast tables and summed in their
shards, so no posting is shuffled.
`postings_read` counts the postings a search scores against all postings of its terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.lexical import B, K1, bm25_weights, in_blocks, query_terms
from rankweave.operators.topk import SCORE_DIGITS, rounded, top_k
from rankweave.plans.index import TermIndex
from rankweave.session import broadcast_if_small, written

BLOCK_DOCS = 64
MARGIN = 10.0 ** -SCORE_DIGITS


def _part(k1: float, b: float):
    tf = F.col("tf").cast("double")
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))


def block_bounds(index: TermIndex, block_docs: int = BLOCK_DOCS, k1: float = K1, b: float = B) -> DataFrame:
    """(bucket, field, term, block, top, n): largest tf part and postings of each block of a term."""
    lengths = index.terms.select("field", "avg_len").distinct()  # one row per field
    return (
        index.postings.select("bucket", "field", "term", "doc_id", "tf", "doc_len")
        .join(F.broadcast(lengths), "field")
        .withColumn("block", F.floor(F.col("doc_id") / block_docs))
        .groupBy("bucket", "field", "term", "block")
        .agg(F.max(_part(k1, b)).alias("top"), F.count(F.lit(1)).alias("n"))
    )


def _scored(postings: DataFrame, k1: float, b: float) -> DataFrame:
    return postings.groupBy("query_id", "doc_id").agg(rounded(F.sum(F.col("idf") * _part(k1, b))).alias("score"))


def _search(queries: DataFrame, index: TermIndex, bounds: DataFrame, k: int, block_docs: int,
            k1: float, b: float, counted: bool) -> DataFrame:
    wanted = query_terms(queries, index)
    weights = F.broadcast(bm25_weights(F.broadcast(wanted), index))
    keys = ["bucket", "field", "term"]
    posts = (index.postings.select("bucket", "field", "term", "doc_id", "tf", "doc_len")
             .join(weights, keys).withColumn("block", F.floor(F.col("doc_id") / block_docs)))

    # 1. a bound per (query, block); at least max(n) documents lie in it
    per_term = bounds.join(weights, keys).withColumn("most", F.col("idf") * F.col("top"))
    upper = written(per_term.groupBy("query_id", "block").agg(F.sum("most").alias("upper"), F.max("n").alias("docs")), "upper")

    # 2. the blocks of highest bound that hold k documents; theta = their k-th score
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), "block")
    first = upper.withColumn("before", F.sum("docs").over(by_bound) - F.col("docs")).filter(F.col("before") < k)
    # ... at most k blocks a query
    seen = _scored(posts.join(F.broadcast(first.select("query_id", "block")), ["query_id", "block"], "left_semi"), k1, b)
    kth = F.broadcast(written(top_k(seen, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("theta")), "theta"))
    theta = F.coalesce(F.col("theta"), F.lit(float("-inf"))) - MARGIN

    # 3. blocks that can reach theta; terms whose bounds together stay below it are not essential
    kept = upper.join(kth, "query_id", "left").filter(F.col("upper") >= theta)
    kept = broadcast_if_small(kept.groupBy("block").agg(F.collect_set("query_id").alias("asking")))
    most = per_term.groupBy("query_id", "term", "field").agg(F.max("most").alias("most"))
    rising = Window.partitionBy("query_id").orderBy("most", "field", "term").rowsBetween(Window.unboundedPreceding, 0)
    split = F.broadcast(most.join(kth, "query_id", "left").withColumn("essential", F.sum("most").over(rising) >= theta).select(
        "query_id", "field", "term", "essential"))
    inside = posts.join(kept, "block").filter(F.array_contains("asking", F.col("query_id"))).join(split, ["query_id", "field", "term"])

    # 4. exact scores of the candidates: documents with an essential term, summed in their shards
    read = inside.groupBy("query_id", "doc_id").agg(
        rounded(F.sum(F.col("idf") * _part(k1, b))).alias("score"), F.max("essential").alias("essential"),
        F.count(F.lit(1)).alias("n")).filter("essential")
    if counted:
        return read.select("n")
    return top_k(read.select("query_id", "doc_id", "score"), k)


def bm25_top_k(queries: DataFrame, index: TermIndex, bounds: DataFrame, k: int = 20,
               block_docs: int = BLOCK_DOCS, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best by BM25, as `lexical.bm25_search`."""
    return in_blocks(queries, index, lambda block: _search(block, index, bounds, k, block_docs, k1, b, False))


def postings_read(queries: DataFrame, index: TermIndex, bounds: DataFrame, k: int = 20,
                  block_docs: int = BLOCK_DOCS) -> dict:
    """Postings scored in the last step, and all postings of the query terms."""
    read = in_blocks(queries, index, lambda block: _search(block, index, bounds, k, block_docs, K1, B, True)).agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    wanted = query_terms(queries, index)
    every = index.postings.join(F.broadcast(wanted.select("bucket", "term", "query_id")), ["bucket", "term"]).count()
    return {"read": read, "all": every, "share": read / every if every else 0.0}
