"""Top-k with block bounds and essential terms gives the answers of plain BM25."""

import pytest
from pyspark.sql import functions as F

from rankweave.functions.text import Analyzer
from rankweave.operators import lexical, maxscore
from rankweave.plans.index import build_index
from workload import queries as w

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())


@pytest.mark.parametrize("k,block_docs", [(20, 64), (5, 8), (1, 1000)])
def test_same_answers_as_bm25(spark, k, block_docs):
    index, queries = w.document_index(spark, SF), w.search_queries(spark, SF)
    bounds = maxscore.block_bounds(index, block_docs)
    assert rows(maxscore.bm25_top_k(queries, index, bounds, k, block_docs)) == rows(lexical.bm25_search(queries, index, k))


def test_reads_fewer_postings(spark):
    index, queries = w.document_index(spark, SF), w.search_queries(spark, SF)
    read = maxscore.postings_read(queries, index, maxscore.block_bounds(index), 20)
    assert 0 < read["read"] <= read["all"]


def test_ties_short_lists_and_empty_queries(spark):
    """Equal documents rank by doc_id; fewer matches than k give them all; a query without terms finds nothing."""
    docs = spark.createDataFrame([(i, "apple pie" if i % 3 else "apple") for i in range(1, 40)] + [(40, None)],
                                 "doc_id long, text string")
    index = build_index(docs, {"content": F.col("text")}, Analyzer("english"))
    queries = spark.createDataFrame([(1, "apple pie"), (2, ""), (3, None), (4, "pie zebra")], "query_id long, q string")
    bounds = maxscore.block_bounds(index, 4)
    assert rows(maxscore.bm25_top_k(queries, index, bounds, 30, 4)) == rows(lexical.bm25_search(queries, index, 30))


def test_no_posting_is_shuffled(spark):
    """Only the best of each task move: one exchange by query, above the scan of the shards."""
    index, queries = w.document_index(spark, SF), w.search_queries(spark, SF)
    df = maxscore.bm25_top_k(queries, index, maxscore.block_bounds(index), 20)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    head = text[:text.index("Bucketed: true")]
    assert head.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in head
