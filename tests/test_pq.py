"""Product quantisation: recall against exact search, bytes read, odd rows."""

import pytest

from rankweave.operators import knn, pq
from workload import queries as w

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def index(spark):
    return pq.build_pq(w.vector_corpus(spark, SF), 16, 256, dim=w.DIM)


def pairs(df):
    return {(r["query_id"], r["doc_id"]) for r in df.select("query_id", "doc_id").collect()}


def test_recall_of_every_query(spark, index):
    queries = w.search_queries(spark, SF)
    exact = pairs(knn.nearest(w.vector_corpus(spark, SF), queries, 20))
    got = pairs(pq.nearest_pq(index, queries, 20, rerank=w.PQ_RERANK))
    assert len(got) == len(exact)
    assert len(got & exact) / len(exact) >= 0.9


def test_scores_are_exact(spark, index):
    queries = w.search_queries(spark, SF)
    exact = {(r["query_id"], r["doc_id"]): r["score"] for r in knn.nearest(w.vector_corpus(spark, SF), queries, 20).collect()}
    for r in pq.nearest_pq(index, queries, 20, rerank=w.PQ_RERANK).collect():
        if (r["query_id"], r["doc_id"]) in exact:
            assert r["score"] == pytest.approx(exact[(r["query_id"], r["doc_id"])], abs=2e-6)


def test_one_query_reads_under_three_tenths(spark, index):
    queries = w.search_queries(spark, SF).filter("query_vec IS NOT NULL").orderBy("query_id").limit(10).toArrow()
    shares = [pq.bytes_read(index, pq._candidates(index, queries.slice(i, 1), w.PQ_RERANK))["share"] for i in range(10)]
    assert max(shares) <= 0.3


def test_rerank_reads_only_buckets_of_candidates(spark, index):
    asked = w.search_queries(spark, SF).filter("query_vec IS NOT NULL").limit(1).toArrow()
    plan = pq.nearest_pq(index, spark.createDataFrame(asked), 20, rerank=w.PQ_RERANK)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text


def test_odd_rows(spark):
    """Null, short, zero and repeated vectors; queries without a vector find nothing."""
    corpus = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0, 0.0]),
         (5, [1.0, 2.0]), (6, [1.0, 0.0, 0.0, 0.0]), (7, [0.5, 0.5, 0.0, 0.0])],
        "doc_id long, embedding array<float>")
    index = pq.build_pq(corpus, m=2, ks=4, dim=4)
    queries = spark.createDataFrame([(10, [1.0, 0.0, 0.0, 0.0]), (11, None), (12, [0.0, 0.0, 0.0, 0.0])],
                                    "query_id long, query_vec array<float>")
    rows = sorted((r["query_id"], r["doc_id"], r["rank"]) for r in pq.nearest_pq(index, queries, 2, rerank=4).collect())
    assert rows == [(10, 1, 1), (10, 6, 2)]


def test_empty_corpus(spark):
    corpus = spark.createDataFrame([], "doc_id long, embedding array<float>")
    index = pq.build_pq(corpus, m=2, ks=4, dim=4)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, query_vec array<float>")
    assert pq.nearest_pq(index, queries, 5).count() == 0
