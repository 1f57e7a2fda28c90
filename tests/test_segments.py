"""An index grown by segments, replaced and deleted rows, merges: equal to a fresh index over the same documents."""

import uuid

import pytest
from pyspark.sql import functions as F

from rankweave.functions.text import Analyzer
from rankweave.operators import lexical
from rankweave.plans import index as ix, segments
from rankweave.plans.index import build_index
from rankweave.session import workspace

SF = "/root/testdata/sf0.001"


def stats(index):
    return sorted(tuple(r) for r in index.terms.select("field", "term", "df", "n_docs", F.round("avg_len", 9)).collect())


def hits(index, queries):
    return sorted(tuple(r) for r in lexical.bm25_search(queries, index, 10).select("query_id", "doc_id", "rank", "score").collect())


@pytest.mark.parametrize("fan_in", [2, 4])
def test_grown_index_equals_a_fresh_one(spark, fan_in):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    index = segments.create(spark, {"content": "text"}, Analyzer("english"))
    for part in range(3):  # three adds, then one over ids that are there already
        index = segments.add(index, docs.filter(F.col("doc_id") % 3 == part))
    changed = docs.filter("doc_id % 5 = 0").select("doc_id", F.concat(F.lit("changed words "), "text").alias("text"), F.lit(2).alias("v"))
    index = segments.add(index, changed.unionByName(changed.select("doc_id", "text", F.lit(1).alias("v"))), order="v")
    index = segments.delete(index, docs.filter(F.col("source") == "src3"))
    back = docs.filter("source = 'src3' AND doc_id % 2 = 0").select("doc_id", F.upper("text").alias("text"))
    index = segments.add(index, back)
    index = segments.merge(index, fan_in=fan_in)
    assert len(index.segments) < 5

    edited = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("changed words "), "text")).otherwise(F.col("text"))
    final = docs.filter("source <> 'src3'").select("doc_id", edited.alias("text")).unionByName(back)
    fresh = build_index(final, {"content": F.col("text")}, Analyzer("english"), f"{workspace(spark)}/fresh-{uuid.uuid4().hex}")
    grown = segments.term_index(index)
    assert stats(grown) == stats(fresh)
    assert hits(grown, queries) == hits(fresh, queries)
    reopened = segments.term_index(segments.open_segments(spark, index.path))
    assert stats(reopened) == stats(fresh)


def test_tiers():
    assert [segments.tier(n, 4) for n in (0, 3, 4, 15, 16, 1000)] == [0, 0, 1, 1, 2, 4]


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_only_own_documents_are_hidden(spark):
    index = segments.create(spark, {"content": "text"}, Analyzer("simple"))
    index = segments.add(index, texts(spark, [(1, "red fox"), (2, "blue fox"), (3, "fox")]))
    index = segments.add(index, texts(spark, [(4, "red hen"), (5, "hen")]))
    first, second = index.segments
    assert index.hidden(first) is None  # the ids of the second add are not in the first segment
    index = segments.delete(index, texts(spark, [(2, ""), (5, ""), (99, "")]))
    assert [r.doc_id for r in index.hidden(first).collect()] == [2]
    assert [r.doc_id for r in index.hidden(second).collect()] == [5]
    assert {(r.term, r.df) for r in segments.term_index(index).terms.collect()} == {("red", 2), ("fox", 2), ("hen", 1)}


def test_texts_lie_in_shards_of_one_size(spark, monkeypatch):
    monkeypatch.setattr(ix, "SHARD_BYTES", 40)
    rows = [(i, f"word{i} and some more") for i in range(100)]
    index = segments.add(segments.create(spark, {"content": "text"}, Analyzer("simple")), texts(spark, rows))
    files = index.part(index.segments[0], "docs").select(F.input_file_name()).distinct().count()
    postings = index.part(index.segments[0], "postings")
    assert files and postings.select(F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1)).distinct().count() > 20
    assert postings.count() == 400


@pytest.mark.parametrize("most", [0, 1000])
def test_lengths_and_repeated_ids(spark, monkeypatch, most):
    monkeypatch.setattr(segments, "MAX_BROADCAST_ROWS", most)
    rows = [(1, "a b", 1), (1, "a b c", 2), (2, "", 1), (3, None, 1), (4, "the the fox", 1), (None, "no id", 1), (4, "old", 0)]
    batch = spark.createDataFrame(rows, "doc_id long, text string, v int")
    index = segments.add(segments.create(spark, {"content": "text"}, Analyzer("simple")), batch, order="v")
    docs = {(r.field, r.doc_id): r.doc_len for r in index.part(index.segments[0], "docs").collect()}
    assert docs == {("content", 1): 3, ("content", 2): 0, ("content", 3): None, ("content", 4): 3}
    kept = texts(spark, [(1, "a b c"), (2, ""), (3, None), (4, "the the fox")])
    want = ix.doc_lengths(kept, {"content": F.col("text")}, Analyzer("simple"))
    assert docs == {(r.field, r.doc_id): r.doc_len for r in want.collect()}
    found = {(r.term, r.doc_id, r.tf) for r in segments.term_index(index).postings.collect()}
    assert found == {("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("the", 4, 2), ("fox", 4, 1)}
