"""The reference's search scenarios, with assertions that bite."""

import pytest
from pyspark.sql import functions as F

from rankweave.functions.text import Analyzer
from rankweave.operators import fusion, fuzzy, knn, lexical
from rankweave.plans import pipeline
from rankweave.plans.index import build_index

DIM = 16
def fields():
    return {name: F.col(name) for name in ("title", "overview", "genres")}


BOOSTS = {"title": 0.9, "overview": 1.1, "genres": 1.0}


def fill(x, dim=DIM):
    return [float(x)] * dim


def corpus(spark, rows):
    schema = "doc_id string, embedding array<float>, content string, title string, overview string, genres string"
    full = [(d, v, c, *(list(m) + [None] * (3 - len(m)))) for d, v, c, *m in rows]
    return spark.createDataFrame(full, schema)


def ask(spark, q=None, vec=None, **more):
    schema = "query_id int, q string, query_vec array<float>" + "".join(f", {k} double" for k in more)
    return spark.createDataFrame([(1, q, vec, *more.values())], schema)


def index(docs, language="simple"):
    return build_index(docs, {"content": F.col("content")}, Analyzer(language))


def order(df):
    return [r.doc_id for r in df.orderBy("rank").collect()]


def test_vector_similarity(spark):
    docs = corpus(spark, [("1", fill(0.5), "a"), ("2", fill(0.51), "b"), ("3", fill(0.1), "c"), ("4", [1.0] + fill(0, DIM - 1), "d")])
    assert order(knn.nearest(docs, ask(spark, vec=fill(0.5)), 4, metric="l2")) == ["1", "2", "3", "4"]
    hits = knn.nearest(docs, ask(spark, vec=fill(0.5)), 4).collect()
    assert [r.score for r in hits][:3] == [1.0, 1.0, 1.0]  # collinear: cosine cannot tell them apart
    assert [r.score for r in hits][3] == pytest.approx(0.25)


def test_bm25_frequency(spark):
    docs = corpus(spark, [("1", None, "robotics " * 5), ("2", None, "This document mentions robotics only once")])
    assert order(lexical.bm25_search(ask(spark, "robotics"), index(docs, "english"), 10)) == ["1", "2"]


def test_hybrid_finds_both_kinds(spark):
    docs = corpus(spark, [
        ("1", [1.0] + fill(0.9, DIM - 1), "A movie about aliens"),
        ("2", fill(-0.1), "space exploration space stations space travel space missions"),
        ("3", [0.2] + fill(0.5, DIM - 1), "An adventure in space")])
    q = ask(spark, "space", [1.0] + fill(0.85, DIM - 1))
    hits = pipeline.hybrid_rrf(q, docs, index(docs, "english"), limit=10)
    assert sorted(order(hits)) == ["1", "2", "3"]
    by = {r.doc_id: r for r in hits.collect()}
    assert by["2"].score == pytest.approx(100 * 11 * (0.7 / 11 + 0.3 / 13), abs=1e-5)
    assert by["1"].score_breakdown.lexical is None and by["1"].score_breakdown.semantic.rank == 1
    assert by["1"].score == by["1"].score_breakdown.semantic.contribution == 30.0


def test_field_boosts(spark):
    docs = corpus(spark, [
        ("1", None, "", "cyberpunk adventures", "A movie about the future", "Action"),
        ("2", None, "", "Future Stories", "cyberpunk cyberpunk cyberpunk", "Drama")])
    ix = build_index(docs, fields(), Analyzer("simple"))
    plain = {r.doc_id: r.score for r in lexical.bm25_search(ask(spark, "cyberpunk"), ix, 10).collect()}
    boosted = {r.doc_id: r.score for r in lexical.bm25_search(ask(spark, "cyberpunk"), ix, 10, boosts=BOOSTS).collect()}
    assert boosted["1"] == pytest.approx(0.9 * plain["1"], abs=1e-5)
    assert boosted["2"] == pytest.approx(1.1 * plain["2"], abs=1e-5)


def test_overview_beats_genres(spark):
    docs = corpus(spark, [
        ("1", None, "", "Movie One", "A regular movie", "quantum physics science"),
        ("2", None, "", "Movie Two", "quantum quantum quantum", "Drama")])
    ix = build_index(docs, fields(), Analyzer("simple"))
    assert order(lexical.bm25_search(ask(spark, "quantum"), ix, 10, boosts=BOOSTS)) == ["2", "1"]


def test_minimum_score(spark):
    docs = corpus(spark, [("1", fill(0.9), "High"), ("2", [-1.0] + fill(0.01, DIM - 1), "Low")])
    semantic = {"semantic": knn.nearest(docs, ask(spark, vec=fill(0.9)), 100)}
    q = ask(spark, vec=fill(0.9), semantic_ratio=1.0)
    hits = fusion.fuse(q, semantic, min_score=95.0).collect()
    assert [(r.doc_id, r.score) for r in hits] == [("1", 100.0)]
    own = q.withColumn("min_score", F.lit(0.0))
    assert fusion.fuse(own, semantic, min_score=95.0).count() == 2


def test_normalised_scores(spark):
    docs = corpus(spark, [(str(i), [float(i)] + fill(1, DIM - 1), "text") for i in range(30)])
    q = ask(spark, "text", fill(1.0))
    hits = pipeline.hybrid_rrf(q, docs, index(docs), limit=None).collect()
    assert all(0 <= r.score <= 100 for r in hits) and len(hits) == 30
    only = fusion.fuse(q.withColumn("semantic_ratio", F.lit(1.0)), {"semantic": knn.nearest(docs, q, 100)}).collect()
    assert max(r.score for r in only) == 100.0


def test_typo(spark):
    docs = corpus(spark, [("1", fill(0.5), "The Matrix Resurrections"), ("2", fill(0.5), "A science fiction movie")])
    ix = index(docs)
    q = ask(spark, "Matrx", fill(0.5))
    hits = fuzzy.fuzzy_search(q, ix).collect()
    assert [(r.doc_id, r.score) for r in hits] == [("1", 0.444444)]
    fused = pipeline.hybrid_rrf(q, docs, ix, fuzzy_index=ix, fuzzy_weight=1.0).collect()
    assert [r.doc_id for r in fused] == ["1"]
    off = pipeline.hybrid_rrf(q, docs, ix, fuzzy_index=ix, fuzzy_weight=0.0).collect()
    assert all(r.score_breakdown.fuzzy is None for r in off) and len(off) == 2


def test_ratio_flips_the_order(spark):
    docs = corpus(spark, [("1", fill(1.0), "A dramatic story"), ("2", [-1.0] + fill(0.1, DIM - 1), "artificial intelligence " * 3),
                          ("3", fill(0.0), "nothing")])
    ix = index(docs, "english")
    text = pipeline.hybrid_rrf(ask(spark, "artificial intelligence", fill(1.0), semantic_ratio=0.0), docs, ix)
    meaning = pipeline.hybrid_rrf(ask(spark, "artificial intelligence", fill(1.0), semantic_ratio=1.0), docs, ix)
    assert order(text) == ["2"]            # no zero-score hits from the list of weight 0
    assert order(meaning) == ["1", "2"]    # the zero vector takes no part
    mixed = pipeline.hybrid_rrf(ask(spark, "artificial intelligence", fill(1.0), semantic_ratio=0.1), docs, ix)
    assert order(mixed)[0] == "2"


def test_match_needs_every_term(spark):
    docs = corpus(spark, [("1", None, "green ogre"), ("2", None, "green"), ("3", None, "ogres are green")])
    ix = index(docs, "english")
    assert sorted(order(lexical.keyword_search(ask(spark, "Green Ogre"), ix))) == ["1", "3"]
    assert lexical.keyword_search(ask(spark, "the and of"), ix).count() == 0
    assert sorted(order(lexical.bm25_search(ask(spark, "green ogre"), ix))) == ["1", "2", "3"]


def test_weighted_sum_and_fallback(spark):
    docs = corpus(spark, [("1", fill(1), "ogre"), ("2", fill(-1), "ogre ogre"), ("3", None, "ogre")])
    ix = index(docs)
    got = {r.doc_id: r for r in pipeline.hybrid_weighted(ask(spark, "ogre", fill(1)), docs, ix).collect()}
    assert got["1"].total_score == pytest.approx(0.25 + 0.5)
    assert got["2"].total_score == pytest.approx(0.5 * 0.666667 - 0.5)  # below the row without a vector
    assert got["3"].total_score == pytest.approx(0.25) and got["3"].weighted_semantic_score == 0
    alone = {r.doc_id: r for r in pipeline.hybrid_weighted(ask(spark, "ogre"), docs, ix).collect()}
    assert alone["2"].total_score == pytest.approx(0.666667) and alone["2"].weighted_semantic_score == 0


def test_infix_and_title(spark):
    docs = corpus(spark, [("1", None, "", "The Matrix"), ("2", None, "", "Other")])
    assert [r.doc_id for r in lexical.infix_search(docs, "title", "ATRI").collect()] == ["1"]
    assert [r.doc_id for r in lexical.title_lookup(docs, "Other").collect()] == ["2"]


def test_retrieve_applies_each_query_s_limit(spark):
    docs = corpus(spark, [(str(i), None, f"ogre number {i}", f"t{i}", "o", "g") for i in range(30)])
    docs = docs.withColumn("genres", F.array("genres")).withColumn("poster", F.lit(None).cast("string"))
    docs = docs.transform(pipeline.with_embedding(DIM))
    raw = spark.createDataFrame([(1, "ogre", None, "3"), (2, "ogre", "0", None), (3, "0", None, None)],
                                "query_id int, q string, ratio string, `limit` string")
    hits = pipeline.retrieve(raw, docs, index(docs), DIM).collect()
    assert sum(r.query_id == 1 for r in hits) == 3 and sum(r.query_id == 2 for r in hits) == 20
    assert not any(r.query_id == 3 for r in hits) and all(r.title.startswith("t") for r in hits)


def test_limits_above_the_list_cut_are_kept(spark):
    docs = corpus(spark, [(f"{i:04}", [1.0 + i % 7] + fill(1, DIM - 1), f"ogre number{i}", f"t{i}", "o", "g") for i in range(700)])
    docs = docs.withColumn("genres", F.array("genres")).withColumn("poster", F.lit(None).cast("string"))
    docs = docs.transform(pipeline.with_embedding(DIM))
    ix = index(docs)
    raw = spark.createDataFrame([(1, "ogre", "0", "500"), (2, "ogre", None, "500"), (3, "ogre", "1", "30")],
                                "query_id int, q string, ratio string, `limit` string")
    counts = {r.query_id: r["count"] for r in pipeline.retrieve(raw, docs, ix, DIM).groupBy("query_id").count().collect()}
    assert counts == {1: 500, 2: 500, 3: 30}
    assert pipeline.hybrid_rrf(ask(spark, "ogre", fill(1.0)), docs, ix, limit=300).count() == 300


def test_lists_without_weight_are_not_searched(spark):
    asked = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 1.0), (4, None)], "query_id int, semantic_ratio double")
    ids = lambda name, w=0.0: sorted(r.query_id for r in fusion.asking(asked, name, w).collect())
    assert ids("lexical") == [1, 2, 4] and ids("semantic") == [2, 3, 4] and ids("lexical", 1.0) == [] and ids("fuzzy", 0.4) == [1, 2, 3, 4]
