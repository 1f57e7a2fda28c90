import pytest
from pyspark.sql import functions as F

from rankweave.functions import scalars, vectors
from rankweave.operators import items

ITEM = "item_key long, id long, title string, overview string, genres array<string>, poster string, release_date long"


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_defaults_and_numbering(spark):
    rows = [
        (0, 7, "A", "x", ["g"], None, 1), (1, None, None, None, None, None, None),
        (2, None, "", "0", [], "p", 0), (3, 3, "B", "y", ["h"], "", -1),
    ]
    df = spark.createDataFrame(rows, ITEM)
    got = {r.item_key: r for r in items.item_defaults(df, "item_key").collect()}
    assert (got[1].title, got[1].overview, got[1].genres, got[1].poster) == ("Unknown", "", [], None)
    assert got[2].title == ""
    assert [got[k].id for k in (0, 1, 2, 3)] == [7, 8, 9, 3]


def test_numbering_across_blocks(spark):
    df = spark.range(1000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("id"))
    for spread in (F.col("k"), F.col("k") * 10 ** 15 - 5 * 10 ** 17):  # dense and sparse orders, negative ones too
        got = items.number_missing_ids(df.withColumn("k", spread), "k", ranges=7)
        assert got.count() == 1000 and got.select("id").distinct().count() == 1000
        new = [r.id for r in got.filter("id >= 1000").orderBy("k").collect()]
        assert new == list(range(1000, 1000 + 666))


def test_numbering_of_empty_ids_only(spark):
    df = spark.createDataFrame([(5, None), (2, None)], "k long, id long")
    assert {r.k: r.id for r in items.number_missing_ids(df, "k").collect()} == {2: 1, 5: 2}


def test_content_document(spark):
    df = spark.createDataFrame(
        [(0, 1, "T", "O", ["a", "b"], None, 86400 * 365), (1, 2, "", "0", [], None, 0), (2, 3, "N", "", ["g"], None, -1)], ITEM)
    cols = [F.col(c) for c in ("title", "overview", "genres", "release_date")]
    extra = [F.array(F.lit("k1"), F.lit("k2")), scalars.no_strings(), F.lit("0")]
    assert one(df.orderBy("item_key"), scalars.content_document(*cols)) == [
        "title: T\nyear: 1971\ngenres: a, b\noverview: O", "title: ", "title: N\nyear: 1969\ngenres: g"]
    assert one(df.filter("item_key = 1"), scalars.content_document(*cols, *extra)) == ["title: \nkeywords: k1, k2"]


def test_release_year_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.createDataFrame([(946684800,), (946684799,), (0,), (None,)], "t long")
        assert one(df, scalars.release_year(F.col("t"))) == [2000, 1999, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_parse_vector(spark):
    df = spark.createDataFrame([(s,) for s in ("[0.1,-2,3e-4]", "[]", "", "0", None, "[1.5abc,x]", "[ 7]")], "s string")
    assert one(df, vectors.parse_vector(F.col("s"))) == [[0.1, -2.0, 3e-4], [0.0], None, None, None, [1.5, 0.0], [7.0]]


def test_format_vector_round_trip(spark):
    df = spark.createDataFrame([([0.5, -2.0],)], "v array<double>")
    assert one(df, vectors.format_vector(F.col("v"))) == ["[0.5,-2.0]"]
    assert one(df, vectors.parse_vector(vectors.format_vector(F.col("v")))) == [[0.5, -2.0]]


def test_vector_checks(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, None],), ([1.0, float("nan")],), (None,)], "v array<double>")
    assert one(df, vectors.is_valid_vector(F.col("v"), 2)) == [True, False, False, False, False]


def test_zero_vector_has_no_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    vectors.register_sql_functions(spark)
    assert one(df, vectors.cosine_similarity(F.col("a"), F.col("b"))) == [None]
    assert df.selectExpr("cosine_similarity(a, b)").head()[0] is None
    assert one(df, vectors.l2_distance(F.col("a"), F.col("b"))) == [1.0]


def test_genres(spark):
    df = spark.createDataFrame([('["a","b"]',), ('"Sci-Fi"',), (None,), ("[]",)], "g string")
    assert one(df, scalars.genres_normalise(F.parse_json("g"))) == [["a", "b"], ["Sci-Fi"], [], []]


def test_metadata_unpack(spark):
    rows = [(1, None), (2, '{"movie_id": 12, "title": "T", "genres": ["a"], "release_date": 5}'),
            (3, '{"movie_id": "12"}'), (4, '{"movie_id": "x"}'), (5, "{}")]
    got = {r.k: r for r in items.metadata_unpack(spark.createDataFrame(rows, "k int, metadata string")).collect()}
    assert set(got) == {2, 3, 4, 5}
    assert (got[2].tmdb_id, got[2].title, got[2].genres, got[2].release_date, got[2].cast_failed) == (12, "T", '["a"]', 5, False)
    assert got[3].tmdb_id == 12 and not got[3].cast_failed
    assert got[4].tmdb_id is None and got[4].cast_failed
    assert got[5].genres is None and not got[5].cast_failed


@pytest.mark.parametrize("ratio,want", [(None, 0.3), ("0.45", 0.45), ("7", 1.0), ("-1", 0.0), ("abc", 0.0), ("0.5x", 0.5)])
def test_ratio(spark, ratio, want):
    df = spark.createDataFrame([("q", "text", ratio, None)], "query_id string, q string, ratio string, `limit` string")
    row = items.query_prepare(df).head()
    assert row.semantic_ratio == want and row["limit"] == 20 and row.accepted


def test_refused_queries(spark):
    df = spark.createDataFrame([("", None, "3"), ("0", None, "x"), (None, None, None), ("a", None, None)],
                               "q string, ratio string, `limit` string").withColumn("query_id", F.lit(1))
    got = items.query_prepare(df).collect()
    assert [r.accepted for r in got] == [False, False, False, True]
    assert [r["limit"] for r in got][:2] == [3, 0]


def test_cards(spark):
    df = spark.createDataFrame([(1, 1, "t", list("abcd"), "", 0.0), (1, 2, "t", None, "p", 1.23456), (1, 3, "t", [], None, None)],
                               "query_id int, doc_id int, title string, genres array<string>, poster string, score double")
    got = items.result_cards(df).orderBy("doc_id").collect()
    assert [r.score for r in got] == ["N/A", "1.235", "N/A"]
    assert got[0].genres == ["a", "b", "c"] and got[0].poster == got[2].poster == scalars.POSTER_PLACEHOLDER


def test_import_limit(spark):
    df = spark.range(10)
    assert items.import_limit(df, None).count() == items.import_limit(df, 0).count() == items.import_limit(df, 99).count() == 10
    assert [r.id for r in items.import_limit(df, 3).collect()] == [0, 1, 2]


def test_hits_without_a_document_stay(spark, monkeypatch):
    hits = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8), (2, 10, 1, 0.7)], "query_id int, doc_id long, rank int, score double")
    corpus = spark.createDataFrame([(10, "t", None, None, None, 5)],
                                   "doc_id long, title string, overview string, genres array<string>, poster string, release_date long")
    for pushed in (2_000, 0):
        monkeypatch.setattr(items, "PUSHED_IDS", pushed)
        got = {(r.query_id, r.doc_id): (r.title, r.release_date) for r in items.hit_projection(hits, corpus).collect()}
        assert got == {(1, 10): ("t", 5), (1, 11): ("Unknown", None), (2, 10): ("t", 5)}


def test_hit_ids_reach_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang")).write.parquet(str(tmp_path / "docs"))
    hits = spark.createDataFrame([(1, 10), (1, 11)], "query_id int, doc_id long")
    joined = items.with_payload(hits, spark.read.parquet(str(tmp_path / "docs")))
    assert "In(doc_id, [10,11])" in joined._jdf.queryExecution().toString()


def test_unpacked_numbers_are_long_and_broken_metadata_is_marked(spark):
    df = spark.createDataFrame([('{"movie_id": 5000000000, "release_date": 4102444800}',), ("oops",)], "metadata string")
    got = items.metadata_unpack(df)
    assert dict(got.dtypes)["tmdb_id"] == dict(got.dtypes)["release_date"] == "bigint"
    assert [(r.tmdb_id, r.release_date, r.cast_failed) for r in got.orderBy(F.desc("tmdb_id")).collect()] == [
        (5000000000, 4102444800, False), (None, None, True)]


def test_counts_and_overlaps_of_queries_without_hits(spark):
    from rankweave.operators import fusion, reports
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id int, doc_id long, rank int")
    two = spark.createDataFrame([(1, 11, 1)], "query_id int, doc_id long, rank int")
    assert {r.query_id: r.hits for r in reports.hit_counts(queries, one).collect()} == {1: 2, 2: 1, 3: 0}
    got = {r.query_id: (r.shared, r.overlap, r.mean_rank_gap) for r in fusion.overlap(queries, {"b": one, "a": two}, 2).collect()}
    assert got == {1: (1, 0.5, 1.0), 2: (0, 0.0, None), 3: (0, 0.0, None)}
