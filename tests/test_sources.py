import json

import pytest
from pyspark.sql import functions as F

from rankweave.operators import reports
from rankweave.sources import corpus_store, json_items
from rankweave.streaming import incremental

ROWS = [
    {"id": 1, "title": "A", "overview": "o", "genres": ["g"], "poster": "p", "release_date": 5},
    {}, {"id": "12", "title": 7, "genres": None}, {"id": "x", "title": "bad id"},
    {"id": 4, "genres": "Drama"}, {"id": 5, "title": {"a": 1}}, {"id": 6, "release_date": "soon"},
]


def problems(df):
    return sorted((r.problem or "") for r in df.collect())


def test_array_file_and_lines_agree(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ROWS))
    (tmp_path / "l.json").write_text("\n".join(json.dumps(r) for r in ROWS))
    array = json_items.check_items(json_items.load_items(spark, str(tmp_path / "a.json"), array=True))
    lines = json_items.check_items(json_items.load_items(spark, str(tmp_path / "l.json")))
    assert problems(array) == problems(lines) == ["", "", "", "genres", "id", "release_date", "title"]
    good = {r.id: r for r in json_items.good_items(array).collect()}
    assert good[1].genres == ["g"] and good[12].title == "7" and good[None].title is None
    report = reports.import_report(lines).head()
    assert (report.total, report.errors) == (7, 4)
    assert json_items.error_sample(lines).count() == 4


def test_bad_files(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        json_items.load_items(spark, str(tmp_path / "none.json"))
    (tmp_path / "broken.json").write_text('[{"id": 1}, oops')
    with pytest.raises(Exception):
        json_items.load_items(spark, str(tmp_path / "broken.json"), array=True).collect()
    (tmp_path / "line.json").write_text('{"id": 1}\nnot json\n{"id": 2}')
    checked = json_items.check_items(json_items.load_items(spark, str(tmp_path / "line.json")))
    assert problems(checked) == ["", "", "not JSON"]


def corpus_rows(spark, rows):
    schema = "doc_id string, embedding array<float>"
    return spark.createDataFrame(rows, schema).select(
        "doc_id", F.lit(1).cast("long").alias("item_id"), F.lit("c").alias("content"), F.lit("t").alias("title"),
        F.lit("o").alias("overview"), F.array(F.lit("g")).alias("genres"), F.lit("p").alias("poster"),
        F.lit(0).cast("long").alias("release_date"), "embedding", F.lit("{}").alias("metadata"))


def test_setup_add_reset_drop(spark):
    corpus_store.drop(spark, "films")
    corpus_store.setup(spark, "films", 2)
    corpus_store.setup(spark, "films", 2)
    refused = corpus_store.add_documents(corpus_rows(spark, [("a", [1.0, 2.0]), ("b", [1.0]), ("c", None)]), "films")
    assert [r.doc_id for r in refused.collect()] == ["b"]
    assert sorted(r.doc_id for r in spark.table("films").collect()) == ["a", "c"]
    corpus_store.reset(spark, "films", 3)
    assert spark.table("films").count() == 0 and corpus_store.dimension(spark, "films") == 3
    corpus_store.drop(spark, "films")
    assert not spark.catalog.tableExists("films")


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "doc_id int, v string")
    assert sorted(map(tuple, corpus_store.upsert(old, new).collect())) == [(1, "a"), (2, "B"), (3, "C")]


def test_upsert_keeps_one_row_per_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string")
    new = spark.createDataFrame([(2, "B", 2), (2, "z", 1), (3, "C", 1), (None, "n", 1), (None, "m", 1)], "doc_id int, v string, at int")
    got = sorted(map(str, map(tuple, corpus_store.upsert(old, new, order="at").collect())))
    assert got == ["(1, 'a')", "(2, 'B')", "(3, 'C')", "(None, 'm')", "(None, 'n')"]
    plain = corpus_store.upsert(old, new.drop("at").filter("doc_id = 2"))
    assert sorted(map(tuple, plain.collect())) == [(1, "a"), (2, "z")]


def test_delete_keeps_rows_without_the_key(spark):
    df = spark.createDataFrame([(1, '{"test": "true"}'), (2, '{"test": "false"}'), (3, "{}"), (4, None), (5, '{"test": true}'), (6, "oops")],
                               "k int, metadata string")
    assert sorted(r.k for r in corpus_store.delete_by_metadata(df, "test", "true").collect()) == [2, 3, 4, 6]


def test_stream_import(spark, tmp_path):
    source, target, progress, refused = (str(tmp_path / d) for d in ("in", "out", "progress", "refused"))
    (tmp_path / "in").mkdir()

    def arrive(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        stream = incremental.stream_items(spark, source, 1)
        incremental.import_available(stream, target, progress, json_items.check_items, refused)
        return {r.id: r.title for r in incremental.current_rows(spark, target, "id").collect()}

    arrive("1.json", {"id": 1, "title": "a"}, {"id": 2, "title": "b"}, {"id": "x"})
    (tmp_path / "later").write_text('{"title": "n1"}\n{"title": "n2"}')
    arrive("2.json", {"id": 3, "title": "c"})
    assert run() == {1: "a", 2: "b", 3: "c"}
    arrive("3.json", {"id": 2, "title": "B"}, {"id": 4, "title": "d"})
    assert run() == {1: "a", 2: "B", 3: "c", 4: "d"}
    assert run() == {1: "a", 2: "B", 3: "c", 4: "d"}  # nothing new: nothing imported twice
    (tmp_path / "later").rename(tmp_path / "in" / "4.json")
    run()
    kept = incremental.current_rows(spark, target, "id").filter("id IS NULL").collect()
    assert sorted(r.title for r in kept) == ["n1", "n2"]  # rows without a key all stay
    bad = spark.read.parquet(refused)
    assert [r.problem for r in bad.collect()] == ["id"] and reports.import_report(bad).head().errors == 1
    # Of two versions in one batch the last to arrive counts, not the larger one.
    arrive("5.json", {"id": 1, "title": "z"}, {"id": 1, "title": "last"})
    assert run()[1] == "last"
    compacted = incremental.compact(spark, target, str(tmp_path / "compact"), "id")
    assert {r.id: r.title for r in compacted.filter("id IS NOT NULL").collect()} == {1: "last", 2: "B", 3: "c", 4: "d"}


def test_array_files_stay_bounded(spark):
    import json

    from workload import queries

    part = spark.range(1000).selectExpr("id AS p_partkey", "'n' AS p_name", "'hot' AS p_brand", "1 AS p_size", "'t' AS p_type")
    files = queries.array_files(part, 100).collect()
    items = [[x["id"] for x in json.loads(r["value"])] for r in files]
    assert len({r["file"] for r in files}) == 10 and max(map(len, items)) == 100
    assert sorted(i for x in items for i in x) == list(range(1000))


def test_array_files_grow_with_blocks_only(spark):
    """Many brands and sizes do not multiply the files; items without a key keep theirs."""
    import json

    from workload import queries

    part = spark.range(1000).selectExpr(
        "IF(id % 100 = 0, null, id) AS p_partkey", "'n' AS p_name", "concat('b', id % 25) AS p_brand", "CAST(id % 50 AS int) AS p_size", "'t' AS p_type")
    files = queries.array_files(part, 500).collect()
    named = [r for r in files if not r["file"].startswith("none")]
    assert len(named) == 2 and sum(len(json.loads(r["value"])) for r in files) == 1000
