from pyspark.sql import functions as F

from rankweave.functions import enrichment
from rankweave.operators.enrich import enrich, nest_payload, reduce_payload
from rankweave.schema import ENRICHMENT_PAYLOAD


def payload(spark, keywords, cast, crew, item=1):
    row = (item, {"keywords": {"keywords": [{"name": k} for k in keywords]},
                  "credits": {"cast": [{"name": n, "character": c} for n, c in cast],
                              "crew": [{"job": j, "name": n} for j, n in crew]}})
    return spark.createDataFrame([row], f"item_id long, payload {ENRICHMENT_PAYLOAD}")


def test_keywords_drop_then_slice(spark):
    names = [None, "k1", None] + [f"k{i}" for i in range(2, 20)]
    got = reduce_payload(payload(spark, names, [], [])).head()
    assert got.keywords == [f"k{i}" for i in range(1, 16)]
    assert got.characters == [] and got.director is None


def test_characters(spark):
    cast = [("Ann", "Bob (voice)"), ("Ann", "Bob (voice) Smith"), ("", "X"), ("0", "é"), (None, "(uncredited)"),
            ("Cy", "0"), ("Di", None), ("Ed", " Zed\t"), ("Late", "Later")]
    got = reduce_payload(payload(spark, [], cast, [])).head()
    assert got.characters == ["Ann", "Bob", "BobSmith", "é", "Cy", "Di", "Ed", "Zed"]


def test_director_is_the_first(spark):
    crew = [("Writer", "W"), ("Director", None), ("Director", "D")]
    assert reduce_payload(payload(spark, [], [], crew)).head().director is None
    assert reduce_payload(payload(spark, [], [], crew[2:])).head().director == "D"


def test_role_cleaning(spark):
    df = spark.createDataFrame([(r,) for r in ("X", "é", "(uncredited)", "0", "A (b) (c) D", None)], "r string")
    assert [r[0] for r in df.select(enrichment.clean_role(F.col("r"))).collect()] == [None, "é", None, None, "AD", None]


def test_missing_enrichment_keeps_the_item(spark):
    items = spark.createDataFrame([(1,), (2,)], "id long")
    got = {r.id: r for r in enrich(items, payload(spark, ["k"], [], [("Director", "D")])).collect()}
    assert got[1].keywords == ["k"] and got[1].director == "D"
    assert got[2].keywords == [] and got[2].characters == [] and got[2].director is None


def test_null_payload(spark):
    df = spark.createDataFrame([(1, None)], f"item_id long, payload {ENRICHMENT_PAYLOAD}")
    got = reduce_payload(df).head()
    assert got.keywords == [] and got.characters == [] and got.director is None


def test_nesting_a_hot_item_equals_nesting_everything(spark):
    """One item owns nearly all rows; only what counts is gathered."""
    rows = spark.range(20000).select(
        F.when(F.col("id") < 19990, 1).otherwise(F.col("id")).alias("item_id"), F.col("id").alias("ord"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("n"), F.col("id").cast("string"))).alias("name"))
    cast = rows.withColumn("character", F.lit(None).cast("string"))
    crew = rows.withColumn("job", F.when(F.col("ord") > 100, "Director").otherwise("Writer"))
    got = {r.item_id: r for r in reduce_payload(nest_payload(rows, cast, crew)).collect()}
    assert got[1].keywords == [f"n{i}" for i in range(1, 30, 2)]
    assert got[1].characters == ["n1", "n3", "n5", "n7"]
    assert got[1].director == "n101"
