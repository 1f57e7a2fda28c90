"""Infix search by the gram index against a plain scan."""

from rankweave.operators import grams


def test_against_brute_force(spark):
    texts = [(1, "The Practitioner met a Petitioner"), (2, None), (3, ""), (4, "ab"), (5, "ÀBC àbc tion"),
             (6, "tioner tioner"), (7, "x")]
    needles = [(10, "tioner"), (11, "TION"), (12, None), (13, ""), (14, "ab"), (15, "x"), (16, "zzz"),
               (17, "àbc"), (18, "tioner"), (19, "b"), (20, "practitioner met a petitioner!")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame(needles, "needle_id long, needle string")
    got = sorted(tuple(r) for r in grams.infix_indexed(asked, grams.build_gram_index(docs)).collect())
    want = sorted((n, d) for n, needle in needles for d, text in texts
                  if needle and text is not None and needle.lower() in text.lower())
    assert got == want


def test_blocks_do_not_matter_and_keep_few_rows(spark, monkeypatch):
    """A gram is one row of a block, not of a document; small blocks and emoji give the same answers."""
    texts = [(i, f"common words 😀é here {i % 7}") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "words 😀é"), (2, "😀"), (3, "é "), (4, "here 3"), (5, "here 9")], "needle_id long, needle string")
    found = lambda: sorted({tuple(r) for r in grams.infix_indexed(asked, grams.build_gram_index(docs)).collect()})
    want = sorted({(n, d) for n, needle in [tuple(r) for r in asked.collect()] for d, text in texts if needle in text})
    index = grams.build_gram_index(docs)
    assert found() == want
    assert index.grams.count() == index.counts.count() < 100
    assert {r.df for r in index.counts.filter("gram = '😀é '").collect()} == {400}
    monkeypatch.setattr(grams, "BLOCK_POINTS", 50)
    assert found() == want
