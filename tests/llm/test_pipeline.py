"""The pipeline, stage by stage, against brute force; the queries against their SQL."""

import pytest
from tokenizers import Tokenizer

import brute
import corpus_pipeline
import public_tokenizers as P
from parity import compare, connect
from rankweave.llm.oracle import SQL
from rankweave.llm.queries import QUERIES
from test_operators import check_pieces, text_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_answer(spark, name):
    got, want = compare(spark, connect(SF), SF, name, QUERIES[name], SQL[name])
    assert got == want


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(f"{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}"))
    for t in tables[:-1]:
        assert t.columns == docs.columns
    good, single, distinct = (text_rows(t) for t in tables[1:4])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in good}
    assert sum(i in kept for i, q in labels.items() if q) >= 0.98 * sum(labels.values())
    assert sum(i in kept for i, q in labels.items() if not q) <= 0.15 * sum(q == 0 for q in labels.values())
    first = {}
    for i, t in sorted(good):
        first.setdefault(brute.SPACE.sub(" ", t), i)
    assert {i for i, _ in single} == set(first.values())
    prints = {i: brute.simhash(t) for i, t in single}
    root = brute.reachable(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i for i, _ in distinct} == set(root.values())
    assert check_pieces(tables[3], [r.asDict() for r in tables[4].collect()], Tokenizer.from_file(P.path("word_bpe_49k.json"))) == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
