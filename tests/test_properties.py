"""What must hold whatever the data, the partitioning or the physical path."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave import session
from rankweave.functions.text import LANGUAGES, Analyzer, english_stems, stems, stop_words
from rankweave.operators import fusion, fuzzy, knn, lexical, topk
from rankweave.plans.index import build_index, catalog_name, open_index, shards_for

rng = random.Random(7)
WORDS = [a + b for a in ("alp", "bet", "gam", "del", "eps") for b in ("ha", "in", "ot", "er", "um", "st")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    return spark.createDataFrame(texts, "doc_id long, content string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 1 + i % 3))) for i in range(9)], "query_id int, q string")


@pytest.fixture(scope="module")
def index(docs):
    return build_index(docs, {"content": F.col("content")}, Analyzer("simple"))


@pytest.fixture(scope="module")
def vectors(spark):
    g = np.random.default_rng(3)
    data = [(i, [float(x) for x in g.integers(-3, 4, 6)]) for i in range(400)]
    return spark.createDataFrame(data + [(400, [0.0] * 6), (401, None), (402, [1.0])], "doc_id long, embedding array<float>")


@pytest.fixture(scope="module")
def vector_queries(spark):
    g = np.random.default_rng(4)
    return spark.createDataFrame([(i, [float(x) for x in g.integers(-3, 4, 6)]) for i in range(11)], "query_id int, query_vec array<float>")


def test_postings_match_a_plain_count(docs, index):
    want = {}
    for d, text in docs.collect():
        words = text.split()
        for pos, w in enumerate(words, 1):
            want.setdefault((d, w), []).append(pos)
    got = {(r.doc_id, r.term): (r.tf, list(r.positions)) for r in index.postings.collect()}
    assert got == {k: (len(v), v) for k, v in want.items()}


def test_bm25_against_brute_force(docs, queries, index):
    texts = {d: t.split() for d, t in docs.collect()}
    n, avg = len(texts), np.mean([len(t) for t in texts.values()])
    got = {(r.query_id, r.doc_id): r.score for r in lexical.bm25_scores(queries, index).collect()}
    want = {}
    for qid, q in queries.collect():
        for term in set(q.split()):
            df = sum(term in t for t in texts.values())
            for d, t in texts.items():
                tf = t.count(term)
                if tf:
                    s = np.log(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(t) / avg))
                    want[qid, d] = want.get((qid, d), 0) + s
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_cover_density_against_brute_force(docs, queries, index):
    texts = {d: t.split() for d, t in docs.collect()}
    got = {(r.query_id, r.doc_id): r.score for r in lexical.native_search(queries, index, None).collect()}
    want = {}
    for qid, q in queries.collect():
        terms = set(q.split())
        for d, t in texts.items():
            spans = [(i, j) for i in range(len(t)) for j in range(i, len(t)) if terms <= set(t[i:j + 1])]
            minimal = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
            if minimal:
                want[qid, d] = round(sum(min(1.0, 16.0 / (j - i + 1)) for i, j in minimal), 6)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_score_grows_with_frequency(spark):
    texts = [(i, "x " * (i + 1) + "y " * (19 - i)) for i in range(20)]
    ix = build_index(spark.createDataFrame(texts, "doc_id long, content string"), {"content": F.col("content")}, Analyzer("simple"))
    q = spark.createDataFrame([(1, "x")], "query_id int, q string")
    scores = [r.score for r in lexical.bm25_scores(q, ix).orderBy("doc_id").collect()]
    assert scores == sorted(scores) and len(set(scores)) == 20


def test_lexical_paths_agree(queries, index, monkeypatch):
    want = [rows(f(queries, index)) for f in (lexical.bm25_search, lexical.keyword_search, lexical.native_search)]
    monkeypatch.setattr(lexical, "MAX_BROADCAST_ROWS", 8)
    assert [rows(f(queries, index)) for f in (lexical.bm25_search, lexical.keyword_search, lexical.native_search)] == want


@pytest.mark.parametrize("search", [lexical.bm25_search, lexical.keyword_search, lexical.native_search])
def test_blocks_hold_few_pairs_of_a_shard(spark, monkeypatch, queries, index, search):
    """More queries or documents in a shard give more blocks, with the same answers."""
    whole, asked = rows(search(queries, index, 7)), []
    monkeypatch.setattr(lexical, "MAX_PAIRS", 40)
    terms = lexical.query_terms
    monkeypatch.setattr(lexical, "query_terms", lambda some, index: asked.append([r.query_id for r in some.collect()]) or terms(some, index))
    assert rows(search(queries, index, 7)) == whole
    blocks = [ids for ids in asked if len(ids) < 9]
    assert blocks and sorted({i for ids in blocks for i in ids}) == list(range(9))


def test_pairs_in_a_shard_are_bounded_by_the_postings(spark, monkeypatch, queries, index):
    """Never fewer than there are, and for words that few texts hold no more than their postings."""
    monkeypatch.setattr(lexical, "MAX_PAIRS", 1)
    def bound(some):
        wanted = lexical.query_terms(some, index)
        return lexical.shard_pairs(wanted, wanted.count(), some.count(), index)
    assert lexical.bm25_scores(queries, index).count() // index.shards <= bound(queries) <= 9 * 120 // index.shards
    assert bound(queries.withColumn("q", F.lit("absent"))) == 0


def test_shards_do_not_matter(docs, queries, index):
    other = build_index(docs, {"content": F.col("content")}, Analyzer("simple"), shards=3, buckets=7)
    assert rows(lexical.bm25_search(queries, other)) == rows(lexical.bm25_search(queries, index))


def test_fuzzy_paths_agree(queries, index, monkeypatch):
    words = fuzzy.query_words(queries.withColumn("q", F.concat("q", F.lit(" alphx btain")))).select("word").distinct()
    want = rows(fuzzy.similar_terms(words, fuzzy.vocabulary_of(index)))
    hits = rows(fuzzy.fuzzy_search(queries, index))
    monkeypatch.setattr(fuzzy, "CHUNK_CELLS", 64)
    assert rows(fuzzy.fuzzy_search(queries, index)) == hits
    monkeypatch.setattr(fuzzy, "MAX_PAIRS", 40)
    assert rows(fuzzy.fuzzy_search(queries, index)) == hits
    monkeypatch.setattr(fuzzy, "MAX_WORDS", 6)
    assert rows(fuzzy.similar_terms(words, fuzzy.vocabulary_of(index))) == want
    assert rows(fuzzy.fuzzy_search(queries, index)) == hits


def test_fuzzy_scores_against_brute_force(docs, queries, index):
    grams = lambda w: {f"  {w} "[i:i + 3] for i in range(len(w) + 1)}
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    texts = {d: set(t.split()) for d, t in docs.collect()}
    asked = {q: text.split() + ["alphx"] for q, text in queries.collect()}
    got = fuzzy.fuzzy_search(queries.withColumn("q", F.concat("q", F.lit(" alphx"))), index, 500)
    want = {}
    for q, words in asked.items():
        for d, terms in texts.items():
            best = [max((s for s in (alike(w, t) for t in terms) if s >= 0.2), default=0) for w in set(words)]
            if any(best):
                want[q, d] = round(sum(best) / len(best), 6)
    found = {(r.query_id, r.doc_id): r.score for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 2e-6 for k in want)


def test_fuzzy_moves_only_the_best(queries, index):
    df = fuzzy.fuzzy_search(queries, index)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("WindowGroupLimit") < plan.index("MapInArrow")


def test_fuzzy_against_brute_force(index):
    grams = lambda w: {f"  {w} "[i:i + 3] for i in range(len(w) + 1)}
    words = index.terms.select(F.regexp_replace("term", "a", "").alias("word")).distinct()
    want = set()
    for (w,) in words.collect():
        for (t,) in index.terms.select("term").collect():
            s = len(grams(w) & grams(t)) / len(grams(w) | grams(t))
            if s >= 0.2:
                want.add((w, t, round(s, 6)))
    got = fuzzy.similar_terms(words, fuzzy.vocabulary_of(index)).withColumn("similarity", F.round("similarity", 6))
    assert set(rows(got)) == want


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product"])
def test_nearest_against_brute_force(vectors, vector_queries, metric):
    got = knn.nearest(vectors, vector_queries, 15, metric=metric).collect()
    data = {r.doc_id: np.array(r.embedding) for r in vectors.filter("size(embedding) = 6").collect()}
    for qid, q in vector_queries.collect():
        q = np.array(q)
        score = {}
        for d, v in data.items():
            if metric == "l2":
                score[d] = np.linalg.norm(q - v)
            elif metric == "inner_product":
                score[d] = q @ v
            elif np.linalg.norm(v):
                score[d] = q @ v / np.linalg.norm(q) / np.linalg.norm(v)
        sign = 1 if metric == "l2" else -1
        want = sorted(score, key=lambda d: (sign * round(score[d], 6), d))[:15]
        mine = sorted((r for r in got if r.query_id == qid), key=lambda r: r.rank)
        assert [r.doc_id for r in mine] == want
        assert np.allclose([r.score for r in mine], [score[d] for d in want], atol=1e-6)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_paths_agree(vectors, vector_queries, metric):
    few = rows(knn.nearest(vectors, vector_queries, 5, metric=metric))
    many = rows(knn.nearest(vectors, vector_queries, 5, metric=metric, query_bytes=48 * 4))
    assert few == many and len(few) == 55


def test_one_bad_vector_costs_only_itself(spark, vectors, vector_queries):
    want = rows(knn.nearest(vectors, vector_queries, 5))
    bad = spark.createDataFrame([(-1, [1.0]), (-2, None)], "query_id int, query_vec array<float>")
    for asked in (bad.union(vector_queries), vector_queries.union(bad)):
        assert rows(knn.nearest(vectors, asked.coalesce(1), 5)) == want
        assert rows(knn.nearest(vectors, asked.coalesce(1), 5, dim=6)) == want
        assert [r.query_id for r in knn.misfits(asked, "query_vec", 6).collect()] == [-1]


def test_maximum_distance(vectors, vector_queries):
    everything = rows(knn.nearest(vectors, vector_queries, 500))
    near = rows(knn.nearest(vectors, vector_queries, 500, max_distance=0.4))
    assert near == [r for r in everything if r[2] >= 0.6] and near


def test_cells(spark, vector_queries):
    g = np.random.default_rng(5)
    # A third of all vectors are the same point: one cell holds them all.
    data = [(i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0] if i % 3 == 0 else [float(x) for x in g.normal(size=6)]) for i in range(600)]
    corpus = spark.createDataFrame(data, "doc_id long, embedding array<float>")
    ix = knn.build_cells(corpus, 8)
    exact = set((r.query_id, r.doc_id) for r in knn.nearest(corpus, vector_queries, 10).collect())
    assert rows(knn.nearest_in_cells(ix, vector_queries, 10, probes=8)) == rows(knn.nearest(corpus, vector_queries, 10))
    recalls = []
    for probes in (1, 3, 5):
        found = set((r.query_id, r.doc_id) for r in knn.nearest_in_cells(ix, vector_queries, 10, probes=probes).collect())
        recalls.append(len(found & exact) / len(exact))
        assert recalls[-1] > knn.scanned_share(ix, vector_queries, probes)
    assert recalls == sorted(recalls)
    # More queries than a block holds probe the same cells.
    for probes in (1, 3):
        assert rows(knn.nearest_in_cells(ix, vector_queries, 10, probes=probes, query_bytes=48 * 3)) == rows(
            knn.nearest_in_cells(ix, vector_queries, 10, probes=probes))
    given = knn.build_cells(corpus, 2, centers=[[1.0, 2, 3, 0, 0, 0], [-1.0, -2, -3, 0, 0, 0]])
    side = {r.doc_id: r.cell for r in given.docs.collect()}
    vecs = {d: np.array(v) @ np.array([1, 2, 3, 0, 0, 0]) for d, v in data}
    assert all(side[d] == (0 if v >= 0 else 1) for d, v in vecs.items() if abs(v) > 1e-3)


def test_fusion_ignores_row_order_and_ends_are_single_lists(queries, index, vectors, vector_queries):
    q = queries.join(vector_queries, "query_id")
    lists = {"lexical": lexical.bm25_search(q, index, 100), "semantic": knn.nearest(vectors, q, 100)}
    want = rows(fusion.fuse(q, lists))
    shuffled = {k: v.repartition(5).orderBy(F.rand(1)) for k, v in lists.items()}
    assert rows(fusion.fuse(q, shuffled)) == want
    for ratio, name in ((0.0, "lexical"), (1.0, "semantic")):
        hits = fusion.fuse(q.withColumn("semantic_ratio", F.lit(ratio)), lists, limit=None)
        single = lists[name].select("query_id", "doc_id", "rank")
        assert rows(hits.select("query_id", "doc_id", "rank")) == rows(single)


def test_best_equals_the_window(vectors):
    df = vectors.select("doc_id", (F.col("doc_id") % 7).alias("score"), F.lit(1).alias("query_id"))
    assert [r.doc_id for r in topk.best(df, 9).collect()] == [r.doc_id for r in topk.top_k(df, 9).orderBy("rank").collect()]


def test_porter_examples(spark):
    """Words and stems as published with the algorithm."""
    want = dict(zip(
        "caresses ponies ties caress cats feed agreed plastered motoring sing conflated troubled sized hopping falling "
        "hissing failing filing happy sky relational conditional rational digitizer operator feudalism decisiveness "
        "hopefulness formative formalize electrical goodness revival inference airliner adjustable replacement "
        "adjustment dependent adoption homologous effective probate rate cease controll roll".split(),
        "caress poni ti caress cat feed agre plaster motor sing conflat troubl size hop fall hiss fail file happi sky "
        "relat condit ration digit oper feudal decis hope form formal electr good reviv infer airlin adjust replac "
        "adjust depend adopt homolog effect probat rate ceas control roll".split()))
    df = spark.createDataFrame([(list(want),)], "w array<string>")
    assert df.select(stems(F.col("w"), "en")).head()[0] == list(want.values())


def test_languages(spark):
    df = spark.createDataFrame([("The running dogs of l'été",)], "t string")
    assert df.select(Analyzer("simple").terms(F.col("t"))).head()[0] == ["the", "running", "dogs", "of", "l", "été"]
    assert df.select(Analyzer("english").terms(F.col("t"))).head()[0] == ["run", "dog", "l", "été"]
    assert df.select(Analyzer("english").occurrences(F.col("t"))).head()[0][0] == ("dog", 3)
    kept = Analyzer("simple", separators=("u",), symbols=("'",))
    assert df.select(kept.terms(F.col("t"))).head()[0] == ["the", "r", "nning", "dogs", "of", "l'été"]


def test_stems_of_distinct_words_are_the_column_stems(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = F.transform(F.split(F.lower("text"), "[^a-zé]+"), lambda w: F.when(w != "the", w))
    made = docs.select(english_stems(words).alias("a"), stems(words, "en").alias("b"))
    assert made.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    odd = spark.createDataFrame([(None,), ([],), (["", None, "y", "yes", "sses", "ies", "eed", "ing", "ll"],)], "w array<string>")
    assert odd.select(english_stems(F.col("w"))).collect() == odd.select(stems(F.col("w"), "en")).collect()


def test_stop_words_are_those_spark_ships(spark):
    from pyspark.ml.feature import StopWordsRemover
    for name in ("english", "french", "german", "spanish", "italian", "portuguese", "dutch", "russian"):
        assert stop_words(name) == tuple(StopWordsRemover.loadDefaultStopWords(name))


def test_every_language_analyses_and_others_are_refused(spark):
    texts = {"ar": "في المدرسة", "zh": "电影 的", "ru": "красивые фильмы и книги"}
    df = spark.createDataFrame([(t,) for t in texts.values()], "t string")
    for code in LANGUAGES:
        assert df.select(Analyzer(code).terms(F.col("t"))).count() == 3
    got = {c: spark.createDataFrame([(t,)], "t string").select(Analyzer(c).terms(F.col("t"))).head()[0] for c, t in texts.items()}
    assert got == {"ar": ["مدرس"], "zh": ["电影"], "ru": ["красив", "фильм", "книг"]}
    with pytest.raises(ValueError, match="no text analysis"):
        Analyzer("xx").terms(F.col("t"))


def test_an_index_is_found_by_its_whole_path(spark, docs, queries, tmp_path):
    a, b = (f"{tmp_path}/{d}/idx" for d in "ab")
    first = build_index(docs, {"content": F.col("content")}, Analyzer("simple"), a)
    want = rows(lexical.bm25_search(queries, first))
    build_index(docs.limit(5), {"content": F.col("content")}, Analyzer("english"), b)
    assert rows(lexical.bm25_search(queries, first)) == want
    with pytest.raises(FileExistsError):
        build_index(docs, {"content": F.col("content")}, Analyzer("simple"), a)
    other = spark.newSession()
    for kind in ("postings", "terms"):  # forget the tables, not the files
        spark.sql(f"DROP TABLE {catalog_name(a)}_{kind}")
    again = open_index(other, a)
    assert again.analyzer == Analyzer("simple") and again.fields == ("content",)
    assert rows(lexical.bm25_search(queries, again)) == want
    assert shards_for(0) == 8 and shards_for(10 ** 14) > 100_000


def test_cover_density_refuses_several_fields(queries, docs):
    ix = build_index(docs, {"a": F.col("content"), "b": F.col("content")}, Analyzer("simple"))
    with pytest.raises(ValueError, match="one field"):
        lexical.native_search(queries, ix)
    one = build_index(docs, {"a": F.col("content")}, Analyzer("simple"))
    found = lambda i: sorted((r.query_id, r.doc_id) for r in lexical.all_terms_match(queries, i).collect())
    assert found(ix) == found(one)
    assert max(r.score for r in lexical.all_terms_match(queries, ix).collect()) <= 1


def test_size_check(spark):
    assert session.holds_at_most(spark.range(10), 10) and not session.holds_at_most(spark.range(11), 10)


def test_shards_stay_small():
    """A shard is the work of one task: its text does not grow with the corpus."""
    for size in (10 ** 9, 10 ** 10, 10 ** 12):
        assert size / shards_for(size) <= 64 << 20


def test_postings_of_odd_texts(spark, monkeypatch):
    """Counting some tokens at a time gives the same postings: null, empty and stop-word texts, repeated ids."""
    from rankweave.plans import index as ix

    texts = [(1, "b a b the a b"), (2, None), (3, ""), (4, "the"), (4, "running runs the ran"), (None, "a1 zz"), (5, "dog " * 50)]
    corpus = spark.createDataFrame(texts, "doc_id long, content string").coalesce(1)
    count = lambda: sorted(((r.field, r.term, r.doc_id or 0, r.tf, r.doc_len, r.positions) for r in ix.postings_of(
        corpus, {"x": F.col("content"), "y": F.lit("Run")}, Analyzer("english")).collect()))
    want = count()
    assert [w[1:] for w in want if w[0] == "x" and w[2] in (1, 4)] == [
        ("b", 1, 3, 3, [1, 3, 6]), ("ran", 4, 1, 3, [4]), ("run", 4, 2, 3, [1, 2])]
    assert ("x", "dog", 5, 50, 50, list(range(1, 51))) in want and sum(w[0] == "y" for w in want) == 7
    lengths = ix.doc_lengths(corpus, {"x": F.col("content")}, Analyzer("english")).collect()
    assert sorted((r.doc_id or 0, -1 if r.doc_len is None else r.doc_len) for r in lengths) == [
        (0, 2), (1, 3), (2, -1), (3, 0), (4, 0), (4, 3), (5, 50)]
    monkeypatch.setattr(ix, "BATCH_TOKENS", 3)
    assert count() == want


def test_positions_are_read_for_whole_matches_only(queries, docs, spark):
    """Positions meet no document that lacks a term; a row without an id is still found."""
    odd = docs.unionByName(docs.limit(1).select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "content"))
    ix = build_index(odd, {"content": F.col("content")}, Analyzer("simple"))
    one = odd.filter("doc_id IS NULL").select(F.lit(-1).cast(queries.schema["query_id"].dataType).alias("query_id"), F.col("content").alias("q"))
    asked = queries.select("query_id", "q").unionByName(one)
    hits = lexical.native_search(asked, ix, None)
    found = {(r.query_id, r.doc_id) for r in hits.collect()}
    assert found == {(r.query_id, r.doc_id) for r in lexical.all_terms_match(asked, ix).collect()} and (-1, None) in found
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    gathered = plan[plan.index("collect_list(positions"):]
    assert "collect_set(query_id" in gathered and gathered.index("Join") < gathered.index("collect_set(query_id")


def test_fuzzy_reads_the_corpus_once(queries, index, monkeypatch):
    """More similar pairs than a task may hold split the task's documents, not the queries."""
    want = rows(fuzzy.fuzzy_search(queries, index))
    monkeypatch.setattr(fuzzy, "MAX_PAIRS", 3)
    hits = fuzzy.fuzzy_search(queries, index)
    assert rows(hits) == want
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_vocabulary_partitions_grow_with_it(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "VOCABULARY_TERMS", 10)
    vocabulary = spark.createDataFrame([(f"word{i}",) for i in range(400)], "term string")
    words = spark.createDataFrame([("word7",)], "word string")
    matrix, = fuzzy.word_blocks(words, 0.2)
    assert fuzzy.similar_pairs(matrix, vocabulary).rdd.getNumPartitions() == 40
    assert fuzzy.similar_terms(words, vocabulary).filter("similarity = 1").count() == 1


def test_word_matrix_on_odd_words(spark, monkeypatch):
    """Trigrams cut by numpy are those of `text.trigrams`; many steps and slices give the same similarities as sets do."""
    import pyarrow as pa

    from rankweave.functions.text import trigrams

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abé語𝒳 "), size)) for size in rng.integers(1, 12, 60)] + ["", "aaaaaaa", "a" * 300, "ab" * 200]
    words = sorted(set(words))
    rows_of = spark.createDataFrame([(w,) for w in words], "word string").select("word", trigrams(F.col("word")).alias("g")).collect()
    want = {r.word: set(r.g) for r in rows_of}
    terms = pa.array(["left out", *words]).slice(1)
    row, gram, grams = fuzzy.gram_codes(terms)
    text = lambda g: "".join(chr(g >> shift & 0x1FFFFF) for shift in (42, 21, 0))
    got = {w: [] for w in words}
    for r, g in zip(row, gram):
        got[words[r]].append(text(int(grams[g])))
    assert all(len(got[w]) == len(want[w]) and set(got[w]) == want[w] for w in words)

    alike = lambda a, b: len(want[a] & want[b]) / len(want[a] | want[b])
    near = {(t, w): alike(t, w) for t in words for w in words[::2] if alike(t, w) >= 0.2}
    for step, cells, some in ((fuzzy.CHUNK_CELLS, fuzzy.GRAM_CELLS, words[::2]), (1, 1, words[::2]), (300, 50, words[::2]), (300, 50, [])):
        monkeypatch.setattr(fuzzy, "CHUNK_CELLS", step)
        monkeypatch.setattr(fuzzy, "GRAM_CELLS", cells)
        matrix, found = fuzzy.WordMatrix(some, 0.2), {}
        for part, sizes, counts, columns, shared in matrix.compare(terms):
            similar = matrix.similarity(np.repeat(sizes, counts), columns, shared)
            assert counts.sum() == len(columns) == len(shared)
            found.update({(words[r], some[c]): s for r, c, s in zip(np.repeat(part, counts), columns, similar)})
        assert found == (near if some else {})


def test_fuzzy_splits_before_it_compares():
    """Once a task knows how many words a term resembles, it halves its documents before their terms are compared, not after."""
    import pyarrow as pa

    words = [f"{a}{b}alpha" for a in "abcdefgh" for b in "abcdefgh"]
    block = fuzzy.Similar(fuzzy.WordMatrix(words, 0.2), pa.table({"query_id": [1], "words": [words]}))
    compared, compare = [], block.matrix.compare
    block.matrix.compare = lambda terms: compared.append(len(terms)) or compare(terms)
    docs = pa.array([words[i:i + 4] for i in range(0, 64, 4)])
    whole = fuzzy.Best(1, 20)
    block.feed(whole, np.arange(16), docs)
    assert compared == [64] and block.rate > 1
    block.most = 64 * 64 // 4
    again = fuzzy.Best(1, 20)
    block.feed(again, np.arange(16), docs)
    assert compared[1:] == [16] * 4 and again.cut().equals(whole.cut())
