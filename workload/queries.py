"""The registered queries: which table feeds which operator.

Tables stand in for the reference's inputs as follows. Items are `part` rows
with dates of `orders`; nulls are made from `p_size`, since the tables hold
none. Documents are `documents`, vectors `embeddings` (vec_id = doc_id), queries
the whole `benchmark` texts, each with the vector of its number. Enrichment
comes from `conversations`: a conversation is an item's payload.

Files and index tables a query needs are derived from the given tables once
per session, in the shared work folder.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import enrichment, scalars, vectors
from rankweave.functions.text import Analyzer, by_language, stems, tokens, trigrams, without_stop_words
from rankweave.operators import fusion, fuzzy, grams, items, knn, lexical, maxscore, pq, reports, topk
from rankweave.operators.enrich import enrich, nest_payload, reduce_payload
from rankweave.plans import pipeline, segments
from rankweave.plans.index import TermIndex, build_index
from rankweave.session import spread, workspace
from rankweave.sources import corpus_store, json_items
from rankweave.streaming import incremental

DIM = 64
LONG = "long"

_made: dict = {}


def made_once(spark: SparkSession, sf_dir: str, name: str, make):
    """Derived tables of this session: made at first use, then read back."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = make(f"{workspace(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs

def raw_items(spark, sf_dir) -> DataFrame:
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    size = F.col("p_size")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return part.join(orders, part["p_partkey"] == orders["o_orderkey"], "left").select(
        F.col("p_partkey").alias("item_key"),
        F.when(size % 13 != 0, F.col("p_partkey")).alias("id"),
        F.when(size % 11 == 0, "").when(size % 7 != 0, F.col("p_name")).alias("title"),
        F.when(size % 5 != 0, F.concat_ws(" ", "p_brand", "p_type")).alias("overview"),
        F.when(size % 3 != 0, F.array("p_type", "p_brand")).alias("genres"),
        F.when(size % 9 == 0, "").when(
            size % 4 != 0, F.concat(F.lit("https://img/"), F.col("p_partkey").cast("string"))).alias("poster"),
        F.when(size % 10 == 0, F.lit(0)).when(size % 6 != 0, day * 86400).cast(LONG).alias("release_date"),
    )


def filled_items(spark, sf_dir) -> DataFrame:
    return items.item_defaults(raw_items(spark, sf_dir), "item_key")


def item_corpus(spark, sf_dir) -> DataFrame:
    """Item texts to search: the unchanged part name, brand and type."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_brand", "p_type").alias("overview"), F.array("p_type").alias("genres"),
    )


def item_queries(spark, sf_dir) -> DataFrame:
    """One query per distinct part name."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("q")).distinct()


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vector_corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def search_queries(spark, sf_dir) -> DataFrame:
    asked, vecs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return asked.join(vecs, asked["item_id"] == vecs["vec_id"], "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("q"), F.col("embedding").alias("query_vec")
    )


def sentence_queries(spark, sf_dir) -> DataFrame:
    """One query per sentence of the benchmark texts."""
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(F.split("text", "[.\\n]+")).alias("n", "q")
    ).select(F.concat_ws("-", F.col("item_id").cast("string"), F.col("n").cast("string")).alias("query_id"), "q")


def document_index(spark, sf_dir, language="english") -> TermIndex:
    def make(path):
        return build_index(documents(spark, sf_dir), {"content": F.col("text")}, Analyzer(language), path)
    return made_once(spark, sf_dir, f"index-{language}", make)


def item_index(spark, sf_dir) -> TermIndex:
    fields = {"title": F.col("title"), "overview": F.col("overview"), "genres": F.array_join("genres", " ")}
    return made_once(spark, sf_dir, "index-items", lambda path: build_index(
        item_corpus(spark, sf_dir), fields, Analyzer("simple"), path))


def full_text_index(spark, sf_dir) -> TermIndex:
    """Title, a blank, overview: what keyword search over items reads."""
    text = scalars.full_text(F.col("title"), F.col("overview"))
    return made_once(spark, sf_dir, "index-full-text", lambda path: build_index(
        item_corpus(spark, sf_dir), {"content": text}, Analyzer("english"), path))


def payloads(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("ord"), "role", "text")
    named = F.when(F.col("role") != "system", F.col("text"))
    noted = F.concat("text", F.lit(" (voice) "), "role")
    return nest_payload(
        turns.select("item_id", "ord", named.alias("name")),
        turns.select("item_id", "ord", F.col("role").alias("name"), noted.alias("character")),
        turns.select("item_id", "ord", F.when(F.col("role") == "assistant", "Director").otherwise("Writer").alias("job"),
                     named.alias("name")),
    )


def joined(column):
    return F.array_join(column, "|")


# Sources and sinks

def load_items(spark, sf_dir):
    def make(path):
        raw_items(spark, sf_dir).drop("item_key").write.json(path)
        return path
    path = made_once(spark, sf_dir, "items-json", make)
    good = json_items.good_items(json_items.check_items(json_items.load_items(spark, path)))
    return good.select("id", "title", "overview", joined("genres").alias("genres"), "poster", "release_date")


def import_limit(spark, sf_dir):
    return items.import_limit(filled_items(spark, sf_dir), 50).select("id", "title")


def corpus_upsert(spark, sf_dir):
    incoming = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("content"))
    existing = documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    # Every third key comes twice; the second version counts.
    again = incoming.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("second: "), "content").alias("content"), F.lit(2).alias("version"))
    incoming = incoming.withColumn("version", F.lit(1)).unionByName(again)
    return corpus_store.upsert(existing, incoming, order="version")


def delete_by_metadata(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("props")).alias("metadata"))
    return corpus_store.delete_by_metadata(events, "k", "69")


def streamed_items(spark, sf_dir) -> str:
    """Items imported by a stream: every fourth size in two versions of one file, every ninth with a bad id."""
    def make(path):
        size, old, new = F.col("p_size"), F.lit(""), F.lit("new ")
        ident = F.when(size % 9 == 0, F.lit("none")).otherwise(F.col("p_partkey").cast("string"))
        title = F.when(size % 9 == 0, F.concat(F.lit("bad "), F.col("p_partkey").cast("string"))).otherwise(F.concat("v", "p_name"))
        versions = F.when((size % 4 == 0) & (size % 9 != 0), F.array(old, new)).otherwise(F.array(old))
        source = table(spark, sf_dir, "part").repartition(3, "p_partkey").select("*", F.explode(versions).alias("v")).select(
            ident.alias("id"), title.alias("title"), F.array("p_type").alias("genres"), F.col("p_brand").alias("overview"))
        source.write.json(f"{path}/incoming")
        stream = incremental.stream_items(spark, f"{path}/incoming", files_per_batch=1)
        incremental.import_available(stream, f"{path}/items", f"{path}/progress", json_items.check_items, f"{path}/refused")
        return path
    return made_once(spark, sf_dir, "stream", make)


def incremental_import(spark, sf_dir):
    rows = incremental.current_rows(spark, f"{streamed_items(spark, sf_dir)}/items", "id")
    return rows.select("id", "title", "overview", joined("genres").alias("genres"))


def refused_rows(spark, sf_dir):
    return spark.read.parquet(f"{streamed_items(spark, sf_dir)}/refused").select("title", "problem")


#: A file of a JSON array holds the items of at most this many successive keys.
ARRAY_KEYS = 10_000


def array_files(part, keys=ARRAY_KEYS):
    """value, file: a JSON array for every block of keys, so that files grow in number only as the blocks do.

    Items without a key are placed by brand and size.
    """
    item = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("overview"),
                    F.array("p_type").alias("genres"))
    nameless = F.concat_ws("-", F.lit("none"), "p_brand", F.col("p_size").cast("string"))
    block = F.coalesce(F.floor(F.col("p_partkey") / keys).cast("string"), nameless).alias("file")
    return part.groupBy(block).agg(F.to_json(F.collect_list(item)).alias("value")).select("value", "file")


def load_items_array(spark, sf_dir):
    """Files that hold one JSON array each: one for every block of keys."""
    def make(path):
        array_files(table(spark, sf_dir, "part")).write.partitionBy("file").text(path)
        return path
    path = made_once(spark, sf_dir, "array-json", make)
    checked = json_items.check_items(json_items.load_items(spark, path, array=True))
    return json_items.good_items(checked).select("id", "title", "overview", joined("genres").alias("genres"))


def checked_items(spark, sf_dir):
    def make(path):
        part, size = table(spark, sf_dir, "part"), F.col("p_size")
        quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        key = F.col("p_partkey").cast("string")
        ident = F.when(size % 13 == 0, quoted(F.concat(F.lit("x"), key))).when(size % 12 == 0, quoted(key)).otherwise(key)
        genres = F.when(size % 7 == 0, quoted(F.col("p_type"))).otherwise(F.concat(F.lit("["), quoted(F.col("p_type")), F.lit("]")))
        date = F.when(size % 5 == 0, F.lit('"soon"')).otherwise(key)
        part.select(F.format_string(
            '{"id": %s, "title": "%s", "genres": %s, "poster": "p%s", "release_date": %s}',
            ident, F.col("p_name"), genres, key, date)).write.text(path)
        return path
    path = made_once(spark, sf_dir, "mixed-json", make)
    return json_items.check_items(json_items.load_items(spark, path))


def quarantine_rows(spark, sf_dir):
    return json_items.quarantine(checked_items(spark, sf_dir)).select("poster", "problem")


# Projections

def item_defaults(spark, sf_dir):
    return filled_items(spark, sf_dir).select(
        "item_key", "id", "title", "overview", joined("genres").alias("genres"), "poster", "release_date")


def content_document(spark, sf_dir):
    rows = enrich(filled_items(spark, sf_dir), payloads(spark, sf_dir))
    content = scalars.content_document(*[F.col(c) for c in (
        "title", "overview", "genres", "release_date", "keywords", "characters", "director")])
    return rows.select("item_key", content.alias("content"))


def metadata_rows(spark, sf_dir):
    rows = filled_items(spark, sf_dir)
    cols = [F.col(c) for c in ("title", "overview", "genres", "release_date")]
    content = scalars.content_document(*cols)
    return rows.select("item_key", scalars.metadata_pack(
        content, F.col("title"), F.col("overview"), F.col("genres"), F.col("poster"),
        F.col("release_date"), F.col("id")).alias("metadata"))


def metadata_unpack(spark, sf_dir):
    """Metadata of every third size is missing, that of every fifth has a text number."""
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size")
    ident = F.when(size % 5 == 0, F.concat(F.lit('"'), key, F.lit('"'))).when(size % 7 == 0, F.lit('"bad"')).otherwise(key)
    meta = F.format_string('{"movie_id": %s, "title": "%s", "genres": ["%s", "%s"], "release_date": %s}',
                           ident, F.col("p_name"), F.col("p_type"), F.col("p_brand"), size.cast("string"))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_key"), F.when(size % 3 != 0, meta).alias("metadata"))
    return items.metadata_unpack(rows).drop("metadata")


def release_year(spark, sf_dir):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast(LONG)
    epoch = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(0).cast(LONG)).when(
        F.col("o_orderpriority") == "2-HIGH", -day * 86400).when(
        F.col("o_orderpriority") != "5-LOW", day * 86400)
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.release_year(epoch).cast(LONG).alias("year"))


def decimals(vector):
    return F.transform(vector, lambda x: F.round(x.cast("double"), 6).cast("decimal(9,6)"))


def vector_format(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.format_vector(decimals("embedding")).alias("text"))


def vector_parse(spark, sf_dir):
    label = F.col("label")
    text = F.when(label == 0, "[]").when(label == 1, "").when(label == 2, "0").when(
        label == 3, "[1.5abc,x,-2e1]").otherwise(vectors.format_vector(decimals("embedding")))
    parsed = table(spark, sf_dir, "embeddings").select("vec_id", vectors.parse_vector(text).alias("v"))
    return parsed.select("vec_id", F.posexplode_outer("v").alias("pos", "value")).select(
        "vec_id", F.col("pos").cast(LONG).alias("pos"), "value")


def vector_validate(spark, sf_dir):
    label = F.col("label")
    v = F.when(label == 0, F.slice("embedding", 1, 10)).when(label != 1, F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.is_valid_vector(v, DIM).alias("valid"))


def genres_normalise(spark, sf_dir):
    text = F.when(F.col("p_size") % 3 == 0, F.to_json(F.array("p_type", "p_brand"))).when(
        F.col("p_size") % 5 != 0, F.concat(F.lit('"'), F.col("p_type"), F.lit('"')))
    return table(spark, sf_dir, "part").select(
        "p_partkey", joined(scalars.genres_normalise(F.parse_json(text))).alias("genres"))


def doc_identity(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", scalars.doc_identity(F.col("source"), F.col("doc_id")).alias("key"))


def raw_queries(spark, sf_dir):
    n = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        n.alias("query_id"),
        F.when(n % 7 == 3, "").when(n % 11 == 5, "0").otherwise(F.col("text")).alias("q"),
        F.when(n % 5 == 0, "1.7").when(n % 5 == 1, "-0.5").when(n % 5 == 2, "abc").when(n % 5 == 3, "0.45").alias("ratio"),
        F.when(n % 4 == 0, "5").when(n % 4 == 1, "12x").when(n % 4 == 2, "150").alias("limit"),
    )


def query_prepare(spark, sf_dir):
    return items.query_prepare(raw_queries(spark, sf_dir)).withColumn("limit", F.col("limit").cast(LONG))


def item_hits(spark, sf_dir):
    hits = lexical.bm25_search(item_queries(spark, sf_dir), item_index(spark, sf_dir), 20)
    return hits, raw_items(spark, sf_dir).withColumnRenamed("item_key", "doc_id")


def hit_projection(spark, sf_dir):
    return items.hit_projection(*item_hits(spark, sf_dir)).select(
        "query_id", "doc_id", F.col("rank").cast(LONG).alias("rank"), "score", "title", "overview",
        joined("genres").alias("genres"), "poster", "release_date")


def result_cards(spark, sf_dir):
    hits, corpus = item_hits(spark, sf_dir)
    # Odd ranks lose their score, to show the card of a hit without one.
    hits = hits.withColumn("score", F.when(F.col("rank") % 2 == 0, F.col("score")).otherwise(0.0))
    return items.result_cards(items.hit_projection(hits, corpus)).withColumn("genres", joined("genres"))


# Enrichment

def reduced(spark, sf_dir):
    return reduce_payload(payloads(spark, sf_dir))


def enrich_keywords(spark, sf_dir):
    return reduced(spark, sf_dir).select("item_id", joined("keywords").alias("keywords"))


def enrich_characters(spark, sf_dir):
    return reduced(spark, sf_dir).select("item_id", joined("characters").alias("characters"))


def enrich_director(spark, sf_dir):
    return reduced(spark, sf_dir).select("item_id", "director")


def clean_role(spark, sf_dir):
    noted = F.when(F.col("turn") == 0, F.concat("role", F.lit(" (voice) "), "text")).when(
        F.col("turn") == 1, "(uncredited)").when(F.col("turn") == 2, "X").otherwise(F.concat("text", F.lit(" (as himself)")))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", enrichment.clean_role(noted).alias("role"))


def enrich_join(spark, sf_dir):
    return enrich(raw_items(spark, sf_dir), payloads(spark, sf_dir)).select(
        "item_key", F.size("keywords").cast(LONG).alias("n_keywords"),
        F.size("characters").cast(LONG).alias("n_characters"), "director")


# Text

def tokenize(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term")).select(
        "doc_id", (F.col("pos") + 1).cast(LONG).alias("pos"), "term")


def tokenize_by_lang(spark, sf_dir):
    terms = by_language(F.col("lang"), F.col("text"))
    return spread(documents(spark, sf_dir)).select("doc_id", F.explode(terms).alias("term")).groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("n"))


def stopword_filter(spark, sf_dir):
    kept = without_stop_words(F.col("lang"), tokens(F.col("text")))
    return spread(documents(spark, sf_dir)).select("doc_id", F.explode(kept).alias("term")).groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("n"))


def stem_vocabulary(spark, sf_dir):
    terms = document_index(spark, sf_dir, "simple").terms
    return terms.select("term", F.get(stems(F.array("term"), "english"), 0).alias("stem"))


def term_frequency(spark, sf_dir):
    return document_index(spark, sf_dir).postings.select(
        "doc_id", "term", F.col("tf").cast(LONG).alias("tf"), F.col("doc_len").cast(LONG).alias("doc_len"),
        F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def bm25_stats(spark, sf_dir):
    return document_index(spark, sf_dir).terms.select(
        "term", "df", "n_docs", topk.rounded(F.col("avg_len")).alias("avg_len"))


def token_options(spark, sf_dir):
    words = tokens(F.col("url"), separators=("e",), symbols=("/", "="))
    return table(spark, sf_dir, "pages").select("page_id", joined(words).alias("tokens"))


# Lexical search

def ranked(df, *columns):
    return df.select("query_id", "doc_id", F.col("rank").cast(LONG).alias("rank"), *(columns or ("score",)))


def fts_match(spark, sf_dir):
    return lexical.all_terms_match(sentence_queries(spark, sf_dir), document_index(spark, sf_dir)).select("query_id", "doc_id")


def keyword_search(spark, sf_dir):
    return ranked(lexical.keyword_search(sentence_queries(spark, sf_dir), document_index(spark, sf_dir)))


def keyword_search_items(spark, sf_dir):
    return ranked(lexical.keyword_search(item_queries(spark, sf_dir), full_text_index(spark, sf_dir)))


def native_search(spark, sf_dir):
    return ranked(lexical.native_search(sentence_queries(spark, sf_dir), document_index(spark, sf_dir)))


def bm25_search(spark, sf_dir):
    return ranked(lexical.bm25_search(search_queries(spark, sf_dir), document_index(spark, sf_dir)))


def bm25_bounds(spark, sf_dir):
    """Largest BM25 tf part of each block of 64 doc_ids of each term: written once with the index."""
    def make(path):
        maxscore.block_bounds(document_index(spark, sf_dir)).write.parquet(path)
        return spark.read.parquet(path)
    return made_once(spark, sf_dir, "bm25-bounds", make)


def bm25_top_k(spark, sf_dir):
    """The answers of bm25_search, skipping blocks and postings that cannot reach the top 20."""
    index = document_index(spark, sf_dir)
    return ranked(maxscore.bm25_top_k(search_queries(spark, sf_dir), index, bm25_bounds(spark, sf_dir), 20))


def needles(spark, sf_dir) -> DataFrame:
    """Two needles per benchmark item: eight code points from its eleventh, and two from its third."""
    bench = table(spark, sf_dir, "benchmark")
    return bench.select((F.col("item_id") * 2).alias("needle_id"), F.substring("text", 11, 8).alias("needle")).unionByName(
        bench.select((F.col("item_id") * 2 + 1).alias("needle_id"), F.substring("text", 3, 2).alias("needle")))


def gram_index(spark, sf_dir):
    def make(path):
        index = grams.build_gram_index(documents(spark, sf_dir))
        index.grams.write.parquet(f"{path}/grams")
        lists = spark.read.parquet(f"{path}/grams")
        grams.gram_counts(lists).write.parquet(f"{path}/counts")
        return grams.GramIndex(lists, spark.read.parquet(f"{path}/counts"), index.texts)
    return made_once(spark, sf_dir, "grams", make)


def infix_indexed(spark, sf_dir):
    return grams.infix_indexed(needles(spark, sf_dir), gram_index(spark, sf_dir))


def grown_index(spark, sf_dir) -> segments.Segments:
    """The documents added in two batches, benchmark texts upserted over them, one source deleted, then merged."""
    def make(path):
        docs = documents(spark, sf_dir)
        index = segments.create(spark, {"content": "text"}, Analyzer("english"), path)
        english = F.col("lang").eqNullSafe("en")
        index = segments.add(index, docs.filter(english))
        index = segments.add(index, docs.filter(~english))
        incoming = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit(1).alias("version"))
        again = incoming.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("second: "), "text").alias("text"), F.lit(2).alias("version"))
        index = segments.add(index, incoming.unionByName(again), order="version")
        index = segments.delete(index, docs.filter(F.col("source") == "src7"))
        return segments.merge(index, fan_in=2)
    return made_once(spark, sf_dir, "segments", make)


def bm25_incremental(spark, sf_dir):
    """BM25 over an index that was grown, changed and merged; equal to a fresh index over the same documents."""
    return ranked(lexical.bm25_search(search_queries(spark, sf_dir), segments.term_index(grown_index(spark, sf_dir))))


FIELD_BOOSTS = {"title": 0.9, "overview": 1.1, "genres": 1.0}  # fixed values


def bm25_fielded(spark, sf_dir):
    return ranked(lexical.bm25_search(item_queries(spark, sf_dir), item_index(spark, sf_dir), 20, boosts=FIELD_BOOSTS))


def infix_search(spark, sf_dir):
    return lexical.infix_search(documents(spark, sf_dir), "text", "TIONER").select("doc_id", "lang")


def title_lookup(spark, sf_dir):
    return lexical.title_lookup(table(spark, sf_dir, "part").withColumnRenamed("p_name", "title"), "red widget").select(
        "p_partkey", "title")


# Fuzzy search

def vocabulary_trigrams(spark, sf_dir):
    return document_index(spark, sf_dir, "simple").terms.select("term", F.explode(trigrams(F.col("term"))).alias("trigram"))


def fuzzy_terms(spark, sf_dir):
    words = fuzzy.query_words(search_queries(spark, sf_dir)).select("word").distinct()
    return fuzzy.similar_terms(words, fuzzy.vocabulary_of(document_index(spark, sf_dir, "simple"))).withColumn(
        "similarity", topk.rounded(F.col("similarity")))


def fuzzy_search(spark, sf_dir):
    return ranked(fuzzy.fuzzy_search(search_queries(spark, sf_dir), document_index(spark, sf_dir, "simple")))


# Vector search

def long_vectors(df, key):
    return df.select(key, F.posexplode("v").alias("pos", "value")).filter("value != 0").select(
        key, F.col("pos").cast(LONG).alias("pos"), topk.rounded(F.col("value").cast("double")).alias("value"))


def hash_embed(spark, sf_dir):
    return long_vectors(spread(documents(spark, sf_dir)).select("doc_id", vectors.hash_embed(F.col("text"), DIM).alias("v")), "doc_id")


def hash_embed_fields(spark, sf_dir):
    return long_vectors(item_corpus(spark, sf_dir).select(
        "doc_id", vectors.embed_fields(["title", "overview"], DIM).alias("v")), "doc_id")


def neighbours(spark, sf_dir):
    """Each vector with the one of the next number."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id")


def metric(name):
    def query(spark, sf_dir):
        value = vectors.METRICS[name](F.col("a"), F.col("b"))
        return neighbours(spark, sf_dir).select("vec_id", topk.rounded(value).alias("value"))
    return query


def cosine_sql_udf(spark, sf_dir):
    vectors.register_sql_functions(spark)
    return neighbours(spark, sf_dir).selectExpr("vec_id", "round(cosine_similarity(a, b), 6) AS value")


def vector_search(spark, sf_dir):
    return ranked(knn.nearest(vector_corpus(spark, sf_dir), search_queries(spark, sf_dir), 20))


def vector_search_l2(spark, sf_dir):
    return ranked(knn.nearest(vector_corpus(spark, sf_dir), search_queries(spark, sf_dir), 20, metric="l2"))


def vector_within(spark, sf_dir):
    return ranked(knn.nearest(vector_corpus(spark, sf_dir), search_queries(spark, sf_dir), 20, max_distance=0.7))


def n_cells(spark, sf_dir) -> int:
    """As many cells as grow with the square root of the vectors."""
    return max(4, math.isqrt(vector_corpus(spark, sf_dir).count()) // 4)


def cell_index(spark, sf_dir):
    """Cells by k-means."""
    return made_once(spark, sf_dir, "cells", lambda path: knn.build_cells(
        vector_corpus(spark, sf_dir), n_cells(spark, sf_dir), path, dim=DIM))


def given_cells(spark, sf_dir):
    """Cells around given centres: the first vectors by number, so that SQL can assign them too."""
    def make(path):
        first = vector_corpus(spark, sf_dir).orderBy("doc_id").limit(n_cells(spark, sf_dir)).collect()
        centers = [r["embedding"] for r in first]
        return knn.build_cells(vector_corpus(spark, sf_dir), len(centers), path, dim=DIM, centers=centers)
    return made_once(spark, sf_dir, "given-cells", make)


def probes_of(index) -> int:
    """Three tenths of the cells."""
    return -(-3 * len(index.centers) // 10)


def vector_search_cells(spark, sf_dir):
    index = given_cells(spark, sf_dir)
    return ranked(knn.nearest_in_cells(index, search_queries(spark, sf_dir), 20, probes=probes_of(index)))


def vector_search_cells_full(spark, sf_dir):
    """Probing every cell is exact search."""
    index = cell_index(spark, sf_dir)
    return ranked(knn.nearest_in_cells(index, search_queries(spark, sf_dir), 20, probes=len(index.centers)))


def pq_index(spark, sf_dir):
    """Product-quantised vectors: 16 one-byte codes a vector, codebooks from at most pq.TRAIN_ROWS."""
    return made_once(spark, sf_dir, "pq", lambda path: pq.build_pq(vector_corpus(spark, sf_dir), 16, 256, path, dim=DIM))


PQ_RERANK = 50


def vector_search_pq(spark, sf_dir):
    """Approximate scan of the codes, exact re-rank of the best 50 per query; no SQL gives its
    candidates, so it is held against exact search (recall) in tests/test_pq.py and the bench."""
    return ranked(pq.nearest_pq(pq_index(spark, sf_dir), search_queries(spark, sf_dir), 20, rerank=PQ_RERANK))


# Hybrid search

def some_without_vector(spark, sf_dir):
    lost = F.when(F.col("query_id") % 3 != 0, F.col("query_vec"))
    return search_queries(spark, sf_dir).withColumn("query_vec", lost)


WEIGHTED = ("weighted_keyword_score", "weighted_semantic_score", "total_score")


def hybrid_fallback(spark, sf_dir):
    hits = pipeline.hybrid_weighted(some_without_vector(spark, sf_dir), vector_corpus(spark, sf_dir), document_index(spark, sf_dir))
    return ranked(hits, *WEIGHTED)


def hybrid_weighted(spark, sf_dir):
    """With the payload of the hits, fetched once after the join."""
    hits = pipeline.hybrid_weighted(search_queries(spark, sf_dir), vector_corpus(spark, sf_dir), document_index(spark, sf_dir))
    payload = documents(spark, sf_dir).select("doc_id", "lang", "source")
    return ranked(items.with_payload(hits, payload), *WEIGHTED, "lang", "source")


def lists(spark, sf_dir, *names):
    queries = search_queries(spark, sf_dir)
    makers = {
        "lexical": lambda: lexical.bm25_search(queries, document_index(spark, sf_dir), fusion.CUT),
        "semantic": lambda: knn.nearest(vector_corpus(spark, sf_dir), queries, fusion.CUT),
        "fuzzy": lambda: fuzzy.fuzzy_search(queries, document_index(spark, sf_dir, "simple"), fusion.CUT),
    }
    return queries, {name: makers[name]() for name in names}


def hybrid_rrf(spark, sf_dir):
    queries, found = lists(spark, sf_dir, "lexical", "semantic")
    return ranked(fusion.fuse(queries, found, breakdown=False))


def rrf_ratio_sweep(spark, sf_dir):
    """Every query at five ratios; 0 is pure text, 1 pure semantic."""
    queries, found = lists(spark, sf_dir, "lexical", "semantic")
    ratios = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    def at(df):
        return df.withColumn("semantic_ratio", ratios).withColumn(
            "query_id", F.concat_ws("@", F.col("query_id").cast("string"), F.col("semantic_ratio").cast("string")))
    lists_at = {name: at(df).drop("semantic_ratio") for name, df in found.items()}
    return ranked(fusion.fuse(at(queries), lists_at, breakdown=False))


def hybrid_rrf_fuzzy(spark, sf_dir):
    queries, found = lists(spark, sf_dir, "lexical", "semantic", "fuzzy")
    return ranked(fusion.fuse(queries, found, fuzzy_weight=0.4, breakdown=False))


def normalized_scores(spark, sf_dir):
    """Both scores of one search."""
    queries, found = lists(spark, sf_dir, "lexical", "semantic")
    return fusion.both_scores(queries, found)


def min_score_filter(spark, sf_dir):
    """A floor of 30; every fourth query sets its own."""
    queries, found = lists(spark, sf_dir, "lexical", "semantic")
    queries = queries.withColumn("min_score", F.when(F.col("query_id") % 4 == 0, 10.0))
    return ranked(fusion.fuse(queries, found, min_score=30.0, breakdown=False))


def score_breakdown(spark, sf_dir):
    queries, found = lists(spark, sf_dir, "lexical", "semantic")
    flat = [F.col(f"score_breakdown.{name}.{field}").cast(kind).alias(f"{name}_{field}")
            for name in ("lexical", "semantic") for field, kind in (("rank", LONG), ("score", "double"), ("contribution", "double"))]
    return ranked(fusion.fuse(queries, found), "score", *flat)


def rrf_vector_only(spark, sf_dir):
    queries, found = lists(spark, sf_dir, "semantic")
    return ranked(fusion.fuse(queries.withColumn("semantic_ratio", F.lit(1.0)), found, breakdown=False))


def compare_strategies(spark, sf_dir):
    return pipeline.compare_strategies(search_queries(spark, sf_dir), vector_corpus(spark, sf_dir), document_index(spark, sf_dir))


# Reports

def coverage_report(spark, sf_dir):
    return reports.coverage_report(raw_items(spark, sf_dir), {
        "id": "with_id", "title": "with_title", "overview": "with_overview"})


def import_report(spark, sf_dir):
    return reports.import_report(checked_items(spark, sf_dir))


def facet_genres(spark, sf_dir):
    return reports.facet_genres(raw_items(spark, sf_dir))


def facet_year(spark, sf_dir):
    return reports.facet_year(raw_items(spark, sf_dir)).withColumn("year", F.col("year").cast(LONG))


def hit_counts(spark, sf_dir):
    return reports.hit_counts(search_queries(spark, sf_dir), bm25_search(spark, sf_dir))


def sort_by_field(spark, sf_dir):
    return topk.sort_by_field(documents(spark, sf_dir).select("doc_id", "n_chars", "lang"), "n_chars")


# End to end

def index_pipeline(spark, sf_dir):
    """Items to corpus rows with vectors; rows without an overview are filtered out."""
    rows = pipeline.indexer(
        raw_items(spark, sf_dir),
        transformers=[lambda df: items.item_defaults(df, "item_key"), lambda df: pipeline.corpus_of(df, "part", payloads(spark, sf_dir))],
        filters=[scalars.filled(F.col("overview"))],
        vectorizer=pipeline.with_embedding(DIM),
    )
    fits = vectors.is_valid_vector(F.col("embedding"), DIM)
    return rows.select("doc_id", "item_id", F.md5("content").alias("content_md5"), fits.alias("embedded"))


def retrieve_batch(spark, sf_dir):
    def make(path):
        spread(documents(spark, sf_dir)).select(
            "doc_id", vectors.hash_embed(F.col("text"), DIM).alias("embedding"), F.col("source").alias("title"),
            F.col("lang").alias("overview"), F.array("lang").alias("genres"), F.lit(None).cast("string").alias("poster"),
        ).write.parquet(path)
        return spark.read.parquet(path)
    corpus = made_once(spark, sf_dir, "corpus", make)
    hits = pipeline.retrieve(raw_queries(spark, sf_dir), corpus, document_index(spark, sf_dir), DIM)
    return ranked(hits, "score", "title", "overview")


QUERIES = {f.__name__: f for f in (
    load_items, load_items_array, import_limit, corpus_upsert, delete_by_metadata, incremental_import, refused_rows, quarantine_rows,
    item_defaults, content_document, metadata_unpack, release_year, vector_parse, vector_format,
    vector_validate, genres_normalise, hit_projection, result_cards, doc_identity, query_prepare,
    enrich_keywords, enrich_characters, clean_role, enrich_director, enrich_join,
    tokenize, tokenize_by_lang, stopword_filter, stem_vocabulary, term_frequency, bm25_stats, token_options,
    fts_match, keyword_search, keyword_search_items, native_search, bm25_search, bm25_top_k, bm25_incremental, bm25_fielded, infix_search, infix_indexed, title_lookup,
    fuzzy_terms, fuzzy_search,
    hash_embed, hash_embed_fields, vector_search, vector_search_l2, vector_within, vector_search_cells,
    vector_search_cells_full,
    hybrid_fallback, hybrid_weighted, hybrid_rrf, rrf_ratio_sweep, hybrid_rrf_fuzzy, normalized_scores,
    min_score_filter, score_breakdown, rrf_vector_only, compare_strategies,
    coverage_report, import_report, facet_genres, facet_year, hit_counts, sort_by_field,
    index_pipeline, retrieve_batch, cosine_sql_udf,
)}
QUERIES["metadata_pack"] = metadata_rows
# Approximate answers: registered, held against exact search instead of SQL.
APPROXIMATE = {"vector_search_pq": vector_search_pq}
QUERIES["trigrams"] = vocabulary_trigrams
QUERIES |= {name: metric(key) for name, key in (
    ("cosine_similarity", "cosine"), ("l2_distance", "l2"), ("inner_product", "inner_product"))}
