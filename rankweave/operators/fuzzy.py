"""Typo-tolerant search: character trigrams over the distinct vocabulary.

Word similarity is the Jaccard measure of two trigram sets. The vocabulary is
placed by term, one short row each, and every term is compared with the query
words where it lies, in Arrow batches with a broadcast trigram matrix; only pairs
above the threshold go on.

Documents are scored in their shards: the distinct terms of a slice of documents are
compared with the query words, the documents become a matrix of best similarities per
word, that a matrix of scores per query, and k documents per query leave the task. No
(query, document) pair is ever a row, and no table of similar pairs, which grows with
the vocabulary, is gathered: the corpus is read once for each block of queries.

Queries are taken in blocks of a bounded number of words; a task holds a bounded number
of similar pairs at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankweave.functions.text import tokens
from rankweave.operators.knn import Best, best_rows, half_up
from rankweave.operators.topk import top_k
from rankweave.plans.index import TermIndex
from rankweave.session import shuffle_partitions, written

THRESHOLD = 0.2
MAX_WORDS = 5_000              # distinct query words of a block
WORD_ROWS = 20                 # and as many times their uses in queries
CHUNK_CELLS = 1 << 19          # cells of a step in numpy, few enough for a cache
GRAM_CELLS = 1 << 18           # code points whose trigrams a task cuts at a time, one term at least
VOCABULARY_TERMS = 50_000      # terms that a task compares with a block of words
MAX_PAIRS = 12_000_000         # similar pairs a task holds at a time, 3 to 8 bytes each in numpy


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, word, n_words): distinct words of each query."""
    words = F.array_distinct(tokens(F.col("q")))
    return queries.select("query_id", words.alias("words")).select(
        "query_id", F.size("words").alias("n_words"), F.explode("words").alias("word")
    )


def vocabulary_of(index: TermIndex) -> DataFrame:
    terms = index.terms.select("term")
    return terms if len(index.fields) == 1 else terms.distinct()


def gram_codes(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, grams): the distinct trigrams of each term as `text.trigrams` cuts them, by row; a gram is a place in
    `grams`, three code points of 21 bits each."""
    length = pc.utf8_length(terms).to_numpy(zero_copy_only=False).astype("int64")
    padded = np.full(length.sum() + 3 * len(terms), ord(" "), dtype="int64")
    number = np.arange(len(terms))
    text = pc.binary_join(pa.ListArray.from_arrays([0, len(terms)], terms), "")[0].as_py()
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    padded[np.arange(len(points)) + np.repeat(3 * number + 2, length)] = points
    row = np.repeat(number, length + 1)
    at = np.arange(len(row)) + 2 * row
    coded = pa.array(padded[at] << 42 | padded[at + 1] << 21 | padded[at + 2]).dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    key = np.sort(row * kinds + coded.indices.to_numpy())
    key = key[np.diff(key, prepend=-1) > 0]
    return key // kinds, key % kinds, coded.dictionary.to_numpy()


class WordMatrix:
    """Distinct query words as a trigram x word matrix of zeros and ones."""

    def __init__(self, words: list[str], threshold: float):
        self.words = words
        self.threshold = threshold
        column, gram, grams = gram_codes(pa.array(words, pa.string()))
        self.size = np.bincount(column, minlength=len(words)).astype("float64")
        # Shared counts never exceed the word's own; one byte mostly does.
        self.kind = "uint8" if self.size.max(initial=0) < 255 else "uint32"
        order = np.argsort(grams)
        self.grams = grams[order]
        self.width = -(-len(words) // 8) * 8  # so that eight cells can be looked at as one
        self.held = np.zeros((len(grams), self.width), dtype=self.kind)
        self.held[np.argsort(order)[gram], column] = 1
        self.needed: dict[int, np.ndarray] = {}

    def need(self, size: int) -> np.ndarray:
        """Per word, the fewest trigrams a term of `size` must share with it."""
        if size not in self.needed:
            total = self.size + size
            guess = np.floor(self.threshold * total / (1 + self.threshold))
            least = np.maximum(guess + 2, 1)
            for offset in (1, 0, -1):
                shared = np.maximum(guess + offset, 1)
                least = np.where(shared / (total - shared) >= self.threshold, shared, least)
            self.needed[size] = np.full(self.width, np.iinfo(self.kind).max, dtype=self.kind)
            self.needed[size][:len(self.words)] = np.minimum(least, self.size + 1)
        return self.needed[size]

    def compare(self, terms: pa.Array):
        """Yield (rows, sizes, counts, columns, shared): some terms, their trigrams, how many words each resembles; these words one
        term after another, with the trigrams in common."""
        step = max(1, CHUNK_CELLS // max(1, self.width))
        shared, more, need, near = (np.empty((step, self.width), dtype=kind) for kind in (self.kind, self.kind, self.kind, "bool"))
        ends = np.cumsum(pc.utf8_length(terms).to_numpy(zero_copy_only=False).astype("int64") + 3)
        at = 0 if self.words else len(terms)
        while at < len(terms):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GRAM_CELLS, "right")))
            row, gram, grams = gram_codes(terms.slice(at, end - at))
            size = np.bincount(row, minlength=end - at)
            slot = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            known = (self.grams[slot] == grams)[gram]
            row, slot = row[known], slot[gram[known]]
            held = np.bincount(row, minlength=end - at)  # of the term's trigrams, those of any word
            first = np.cumsum(held) - held
            sizes, kind = np.unique(size, return_inverse=True)
            least = np.stack([self.need(int(n)) for n in sizes])
            some = np.flatnonzero(held >= least.min(axis=1)[kind])
            # Terms of as many such trigrams together: their rows of the matrix add up without a loop over terms.
            some = some[np.argsort(held[some], kind="stable")]
            cuts = np.flatnonzero(np.diff(held[some], prepend=-1))
            for begin, stop in zip(cuts, [*cuts[1:], len(some)]):
                for of in range(begin, stop, step):
                    part = some[of:min(of + step, stop)]
                    n = len(part)
                    np.take(self.held, slot[first[part]], axis=0, out=shared[:n], mode="clip")
                    for j in range(1, held[part[0]]):
                        np.take(self.held, slot[first[part] + j], axis=0, out=more[:n], mode="clip")
                        np.add(shared[:n], more[:n], out=shared[:n])
                    np.take(least, kind[part], axis=0, out=need[:n], mode="clip")
                    np.greater_equal(shared[:n], need[:n], out=near[:n])
                    eights = near[:n].reshape(-1, 8)
                    found = np.flatnonzero(eights.view("uint64") != 0)
                    cells = np.flatnonzero(eights[found])
                    cells = (found * 8)[cells >> 3] + (cells & 7)
                    place = cells // self.width
                    columns = cells - place * self.width
                    yield at + part, size[part], np.bincount(place, minlength=n), columns, shared.ravel()[cells]
            at = end

    def similarity(self, sizes: np.ndarray, columns: np.ndarray, shared: np.ndarray) -> np.ndarray:
        both = shared.astype("float64")
        return both / (sizes + self.size[columns] - both)


def word_blocks(words: DataFrame, threshold: float) -> list[WordMatrix]:
    """The distinct query words as matrices of at most about MAX_WORDS words."""
    n = -(-words.count() // MAX_WORDS)
    block = F.pmod(F.xxhash64("word"), F.lit(max(n, 1)))
    return [WordMatrix(words.select("word").filter(block == b).toArrow()["word"].to_pylist(), threshold) for b in range(max(n, 1))]


def similar_pairs(matrix: WordMatrix, vocabulary: DataFrame) -> DataFrame:
    """(term, number, similarity): the words, by number, that a term resembles."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(matrix)
    schema = pa.schema([("term", pa.string()), ("number", pa.int32()), ("similarity", pa.float64())])

    def compare(batches):
        for batch in batches:
            for rows, sizes, counts, columns, both in shared.value.compare(batch.column("term")):
                similar = shared.value.similarity(np.repeat(sizes, counts), columns, both)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("term").take(pa.array(np.repeat(rows, counts))), pa.array(columns.astype("int32")), pa.array(similar)],
                    schema=schema)

    parts = max(shuffle_partitions(vocabulary.sparkSession), -(-vocabulary.count() // VOCABULARY_TERMS))
    placed = vocabulary.select("term").filter("term IS NOT NULL").repartition(parts, "term")
    return placed.mapInArrow(compare, "term string, number int, similarity double")


def similar_terms(words: DataFrame, vocabulary: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(word, term, similarity) of distinct `word`s and distinct `term`s."""
    def named(matrix: WordMatrix) -> DataFrame:
        names = words.sparkSession.createDataFrame(list(enumerate(matrix.words)), "number int, word string")
        return similar_pairs(matrix, vocabulary).join(F.broadcast(names), "number").select("word", "term", "similarity")

    blocks = word_blocks(words, threshold)
    return reduce(DataFrame.unionByName, [named(m) if len(blocks) == 1 else written(named(m), "similar") for m in blocks])


class Similar:
    """The words of a block and of each of its queries; scores documents a slice at a time."""

    def __init__(self, matrix: WordMatrix, queries: pa.Table):
        self.matrix, self.most, self.cells, self.rate = matrix, MAX_PAIRS, CHUNK_CELLS, 0.0
        place = {w: i for i, w in enumerate(matrix.words)}
        held = queries["words"].to_pylist()
        self.ids = queries["query_id"].to_numpy()
        self.columns = np.array([place[w] for ws in held for w in ws], dtype="int64")
        self.length = np.array([len(ws) for ws in held], dtype="int64")
        self.first = np.cumsum(self.length) - self.length
        self.n_words = len(matrix.words)
        self.kind = "uint16" if self.n_words < 1 << 16 else "int32"

    def pairs(self, terms: pa.Array, several: bool):
        """(trigrams, first, count) of distinct terms, then (words, shared) by term; None if there are too many for `several` documents."""
        if several and self.rate * len(terms) > self.most:
            return None
        size, first, count = (np.zeros(len(terms), "int64") for _ in range(3))
        words, shared, held = [np.array([], self.kind)], [np.array([], self.matrix.kind)], 0
        for rows, sizes, counts, columns, both in self.matrix.compare(terms):
            size[rows], first[rows], count[rows] = sizes, held + np.cumsum(counts) - counts, counts
            words.append(columns.astype(self.kind))
            shared.append(both)
            held += len(columns)
            if several and held > self.most:
                self.rate = max(self.rate, held / len(terms))
                return None
        self.rate = held / max(1, len(terms))
        return size, first, count, np.concatenate(words), np.concatenate(shared)

    def feed(self, best: Best, ids: np.ndarray, terms: pa.ListArray) -> None:
        """Score documents by the words that their own terms resemble; too many pairs: half of them at a time."""
        coded = terms.flatten().dictionary_encode()
        pairs = self.pairs(coded.dictionary, len(ids) > 1)
        if pairs is None:
            half = len(ids) // 2
            self.feed(best, ids[:half], terms.slice(0, half))
            self.feed(best, ids[half:], terms.slice(half))
            return
        size, first, count, number, shared = pairs
        code = coded.indices.to_numpy() if len(coded) else np.array([], "int64")
        ends = np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()))])
        every = np.arange(len(self.ids))
        step = min(max(1, self.cells // max(1, self.n_words, len(self.columns))), len(ids))
        held = np.empty((step, len(self.columns)))
        for at in range(0, len(ids), step):
            end = min(at + step, len(ids))
            near = np.zeros((end - at) * self.n_words)
            # A slice of the terms at a time: a long document meets many words.
            rows = code[ends[at]:ends[end]]
            docs = np.repeat(np.arange(end - at), np.diff(ends[at:end + 1]))
            done = np.cumsum(count[rows])
            begin = 0
            while begin < len(rows):
                before = done[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(done, before + self.cells, "right")))
                some, counts = rows[begin:stop], count[rows[begin:stop]]
                place = np.repeat(first[some] - (np.cumsum(counts) - counts), counts)
                place += np.arange(len(place))
                words = number[place]
                similar = self.matrix.similarity(np.repeat(size[some], counts), words, shared[place])
                np.maximum.at(near, np.repeat(docs[begin:stop] * self.n_words, counts) + words, similar)
                begin = stop
            near = near.reshape(end - at, self.n_words)
            np.take(near, self.columns, axis=1, out=held[:end - at], mode="clip")
            scores = half_up(np.add.reduceat(held[:end - at], self.first, axis=1) / self.length)
            best.add(ids[at:end], scores, every, 10.0 ** -6)


def _search_block(queries: DataFrame, index: TermIndex, k: int, threshold: float) -> DataFrame:
    spark = queries.sparkSession
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("q"))).alias("words")).filter("size(words) > 0").toArrow()
    words = sorted({w for ws in asked["words"].to_pylist() for w in ws})
    if asked.num_rows > 1 and len(words) > 2 * MAX_WORDS:
        half = F.pmod(F.xxhash64("query_id", F.lit(asked.num_rows)), F.lit(2))
        return _search_block(queries.filter(half == 0), index, k, threshold).unionByName(
            _search_block(queries.filter(half == 1), index, k, threshold))
    shared = spark.sparkContext.broadcast(Similar(WordMatrix(words, threshold), asked))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                           T.StructField("doc_id", index.postings.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def search(batches):
        block = shared.value
        best = Best(len(block.ids), k)
        for batch in batches:
            if len(block.ids) and batch.num_rows:
                block.feed(best, batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("terms"))
        yield pa.RecordBatch.from_arrays(best_rows(best, block.ids, "cosine", arrow), schema=arrow)

    # A document's postings lie in one shard: this grouping needs no shuffle. A term of several fields may come again.
    docs = index.postings.groupBy("doc_id").agg(F.collect_list("term").alias("terms"))
    return top_k(docs.mapInArrow(search, schema), k)


def fuzzy_search(queries: DataFrame, index: TermIndex, k: int = 20, threshold: float = THRESHOLD) -> DataFrame:
    """The k documents per query with the best mean word similarity: (query_id, doc_id, score, rank).

    The mean runs over the query's distinct words, each with its most similar word of
    the document. Expects a `simple` index, whose terms are the words as written.
    """
    asked = query_words(queries).agg(F.count_distinct("word").alias("words"), F.count(F.lit(1)).alias("rows")).head()
    n = max(-(-asked["words"] // MAX_WORDS), -(-asked["rows"] // (MAX_WORDS * WORD_ROWS)))
    if n <= 1:
        return _search_block(queries, index, k, threshold)
    block = F.pmod(F.xxhash64("query_id"), F.lit(n))
    parts = [written(_search_block(queries.filter(block == b), index, k, threshold), "fuzzy") for b in range(n)]
    return reduce(DataFrame.unionByName, parts)
