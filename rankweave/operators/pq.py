"""Compressed vector search: product quantisation with exact re-ranking.

A unit vector is cut into `m` sub-vectors; each is replaced by the number of its
nearest of `ks` centres of that sub-space, so a 64-dimensional float vector of 256
bytes becomes 16 one-byte codes. A query turns into a table of its products with
every centre (m x ks numbers); the approximate cosine of a document is the sum of
m entries looked up by its codes. Tasks scan the codes with the query tables of a
block of queries broadcast, and keep the `rerank` best documents per query.

The candidates are then scored exactly against the full vectors. These are written
partitioned by ranges of doc_id (`bucket`); the candidates are small (block rows x
rerank) and broadcast, so dynamic partition pruning reads only the buckets that hold
a candidate. `bytes_read` reports what a search read against what exact search reads.

Codebooks are fitted on a bounded sample of at most `train_rows` vectors (a documented
parameter); every vector is encoded and searched.

Edge cases: rows without a vector, of another dimension, or zero vectors take no
part (as in `knn.build_cells`); queries likewise. Equal scores rank by doc_id.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.operators.knn import (
    QUERY_BYTES, RESULT_ROWS, Best, _ids, _matrix, _with_vector, dimension_of, in_blocks,
)
from rankweave.operators.topk import rounded, top_k
from rankweave.session import workspace

TRAIN_ROWS = 65_536     # most vectors the codebooks are fitted on
MAX_BUCKETS = 65_536    # most buckets (folders) of the full vectors
MIN_BUCKET_ROWS = 8     # fewest vectors in a bucket, on average
CHUNK = 1 << 22         # approximate scores computed at a time inside a task


@dataclass(frozen=True)
class PQIndex:
    codes: DataFrame        # doc_id, code (m bytes)
    vectors: DataFrame      # doc_id, embedding, bucket; written partitioned by bucket
    codebooks: np.ndarray   # m x ks x (dim / m), centres of unit sub-vectors
    low: int                # smallest doc_id
    width: int              # doc_ids per bucket
    n: int                  # vectors indexed

    def bucket(self, doc_id: Column) -> Column:
        return ((doc_id - F.lit(self.low)) / F.lit(self.width)).cast("long")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, ks: int, iters: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means; with fewer distinct points than ks, the points themselves (repeated)."""
    points = np.unique(x, axis=0)
    if len(points) <= ks:
        return points[np.arange(ks) % len(points)]
    centres = points[rng.choice(len(points), ks, replace=False)]
    for _ in range(iters):
        near = _assign(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=ks)
        empty = counts == 0
        centres = np.where(empty[:, None], centres, sums / np.maximum(counts, 1)[:, None])
    return centres


def _assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row (squared Euclidean), the lower number among equals."""
    d = (x ** 2).sum(1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(1)[None, :]
    return np.argmin(d, axis=1)


def _encode(x: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    m, _, sub = codebooks.shape
    parts = _unit(x).reshape(len(x), m, sub)
    return np.stack([_assign(parts[:, j], codebooks[j]) for j in range(m)], axis=1).astype(np.uint8)


def train_codebooks(docs: DataFrame, dim: int, m: int, ks: int, train_rows: int, seed: int, iters: int = 25) -> np.ndarray:
    """Codebooks from a sample of at most `train_rows` vectors (docs: doc_id, embedding)."""
    n = docs.count()
    fraction = min(1.0, 1.5 * train_rows / max(n, 1))
    sample = docs.sample(fraction=fraction, seed=seed).limit(train_rows).select("embedding").toArrow()
    x = _unit(_matrix(sample["embedding"].combine_chunks(), dim)) if sample.num_rows else np.ones((1, dim)) / np.sqrt(dim)
    rng = np.random.default_rng(seed)
    parts = x.reshape(len(x), m, dim // m)
    return np.stack([_kmeans(parts[:, j], ks, iters, rng) for j in range(m)])


def build_pq(corpus: DataFrame, m: int = 16, ks: int = 256, path: str | None = None, dim: int | None = None,
             train_rows: int = TRAIN_ROWS, bucket_rows: int | None = None, seed: int = 1) -> PQIndex:
    """Encode every vector of `corpus` (doc_id, embedding) and write codes and vectors.

    Buckets hold `bucket_rows` vectors on average; by default as few as keep their
    number at most MAX_BUCKETS, and at least MIN_BUCKET_ROWS.
    """
    if not 1 <= ks <= 256:
        raise ValueError("ks must lie in 1..256: a code is one byte")
    spark = corpus.sparkSession
    dim = dim or dimension_of(corpus, "embedding")
    if dim % m:
        raise ValueError(f"dimension {dim} is not a multiple of m={m}")
    docs = _with_vector(corpus, dim).filter(F.exists("embedding", lambda x: x != 0))
    codebooks = train_codebooks(docs, dim, m, ks, train_rows, seed)
    stats = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).head()
    n, low = stats["n"], stats["low"] or 0
    span = (stats["high"] or 0) - low + 1
    bucket_rows = bucket_rows or max(MIN_BUCKET_ROWS, -(-n // MAX_BUCKETS))
    width = max(1, -(-span * bucket_rows // max(n, 1)))
    shared = spark.sparkContext.broadcast(codebooks)  # m x ks x dim/m doubles: at most 256 * dim * 8 bytes

    def encode(batches):
        for batch in batches:
            codes = _encode(_matrix(batch.column("embedding"), dim), shared.value) if batch.num_rows else np.zeros((0, m), np.uint8)
            column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(m), len(codes), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column.cast(pa.binary())], names=["doc_id", "code"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("code", T.BinaryType())])
    path = path or f"{workspace(spark)}/pq-{uuid.uuid4().hex}"
    docs.mapInArrow(encode, schema).write.mode("overwrite").parquet(f"{path}/codes")
    index = PQIndex(None, None, codebooks, low, width, n)
    laid = docs.withColumn("bucket", index.bucket(F.col("doc_id")))
    laid.repartition("bucket").sortWithinPartitions("doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/vectors")
    read = spark.read  # schemas given: an empty table writes no file to infer them from
    return PQIndex(read.schema(schema).parquet(f"{path}/codes"), read.schema(laid.schema).parquet(f"{path}/vectors"),
                   codebooks, low, width, n)


def _tables(queries: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """tables[q, j, c]: product of query q's j-th unit sub-vector with centre c."""
    m, _, sub = codebooks.shape
    return np.einsum("qjd,jcd->qjc", _unit(queries).reshape(len(queries), m, sub), codebooks).astype(np.float32)


def _code_matrix(column: pa.Array, m: int) -> np.ndarray:
    """The m-byte codes of a binary column as an n x m array, without a loop over rows."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, m)


def _candidates(index: PQIndex, asked: pa.Table, rerank: int) -> DataFrame:
    """(query_id, doc_id): the `rerank` best documents of each query by approximate score."""
    dim = index.codebooks.shape[0] * index.codebooks.shape[2]
    query_ids = _ids(asked["query_id"].combine_chunks())
    tables = _tables(_matrix(asked["query_vec"].combine_chunks(), dim), index.codebooks)
    shared = index.codes.sparkSession.sparkContext.broadcast((query_ids, tables))
    m = index.codebooks.shape[0]
    schema = T.StructType([T.StructField("query_id", T.LongType()), index.codes.schema["doc_id"],
                           T.StructField("approx", T.DoubleType())])

    def scan(batches):
        ids, tab = shared.value
        best, everyone = Best(len(ids), rerank), np.arange(len(ids))
        flat = tab.reshape(len(ids), -1)                      # q x (m * ks)
        offsets = np.arange(m) * tab.shape[2]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _code_matrix(batch.column("code"), m)
            docs = _ids(batch.column("doc_id"))
            size = max(1, CHUNK // (len(ids) * m))
            for at in range(0, len(docs), size):
                cols = codes[at:at + size].astype(np.int64) + offsets   # n x m positions into flat
                approx = flat[:, cols].sum(axis=2, dtype=np.float64)     # q x n
                best.add(docs[at:at + size], approx.T, everyone, -np.inf)
        df = best.cut()
        yield pa.RecordBatch.from_arrays([
            pa.array(ids[df["q"].to_numpy(dtype="int64")].astype("int64")),
            pa.array(df["doc_id"].to_numpy(dtype="int64")),
            pa.array(df["score"].to_numpy(dtype="float64")),
        ], names=["query_id", "doc_id", "approx"])

    return top_k(index.codes.mapInArrow(scan, schema), rerank, score="approx").select("query_id", "doc_id")


def _cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return dot / (norm(a) * norm(b))


def nearest_pq(index: PQIndex, queries: DataFrame, k: int = 20, rerank: int = 200,
               query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Cosine neighbours (query_id, doc_id, score, rank): approximate scan, exact re-rank.

    A block holds at most RESULT_ROWS // rerank queries, so the candidates of a block,
    which are broadcast to prune the buckets of vectors, stay below RESULT_ROWS rows.
    """
    spark = queries.sparkSession
    m, ks, sub = index.codebooks.shape
    dim = m * sub
    fits = F.col("query_vec").isNotNull() & (F.size("query_vec") == dim) & F.exists("query_vec", lambda x: x != 0)
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "query_vec").filter(fits)
    block_rows = max(1, min(query_bytes // (4 * m * ks), RESULT_ROWS // max(rerank, k)))

    def search(asked: pa.Table) -> DataFrame:
        asked_df = spark.createDataFrame(asked)
        picked = F.broadcast(_candidates(index, asked, rerank).withColumn("bucket", index.bucket(F.col("doc_id"))))
        vectors = index.vectors.select("bucket", "doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
        scored = picked.join(vectors, ["bucket", "doc_id"]).join(F.broadcast(asked_df), "query_id")
        exact = scored.select("query_id", "doc_id", rounded(_cosine(F.col("embedding"), F.col("query_vec").cast("array<double>"))).alias("score"))
        return top_k(exact, k)

    return in_blocks(queries, block_rows, search, "nearest-pq")


def bytes_read(index: PQIndex, candidates: DataFrame) -> dict:
    """Logical bytes one search reads, against exact search over the same vectors.

    Codes: every vector's doc_id (8) and m code bytes. Re-rank: doc_id and the float
    vector (4 x dim) of every vector in a bucket that holds a candidate. Exact search
    reads doc_id and vector of all. `candidates` holds the doc_id of a block's candidates.
    """
    m, _, sub = index.codebooks.shape
    row = 8 + 4 * m * sub
    buckets = candidates.select(index.bucket(F.col("doc_id")).alias("bucket")).distinct()
    touched = index.vectors.join(buckets, "bucket", "left_semi").count()
    read = index.n * (8 + m) + touched * row
    return {"codes": index.n * (8 + m), "rerank": touched * row, "exact": index.n * row,
            "share": read / (index.n * row) if index.n else 0.0}
