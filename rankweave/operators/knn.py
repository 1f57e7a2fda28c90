"""Nearest neighbours of a table of queries (query_id, query_vec) in a corpus
(doc_id, embedding).

Exact search compares every query with every vector, but never emits the
pairs: a task multiplies its Arrow batches with the query matrix and keeps k
rows per query, so k rows per query and task are shuffled, whatever the corpus
size. Queries are broadcast in blocks of a bounded size and the corpus stays where
it is read.

Cells restrict each query to its nearest cells: approximate, with the share of
pairs scanned to be reported next to the recall.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankweave.operators.topk import SCORE_DIGITS, top_k
from rankweave.session import workspace, written

QUERY_BYTES = 64 << 20      # largest broadcast query matrix
CHUNK_CELLS = 4 << 20       # scores computed at a time inside a task
RESULT_ROWS = 1_000_000     # most hits (queries x k) one task keeps


def half_up(x: np.ndarray) -> np.ndarray:
    scale = 10.0 ** SCORE_DIGITS
    return np.copysign(np.floor(np.abs(x) * scale + 0.5) / scale, x)


def _scores(docs: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Score matrix, larger is better; NaN where a score does not exist."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if metric == "cosine":
            docs = docs / np.linalg.norm(docs, axis=1, keepdims=True)
            queries = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        products = docs @ queries.T
    if metric == "l2":
        squares = (docs ** 2).sum(1)[:, None] + (queries ** 2).sum(1)[None, :] - 2 * products
        return -half_up(np.sqrt(np.maximum(squares, 0)))
    return half_up(products)


class Best:
    """The k best documents per query seen so far by one task."""

    def __init__(self, n_queries: int, k: int):
        self.n, self.k = n_queries, k
        self.floor = np.full(n_queries, -np.inf)
        self.parts: list[pd.DataFrame] = []
        self.rows = 0

    def add(self, ids: np.ndarray, scores: np.ndarray, columns: np.ndarray, least: float) -> None:
        scores = np.where(scores >= least, scores, -np.inf)  # NaN compares false
        floor = self.floor[columns]
        if len(ids) > self.k:
            kth = np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
            floor = np.maximum(floor, kth)
        row, col = np.nonzero((scores >= floor) & np.isfinite(scores))
        if len(row) == 0:
            return
        self.parts.append(pd.DataFrame({"q": columns[col], "doc_id": ids[row], "score": scores[row, col]}))
        self.rows += len(row)
        if self.rows > 4 * self.n * self.k:
            self.cut()

    def cut(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"q": [], "doc_id": [], "score": []})
        df = pd.concat(self.parts, ignore_index=True)
        df = df.sort_values(["q", "score", "doc_id"], ascending=[True, False, True])
        place = df.groupby("q").cumcount().to_numpy()
        df = df[place < self.k]
        full = df[place[place < self.k] == self.k - 1]
        self.floor[full["q"].to_numpy(dtype="int64")] = full["score"].to_numpy()
        self.parts, self.rows = [df], len(df)
        return df


def _feed(best: Best, ids, docs, cells, queries, probes, metric, least) -> None:
    """Compare documents with queries; with cells, only those probing the cell."""
    everyone = np.arange(len(queries))
    groups = [(slice(None), everyone)] if probes is None else [
        (cells == c, np.flatnonzero(probes[:, c])) for c in np.unique(cells)
    ]
    for member, columns in groups:
        if len(columns) == 0:
            continue
        some_ids, some_docs = ids[member], docs[member]
        size = max(1, CHUNK_CELLS // len(columns))
        for at in range(0, len(some_ids), size):
            part = _scores(some_docs[at:at + size], queries[columns], metric)
            best.add(some_ids[at:at + size], part, columns, least)


def best_rows(best: Best, query_ids: np.ndarray, metric: str, schema: pa.Schema) -> list[pa.Array]:
    df = best.cut()
    sign = -1.0 if metric == "l2" else 1.0
    columns = (query_ids[df["q"].to_numpy(dtype="int64")], df["doc_id"], df["score"].to_numpy() * sign + 0.0)
    return [pa.array(values.tolist(), field.type) for values, field in zip(columns, schema)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("float64")


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _schema(corpus: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("doc_id", corpus.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _least(metric: str, max_distance: float | None) -> float:
    """Smallest score kept. The distance of cosine is 1 - similarity."""
    if max_distance is None:
        return -np.inf
    return 1.0 - max_distance if metric == "cosine" else -max_distance


def _broadcast_search(corpus, query_table: pa.Table, dim, k, metric, least, schema, probes=None) -> DataFrame:
    query_ids = _ids(query_table["query_id"].combine_chunks())
    matrix = _matrix(query_table["query_vec"].combine_chunks(), dim)
    shared = corpus.sparkSession.sparkContext.broadcast((query_ids, matrix, probes))

    arrow = to_arrow_schema(schema)

    def search(batches):
        ids, queries, wanted = shared.value
        best = Best(len(ids), k)
        for batch in batches:
            cells = None if wanted is None else batch.column("cell").to_numpy()
            _feed(best, _ids(batch.column("doc_id")), _matrix(batch.column("embedding"), dim),
                  cells, queries, wanted, metric, least)
        yield pa.RecordBatch.from_arrays(best_rows(best, ids, metric, arrow), schema=arrow)
    return corpus.mapInArrow(search, schema)


def dimension_of(df: DataFrame, column: str) -> int:
    """The most frequent dimension, of equally frequent ones the larger; 1 without vectors."""
    sizes = df.filter(F.col(column).isNotNull()).groupBy(F.size(column).alias("dim")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("dim")).head()
    return first["dim"] if first else 1


def misfits(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows whose vector has another dimension; searches leave these out."""
    return df.filter(F.col(column).isNotNull() & (F.size(column) != dim))


def in_blocks(queries: DataFrame, rows: int, search: Callable[[pa.Table], DataFrame], name: str) -> DataFrame:
    """Search at most about `rows` queries at a time.

    One block is searched where its result is used. Of several, each scans the corpus
    by itself and its result is written before the next begins, so the driver holds
    one block at a time.
    """
    n = -(-queries.count() // rows)
    if n <= 1:
        return search(queries.toArrow())
    block = F.pmod(F.xxhash64("query_id"), F.lit(n))
    parts = [written(search(queries.filter(block == b).toArrow()), name) for b in range(n)]
    return reduce(DataFrame.unionByName, parts)


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 20, metric: str = "cosine",
            max_distance: float | None = None, dim: int | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact k nearest: (query_id, doc_id, score, rank).

    Rows without a vector, or of another dimension than `dim` (by default the most
    frequent one of the queries), take no part; see `misfits`. Nor do zero vectors
    under cosine. `score` is the similarity, or the distance for `l2`.
    """
    queries = queries.select("query_id", "query_vec").filter("query_vec IS NOT NULL")
    dim = dim or dimension_of(queries, "query_vec")
    schema, docs, least = _schema(corpus, queries), _with_vector(corpus, dim), _least(metric, max_distance)

    def search(asked: pa.Table) -> DataFrame:
        return top_k(_broadcast_search(docs, asked, dim, k, metric, least, schema), k, descending=metric != "l2")

    return in_blocks(queries.filter(F.size("query_vec") == dim), _block_rows(query_bytes, dim, k), search, "nearest")


def _with_vector(corpus: DataFrame, dim: int, *more: str) -> DataFrame:
    return corpus.select("doc_id", "embedding", *more).filter(
        F.col("embedding").isNotNull() & (F.size("embedding") == dim)
    )


def _block_rows(query_bytes: int, dim: int, k: int) -> int:
    return max(1, min(query_bytes // (8 * dim), RESULT_ROWS // k))


@dataclass(frozen=True)
class CellIndex:
    docs: DataFrame       # doc_id, embedding, partitioned by cell
    centers: np.ndarray   # one row per cell


def _nearest_cells(centers: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n cells with the most similar centres, the lower number first among equals."""
    return np.argsort(-_scores(centers, vectors, "cosine").T, axis=1, kind="stable")[:, :n]


def build_cells(corpus: DataFrame, n_cells: int, path: str | None = None, seed: int = 1, dim: int | None = None,
                centers: list | None = None) -> CellIndex:
    """Put each vector into the cell of its most similar centre and write them by cell.

    Centres are given or found by k-means under cosine distance. A hot cell gets
    several files. Zero vectors have no direction and take no part.
    """
    spark = corpus.sparkSession
    dim = dim or dimension_of(corpus, "embedding")
    docs = _with_vector(corpus, dim).filter(F.exists("embedding", lambda x: x != 0))
    if centers is None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        features = docs.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
        model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", featuresCol="features").fit(features)
        centers = model.clusterCenters()
    matrix = np.array(centers, dtype="float64")

    def place(batches):
        for batch in batches:
            cell = np.zeros(0, "int32")
            if batch.num_rows:
                vectors = _matrix(batch.column("embedding"), dim)
                size = max(1, CHUNK_CELLS // len(matrix))
                cell = np.concatenate([_nearest_cells(matrix, vectors[at:at + size], 1)[:, 0]
                                       for at in range(0, len(vectors), size)]).astype("int32")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    schema = T.StructType([*docs.schema.fields, T.StructField("cell", T.IntegerType())])
    path = path or f"{workspace(spark)}/cells-{uuid.uuid4().hex}"
    docs.mapInArrow(place, schema).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    return CellIndex(spark.read.schema(schema).parquet(path), matrix)


def nearest_in_cells(index: CellIndex, queries: DataFrame, k: int = 20, probes: int = 3,
                     query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Cosine neighbours among the `probes` nearest cells of each query.

    Only the cells asked for are read, whatever the number of queries.
    """
    dim, schema = index.centers.shape[1], _schema(index.docs, queries)
    queries = queries.select("query_id", "query_vec").filter(F.col("query_vec").isNotNull() & (F.size("query_vec") == dim))

    def search(asked: pa.Table) -> DataFrame:
        wanted = _probed(index, asked, probes)
        cells = [int(c) for c in np.flatnonzero(wanted.any(axis=0))]
        docs = _with_vector(index.docs.filter(F.col("cell").isin(cells)), dim, "cell")
        return top_k(_broadcast_search(docs, asked, dim, k, "cosine", -np.inf, schema, wanted), k)

    return in_blocks(queries, _block_rows(query_bytes, dim, k), search, "nearest-in-cells")


def _probed(index: CellIndex, asked: pa.Table, probes: int) -> np.ndarray:
    """probed[query, cell]"""
    matrix = _matrix(asked["query_vec"].combine_chunks(), index.centers.shape[1])
    wanted = np.zeros((len(matrix), len(index.centers)), dtype=bool)
    np.put_along_axis(wanted, _nearest_cells(index.centers, matrix, probes), True, axis=1)
    return wanted


def scanned_share(index: CellIndex, queries: DataFrame, probes: int) -> float:
    """Share of all (query, document) pairs that `nearest_in_cells` compares, for one block of queries."""
    sizes = {r["cell"]: r["count"] for r in index.docs.groupBy("cell").count().collect()}  # one row per cell
    fits = F.col("query_vec").isNotNull() & (F.size("query_vec") == index.centers.shape[1])
    wanted = _probed(index, queries.select("query_id", "query_vec").filter(fits).toArrow(), probes)
    per_cell = np.array([sizes.get(c, 0) for c in range(len(index.centers))])
    return float((wanted @ per_cell).sum() / (per_cell.sum() * len(wanted))) if per_cell.sum() and len(wanted) else 0.0
