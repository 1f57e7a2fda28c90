"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pending merges of a pre-token wait in one bucket per merge rank. A two level
bitmap over the ranks says which buckets hold anything, so the next rank is two
find-first-set steps, whatever the length of the pre-token. A bucket holds
positions of a doubly linked list of tokens, drained left to right; an entry whose
position has another rank by now is stale and skipped. A pre-token of n bytes
thus costs O(n log n) in all, where rescanning all pairs for each merge is
quadratic. Texts are whole; a worker merges each distinct pre-token once.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import arrow_schema, whole

#: Ranks under one bit of the upper bitmap.
LEAF = 256  # the shifts by 8 below
#: Distinct pre-tokens remembered by a worker, and the longest of them in characters.
CACHE, CACHED_LENGTH = 1_200_000, 100


BIT = [1 << i for i in range(LEAF)]


def merge_bytes(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """Token ids of one pre-token: always the lowest rank, leftmost first."""
    if data in ranks:
        return [ranks[data]]
    n, get = len(data), ranks.get
    # The queue: positions by rank, a bit for each rank in use, a bit for each leaf in use.
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    top = 0
    now = [get(data[i:i + 2], -1) for i in range(n - 1)] + [-1]  # the rank of the pair that starts here
    for i, r in enumerate(now):
        if r in buckets:
            buckets[r].append(i)
        elif r >= 0:
            buckets[r] = [i]
            leaves[r >> 8] = leaves.get(r >> 8, 0) | BIT[r & 255]
            top |= 1 << (r >> 8)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the token that starts here ends, and starts before
    while top:
        low = top & -top
        leaf = low.bit_length() - 1
        word = leaves[leaf]
        first = word & -word
        rank = (leaf << 8) + first.bit_length() - 1
        if word == first:
            del leaves[leaf]
            top ^= low
        else:
            leaves[leaf] = word ^ first
        bucket = buckets.pop(rank)
        if len(bucket) > 1:
            bucket.sort()
        for k, i in enumerate(bucket, 1):
            if now[i] != rank:
                continue  # stale: a neighbour has merged meanwhile
            j = ends[i]
            now[j] = -1
            end = ends[i] = ends[j]
            here = there = -1
            if end < n:
                before[end] = i
                here = get(data[i:ends[end]], -1)
            now[i] = here
            h = before[i]
            if h >= 0:
                there = now[h] = get(data[h:end], -1)
            if here < 0 and there < 0:
                continue
            sooner = False
            for at, r in ((i, here), (h, there)):
                if r < 0:
                    continue
                sooner = sooner or r < rank
                if r in buckets:
                    buckets[r].append(at)
                else:
                    buckets[r] = [at]
                    leaves[r >> 8] = leaves.get(r >> 8, 0) | BIT[r & 255]
                    top |= 1 << (r >> 8)
            if sooner and k < len(bucket):  # a new pair comes first; the others wait
                buckets[rank] = bucket[k:]
                leaves[leaf] = leaves.get(leaf, 0) | first
                top |= low
                break
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i:ends[i]]])
        i = ends[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe(dict):
    """Encoder and decoder of one rank table and pre-token pattern.

    Maps pre-tokens to their ids (32-bit numbers); a missing one is merged.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for data, rank in ranks.items():
            self.bytes_of[rank] = data
        self.decimal_of = list(map(str, range(len(self.bytes_of))))

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", merge_bytes(self.ranks, piece.encode())).tobytes()
        if len(piece) <= CACHED_LENGTH:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> array:
        if len(self) > CACHE:
            self.clear()
        return array("I", b"".join(map(self.__getitem__, self.split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the bytes decoded from them."""
        ids = self.encode(text)
        decimal = " ".join(map(self.decimal_of.__getitem__, ids))
        return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


_kept: dict[str, ByteBpe] = {}


def _bpe_of(ranks: dict[bytes, int], pattern: str, key: str) -> ByteBpe:
    """One encoder for each vocabulary and pattern of a worker, so that tasks share what it remembers."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = ByteBpe(ranks, pattern)
    return _kept[key]


ENCODED = "_id long, ids array<int>"
DIGESTS = "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _over_texts(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, ddl: str, row) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # one vocabulary: a fixed size
    key = f"{ranks_path}\0{pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = _bpe_of(shared.value, pattern, key), arrow_schema(ddl)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [(i, *row(bpe, t)) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), whole(F.col(text_col)).alias("_text"))
    return texts.mapInArrow(run, ddl).withColumnRenamed("_id", id_col)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: the token ids of every whole text.

    Null and empty texts have no ids. Rows are taken one by one: repeated rows,
    null ids and empty tables are fine, other columns are not read.
    """
    return _over_texts(docs, id_col, text_col, ranks_path, pattern, ENCODED, lambda bpe, text: (bpe.encode(text).tolist(),))


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, data: the bytes of a row's ids; null ids read as none. An unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast({v: k for k, v in read_ranks(ranks_path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [b"".join(map(shared.value.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["_id", "data"])

    return encoded.select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col)).mapInArrow(
        run, "_id long, data binary").withColumnRenamed("_id", id_col)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; cases as in `encode`.

    Encoding and decoding happen in one pass, so that ids never leave a task.
    """
    return _over_texts(docs, id_col, text_col, ranks_path, pattern, DIGESTS, ByteBpe.digests)
