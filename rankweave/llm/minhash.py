"""One-permutation MinHash fingerprints with optimal densification.

Each shingle is hashed once. The high bits of the hash choose a bin, the smallest
hash in a bin is its value. An empty bin takes the value of a full one: it probes
bins by a hash of (bin, attempt), the same for all texts, until it meets a full
one, so that equal bins are filled alike and bins stay independent. Of every value
only the low bits are kept. Two unrelated values agree in them by chance with
probability 2^-bits, which the likeness is corrected for.

The edited text of a document needs the start of the document after it. Documents
are dealt out in ranges of their ids and read in order; the first document of each
range is also sent to the range before, so neighbours always meet.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import arrow_schema, partitions, whole

#: Kept of every bin: this many low bits.
BINS, BITS, SHINGLE = 512, 4, 5
CACHE, CACHED_LENGTH = 200_000, 200
NEAR = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def probe_order(bins: int, attempts: int = 64) -> np.ndarray:
    """probe[bin, attempt]: the bin to look at."""
    keys = np.arange(bins * attempts, dtype=np.uint64).reshape(bins, attempts)
    return (mix(keys + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64)


class Fingerprints:
    """Fingerprints of texts; words are remembered by their hashes."""

    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE):
        if bins & bins - 1 or 8 % bits:
            raise ValueError("bins must be a power of two and bits divide 8")
        self.bins, self.bits, self.width = bins, bits, shingle
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        self.starts = np.arange(bins, dtype=np.uint64) << self.shift
        self.salts = mix(np.arange(1, bins + 1, dtype=np.uint64))
        self.probes, self.known = probe_order(bins), {}

    def word(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= CACHED_LENGTH:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = h
        return h

    def values(self, data: bytes) -> np.ndarray:
        """The dense bins of a text: its words lower-cased (A-Z), cut at ASCII white space."""
        words, get, one = data.lower().split(), self.known.get, self.word
        h = np.fromiter((get(w) or one(w) for w in words), dtype=np.uint64, count=len(words))
        k = min(self.width, len(h))
        n = len(h) - k + 1 if k else 1
        x = np.full(n, 0x51ED270B, dtype=np.uint64)
        for i in range(k):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
        x.sort()
        first = np.searchsorted(x, self.starts)
        value = x[np.minimum(first, n - 1)]
        full = (first < n) & (value >> self.shift == np.arange(self.bins, dtype=np.uint64))
        empty = np.flatnonzero(~full)
        if len(empty):
            hit = full[self.probes[empty]]
            step = hit.argmax(axis=1)
            source = self.probes[empty, step]
            lost = ~hit[np.arange(len(empty)), step]
            if lost.any():  # past all attempts: the next full bin
                ring = np.flatnonzero(full)
                source[lost] = ring[np.searchsorted(ring, empty[lost]) % len(ring)]
            value[empty] = value[source]
        return value

    def packed(self, data: bytes) -> bytes:
        # Mixed with the bin's number: where one value fills many bins, chance agrees in each anew.
        low = (mix(self.values(data) ^ self.salts) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        low = low.reshape(-1, 8 // self.bits)
        return (low << np.arange(0, 8, self.bits, dtype=np.uint8)).sum(axis=1).astype(np.uint8).tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """The share of equal bins, less those equal by chance; 0 to 1."""
        x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
        fields = (x[:, None] >> np.arange(0, 8, self.bits, dtype=np.uint8)) & ((1 << self.bits) - 1)
        chance = 2.0**-self.bits
        return float(min(1.0, max(0.0, ((fields == 0).mean() - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """id, fingerprint (bins x bits, packed) of every whole text.

    A text of fewer words than a shingle is one shingle; null and empty texts share
    the fingerprint of no words. Repeated rows, null ids and empty tables are fine;
    other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprints(bins, bits, shingle)
        for batch in batches:
            prints = [of.packed(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["_id", "fingerprint"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), whole(F.col(text_col)).cast("binary").alias("_text"))
    return texts.mapInArrow(run, "_id long, fingerprint binary").withColumnRenamed("_id", id_col)


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """docs(_id, _text, ...) with a column _range of ascending ids, the first row of each
    range sent (as _guest) to the range before as well, that of the first to the last.

    Ids null come first. Borders are approximate quantiles: they balance ranges only.
    """
    order = F.coalesce("_id", F.lit(-2**63))
    borders = docs.select(order.alias("_o")).agg(F.percentile_approx(
        "_o", [i / ranges for i in range(1, ranges)], 10_000).alias("b")).head()["b"] if ranges > 1 else []
    borders = sorted(set(borders or ()))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(borders, dtype=np.int64), ids.to_numpy(dtype=np.int64), side="right")).astype("int32")

    ranged = docs.withColumn("_range", place(order))
    # One row for each range: which ids are first, and in which range the one before lies.
    heads = sorted((r["_range"], r["first"]) for r in ranged.groupBy("_range").agg(F.min(order).alias("first")).collect())
    if not heads:
        return ranged.withColumn("_guest", F.lit(0))
    before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}
    other = F.create_map(*[F.lit(x).cast(t) for pair in before.items() for x, t in zip(pair, ("long", "int"))])
    here = F.struct(F.col("_range").alias("r"), F.lit(0).alias("g"))
    there = F.struct(F.element_at(other, order).alias("r"), F.lit(1).alias("g"))
    places = F.when(order.isin(list(before)), F.array(here, there)).otherwise(F.array(here))
    return ranged.withColumn("_p", F.explode(places)).withColumn("_range", F.col("_p.r")).withColumn("_guest", F.col("_p.g")).drop("_p")


def near_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    Edited: the last floor(n/4) code points give way to as many first ones (or all)
    of the next document by id; the last is followed by the first. Rows of the same
    id follow each other by text. Null text is empty, null ids come first, a single
    row follows itself. Other columns are not read.
    """
    n = partitions(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), whole(F.col(text_col)).alias("_text"))
    dealt = in_ranges(texts, 2 * n).repartition(n, "_range").sortWithinPartitions("_range", "_guest", F.col("_id").asc_nulls_first(), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, schema, at = Fingerprints(), arrow_schema(NEAR), None

        def row(own, text, mark, after, after_mark):
            cut = len(text) // 4
            edited = (text[:len(text) - cut] + after[:cut]).encode()
            edited_mark = of.packed(edited)
            return (own, len(text), hashlib.sha256(edited).hexdigest(), mark.hex(), edited_mark.hex(),
                    of.likeness(mark, edited_mark), of.likeness(mark, after_mark))

        for batch in batches:
            out = []
            for here, guest, own, text in zip(*(batch.column(c).to_pylist() for c in ("_range", "_guest", "_id", "_text"))):
                if at is not None and at[0] != here:
                    raise RuntimeError("a range ended without the first row of the next")
                if at is None and guest:  # further rows with the id of the first guest
                    continue
                mark = of.packed(text.encode())
                if at is not None:
                    out.append(row(*at[1:], text, mark))
                at = None if guest else (here, own, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return dealt.select("_range", "_guest", "_id", "_text").mapInArrow(run, NEAR).withColumnRenamed("doc_id", id_col)
