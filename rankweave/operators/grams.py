"""Infix search by a gram index: which documents hold a needle anywhere in their text.

The index holds, for blocks of some texts, every distinct string of one, two and three
code points of the lower-cased texts with the ids of the block's documents that hold it;
and the number of documents of each gram. A needle of three or more code points names
its distinct trigrams; only the `rarest` of them by document count are intersected (a
document must hold every one of them), and each candidate is verified by `contains` on
its lower-cased text, so the answer is exact: the grams only choose where to look. A
needle shorter than three is itself a gram and is looked up directly; no needle is
compared with every text.

Null texts hold nothing; a null or empty needle finds nothing. Repeated needles keep
their own ids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

GRAM = 3
RAREST = 2
BLOCK_POINTS = 2 << 20      # code points of a block, one text at least
POINT_BITS = 21             # a code point and one more


@dataclass(frozen=True)
class GramIndex:
    grams: DataFrame    # gram, docs (ids of one block's documents)
    counts: DataFrame   # gram, df
    texts: DataFrame    # doc_id, low (lower-cased text)


def _grams(text, n: int = GRAM):
    """Distinct substrings of n code points; none for a shorter text."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.when(F.length(text) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _spelled(code: int) -> str:
    out = ""
    while code:
        out += chr((code & ((1 << POINT_BITS) - 1)) - 1)
        code >>= POINT_BITS
    return out


def _block(ids: pa.Array, texts: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """(gram, docs) of some texts: a gram is one number of up to three code points."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="uint32").astype("int64") + 1
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes, rows, code = [], [], np.zeros(len(points), dtype="int64")
    for n in range(min(GRAM, len(points))):
        code = code[:len(points) - n] | points[n:] << (POINT_BITS * n)
        inside = row[:len(points) - n] == row[n:]
        codes.append(code[inside])
        rows.append(row[:len(points) - n][inside])
    number, names = pd.factorize(np.concatenate(codes))  # by hashing; only distinct pairs are sorted
    pairs = np.sort(pd.unique(number * len(texts) + np.concatenate(rows)))
    starts = np.searchsorted(pairs, np.arange(len(names) + 1) * len(texts))
    docs = pa.ListArray.from_arrays(pa.array(starts.astype("int32")), ids.take(pa.array(pairs % len(texts))))
    return pa.RecordBatch.from_arrays(
        [pa.array([_spelled(c) for c in names.tolist()], schema[0].type), docs.cast(schema[1].type)], schema=schema)


def gram_lists(texts: DataFrame) -> DataFrame:
    """(gram, docs): for each block of texts its grams with the ids of their documents."""
    kind = T.StructType([T.StructField("gram", T.StringType()), T.StructField("docs", T.ArrayType(texts.schema["doc_id"].dataType))])
    schema = to_arrow_schema(kind)

    def split(batches):
        for batch in batches:
            low = batch.column("low").to_pylist()
            at = 0
            while at < len(low):
                end, size = at + 1, len(low[at])
                while end < len(low) and size + len(low[end]) <= BLOCK_POINTS:
                    size += len(low[end])
                    end += 1
                yield _block(batch.column("doc_id").slice(at, end - at), low[at:end], schema)
                at = end

    return texts.select("doc_id", "low").filter(F.length("low") > 0).mapInArrow(split, kind)


def build_gram_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> GramIndex:
    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("low"))
    grams = gram_lists(texts)
    return GramIndex(grams, gram_counts(grams), texts)


def gram_counts(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram").agg(F.sum(F.size("docs").cast("long")).alias("df"))


def infix_indexed(needles: DataFrame, index: GramIndex, id_col: str = "needle_id", needle_col: str = "needle") -> DataFrame:
    """(needle_id, doc_id) for every document whose lower-cased text holds the lower-cased needle."""
    asked = needles.select(F.col(id_col).alias("needle_id"), F.lower(F.col(needle_col)).alias("needle")).filter(
        F.col("needle").isNotNull() & (F.col("needle") != ""))
    long_ones = asked.filter(F.length("needle") >= GRAM)
    wanted = long_ones.select("needle_id", F.explode(_grams(F.col("needle"))).alias("gram"))
    ranked = wanted.join(index.counts, "gram", "left").withColumn(
        "place", F.row_number().over(Window.partitionBy("needle_id").orderBy(F.coalesce("df", F.lit(0)), "gram")))
    picked = ranked.filter(F.col("place") <= RAREST).select("needle_id", "gram")
    n_picked = picked.groupBy("needle_id").agg(F.count(F.lit(1)).alias("n"))
    holders = picked.join(index.grams, "gram").select("needle_id", F.explode("docs").alias("doc_id")).groupBy(
        "needle_id", "doc_id").agg(F.count(F.lit(1)).alias("held"))
    candidates = holders.join(n_picked, "needle_id").filter(F.col("held") == F.col("n")).select("needle_id", "doc_id")
    found = (candidates.join(long_ones, "needle_id").join(index.texts, "doc_id")
             .filter(F.col("low").contains(F.col("needle"))).select("needle_id", "doc_id"))

    # short needles are grams themselves
    short = asked.filter(F.length("needle") < GRAM)
    return found.unionByName(short.join(index.grams, F.col("needle") == F.col("gram")).select("needle_id", F.explode("docs").alias("doc_id")))
