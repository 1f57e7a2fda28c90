"""Vectors held as ARRAY<FLOAT>: text form, checks, metrics, hash embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rankweave.functions.text import Analyzer

#: Rows summed in one matrix.
CHUNK_ROWS = 1000

NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def parse_vector(text: Column) -> Column:
    """`[a,b]` to doubles. Null, '' and '0' are no vector; bad numbers are 0."""
    parts = F.split(F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", ""), ",")
    number = lambda x: F.coalesce(F.regexp_extract(x, NUMBER_PREFIX, 1).try_cast("double"), F.lit(0.0))
    return F.when(~text.isin("", "0"), F.transform(parts, number))


def format_vector(vector: Column) -> Column:
    parts = F.transform(vector, lambda x: x.cast("string"))
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def is_valid_vector(vector: Column, dim: int) -> Column:
    """True for `dim` numbers; null vectors are not valid."""
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce((F.size(vector) == dim) & numbers, F.lit(False))


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null when a vector is zero: it has no direction."""
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


METRICS = {"cosine": cosine_similarity, "l2": l2_distance, "inner_product": inner_product}


def register_sql_functions(spark: SparkSession) -> None:
    """`cosine_similarity(a, b)` for SQL users, null for a zero vector."""
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<FLOAT>, b ARRAY<FLOAT>)
        RETURNS DOUBLE
        RETURN try_divide({dot.format('a', 'b')}, sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')}))
    """)


def hash_slots(terms: Column, dim: int) -> Column:
    """Signed slot of every term, +-(1..dim), from the hex digits of its MD5."""
    def slot(term):
        digest = F.md5(term.cast("binary"))
        place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim + 1
        return F.when(F.substring(digest, 9, 1) < "8", place).otherwise(-place).cast("int")
    return F.transform(terms, slot)


def sum_slots(dim: int):
    """Arrow UDF: sum signed slots into a unit vector; null when nothing is left."""
    def unit_vectors(slots: pa.Array) -> pa.Array:
        parts = [_unit_vectors(slots.slice(at, CHUNK_ROWS), dim) for at in range(0, len(slots), CHUNK_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))
    return F.arrow_udf(unit_vectors, ArrayType(FloatType()))


def _unit_vectors(slots: pa.Array, dim: int) -> pa.Array:
    """One matrix for all rows: every slot of every row is summed at once."""
    n = len(slots)
    lengths = pc.fill_null(pc.list_value_length(slots), 0).to_numpy(zero_copy_only=False)
    values = slots.flatten().to_numpy(zero_copy_only=False).astype("int64")
    place = np.repeat(np.arange(n) * dim, lengths) + np.abs(values) - 1
    total = np.bincount(place, weights=np.sign(values), minlength=n * dim).reshape(n, dim)
    norm = np.sqrt((total ** 2).sum(axis=1))
    some = norm > 0
    flat = (total[some] / norm[some, None]).astype("float32").ravel()
    offsets = np.concatenate([[0], np.cumsum(some * dim)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array(~some))


def hash_embed(text: Column, dim: int = 768, analyzer: Analyzer = Analyzer("simple")) -> Column:
    """Default offline embedder: signed feature hashing of the terms, unit length.

    Hashing runs in the JVM; one Arrow UDF adds the slots up. Any other
    `pandas_udf(string -> array<float>)` can stand in its place.
    """
    return sum_slots(dim)(hash_slots(analyzer.terms(text), dim))


def embed_fields(columns: list[str], dim: int = 768, embed=hash_embed) -> Column:
    return embed(F.concat_ws(" ", *columns), dim)
