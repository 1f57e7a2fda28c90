"""Small helpers shared by the operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text: runs of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """A text, null read as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a simple `name type, ...` list."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
             "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names like `wanted` that no column of `taken` has (compared without case)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        candidate, n = name, 0
        while candidate.lower() in used:
            n += 1
            candidate = f"{name}_{n}"
        used.add(candidate.lower())
        out.append(candidate)
    return out


def chosen_rows(docs: DataFrame, id_col: str, mark: Column, chosen: DataFrame, chosen_id: str, chosen_mark: str) -> DataFrame:
    """One row per (id, mark) in `chosen` of `docs`, with all its columns as they were; null ids are equal.

    Join and window use the same keys, so the rows move once. Helper columns take
    names that no column of `docs` has, and the result keeps `docs`' columns by
    position, so any name (clashing or odd) passes unchanged.
    """
    width = len(docs.columns)
    places = [f"__rw_c{i}" for i in range(width)]
    key, flag, row = free_names(places, "__rw_id", "__rw_mark", "__rw_row")
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    own = docs.select("*", plain(docs[id_col]).alias("__rw_key"), mark.alias("__rw_flag")).toDF(*places, key, flag)
    wanted = chosen.select(plain(chosen[chosen_id]).alias(key), chosen[chosen_mark].alias(flag))
    rows = F.row_number().over(Window.partitionBy(key, flag).orderBy(key, flag))
    kept = own.join(wanted, [key, flag], "left_semi").withColumn(row, rows).filter(F.col(row) == 1)
    return kept.select(*places).toDF(*docs.columns)


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
