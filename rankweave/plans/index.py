"""Term index: postings and term statistics of a corpus, written once.

Layout: postings are bucketed by document (`shards`) and partitioned by a hash
of the term (`bucket`).

* All postings of a document lie in one shard, so summing per (query, document)
  needs no shuffle: each task scores its own documents completely and only the
  k best per query leave it. A hot term, held by a third of all documents,
  spreads over all shards.
* Joining with a broadcast set of query terms prunes the scan to the term
  buckets asked for (dynamic partition pruning).

Build: the texts are shuffled once, by document; analysing, counting and
writing then happen in place. Document length is stored with each posting and
the corpus averages with each term, so scoring needs no further join.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankweave.functions.text import Analyzer, full_language, stem_lists
from rankweave.session import workspace

#: Text of a shard: a task that builds or scores it stays short and keeps its sums in memory.
SHARD_BYTES = 32 << 20
MIN_SHARDS, BUCKETS = 8, 4
#: Tokens counted at a time inside a task, one text at least.
BATCH_TOKENS = 1 << 20


@dataclass(frozen=True)
class TermIndex:
    postings: DataFrame   # field, term, doc_id, tf, doc_len, positions, bucket
    terms: DataFrame      # field, term, df, n_docs, avg_len, bucket
    buckets: int
    analyzer: Analyzer
    fields: tuple[str, ...] = ("content",)
    n_docs: int = 0
    shards: int = 0       # 0: the postings are not laid out in shards

    def bucket_of(self, term: Column) -> Column:
        return bucket_of(term, self.buckets)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets))


def by_field(corpus: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, doc_id, text): one row per text."""
    texts = [F.struct(F.lit(name).alias("field"), col.alias("text")) for name, col in fields.items()]
    if len(texts) > 1:
        return corpus.select("doc_id", F.inline(F.array(*texts))).select("field", "doc_id", "text")
    (name, col), = fields.items()
    return corpus.select(F.lit(name).alias("field"), "doc_id", col.alias("text"))


def doc_lengths(corpus: DataFrame, fields: dict[str, Column], analyzer: Analyzer) -> DataFrame:
    """(field, doc_id, doc_len): terms of each text; stemming does not change their number."""
    kept = F.filter(analyzer.unstemmed(F.col("text")), lambda t: t.isNotNull())
    return by_field(corpus, fields).select("field", "doc_id", F.size(kept).alias("doc_len"))


def _counted(field: pa.Array, doc_id: pa.Array, words: pa.ListArray, schema: pa.Schema, with_lengths: bool = False):
    """Postings of some texts, from one stable sort of their tokens by (text, term); then their lengths, if asked for."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype("int64")
    coded = words.flatten().dictionary_encode()
    codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype("int64")
    row = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
    row, pos, codes = (x[codes >= 0] for x in (row, pos, codes))  # stop words only keep their place
    doc_len = np.bincount(row, minlength=len(lengths))
    key = row * max(1, len(coded.dictionary)) + codes
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    first, ends = order[starts], np.append(starts, len(order))
    texts = pa.array(row[first])
    columns = (
        field.take(texts), coded.dictionary.take(pa.array(codes[first])), doc_id.take(texts), pa.array(np.diff(ends).astype("int32")),
        pa.array(doc_len[row[first]].astype("int32")),
        pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(pos[order].astype("int32"))),
    )
    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
    if with_lengths:
        absent = words.is_null().to_numpy(zero_copy_only=False)
        none = [pa.nulls(len(words), schema.field(name).type) for name in ("term", "tf", "positions")]
        columns = (field, none[0], doc_id, none[1], pa.array(doc_len.astype("int32"), mask=absent), none[2])
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def postings_of(corpus: DataFrame, fields: dict[str, Column], analyzer: Analyzer, with_lengths: bool = False) -> DataFrame:
    """Terms counted where the texts lie, some texts at a time: no shuffle.

    With lengths, every text has one more row without a term, which holds its length as `doc_lengths` does.
    """
    english = full_language(analyzer.language) == "english"
    words = (analyzer.unstemmed if english else analyzer.marked)(F.col("text"))
    rows = by_field(corpus, fields).select("field", "doc_id", words.alias("words"))
    kind = T.StructType([
        T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), T.StructField("doc_id", rows.schema["doc_id"].dataType),
        T.StructField("tf", T.IntegerType()), T.StructField("doc_len", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ])
    schema = to_arrow_schema(kind)

    def count(batches):
        for batch in batches:
            tokens = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False).astype("int64"))
            at = 0
            while at < batch.num_rows:
                before = tokens[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(tokens, before + BATCH_TOKENS, "right")))
                part = batch.slice(at, end - at)
                held = part.column("words")
                yield from _counted(part.column("field"), part.column("doc_id"), stem_lists(held) if english else held, schema, with_lengths)
                at = end

    return rows.mapInArrow(count, kind)


def term_stats(postings: DataFrame, n_docs: int) -> DataFrame:
    """df per term with the field's averages, one row per (field, term).

    Every document counts, also one without a term, so the mean length is the
    number of tokens over the number of documents.
    """
    df = postings.groupBy("bucket", "field", "term").agg(F.count(F.lit(1)).alias("df"))
    lengths = postings.groupBy("field").agg(  # one row per field
        F.lit(n_docs).cast("long").alias("n_docs"), (F.sum("tf") / F.lit(n_docs)).alias("avg_len")
    )
    return df.join(F.broadcast(lengths), "field")


def shards_for(text_bytes: int) -> int:
    """Shards, and with them tasks, grow with the text without a bound."""
    return max(MIN_SHARDS, -(-text_bytes // SHARD_BYTES))


def measured(corpus: DataFrame, fields: dict[str, Column]) -> tuple[int, int]:
    """Rows, and bytes of their texts."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in fields.values()), F.lit(0))
    found = corpus.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).head()
    return found["n"], found["bytes"]


def catalog_name(path: str) -> str:
    """Tables are named by the whole path: equal last parts do not meet."""
    return "rankweave_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(META).json(f"{path}/meta").head()
        return True
    except AnalysisException:
        return False


META = ("n_docs BIGINT, shards BIGINT, buckets BIGINT, fields ARRAY<STRING>, language STRING, "
        "separators ARRAY<STRING>, symbols ARRAY<STRING>")


def build_index(
    corpus: DataFrame,
    fields: dict[str, Column],
    analyzer: Analyzer = Analyzer(),
    path: str | None = None,
    shards: int | None = None,
    buckets: int = BUCKETS,
) -> TermIndex:
    """Write the index tables of a corpus that has a unique `doc_id`.

    An index is never written over another: the path must be free. Its settings lie
    beside the tables, so `open_index` needs the path only.
    """
    spark = corpus.sparkSession
    path = path or f"{workspace(spark)}/index-{uuid.uuid4().hex}"
    if _exists(spark, path):
        raise FileExistsError(f"{path} holds an index")
    n_docs, text_bytes = measured(corpus, fields)
    shards = shards or shards_for(text_bytes)
    name = catalog_name(path)
    placed = corpus.repartition(shards, "doc_id")
    postings = postings_of(placed, fields, analyzer)
    (
        postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
        .sortWithinPartitions("bucket", "term")
        .write.mode("error").format("parquet").option("path", f"{path}/postings")
        .partitionBy("bucket").bucketBy(shards, "doc_id").saveAsTable(f"{name}_postings")
    )
    (
        term_stats(spark.table(f"{name}_postings"), n_docs)
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term")
        .write.mode("error").format("parquet").option("path", f"{path}/terms")
        .partitionBy("bucket").saveAsTable(f"{name}_terms")
    )
    settings = (n_docs, shards, buckets, list(fields), analyzer.language, list(analyzer.separators), list(analyzer.symbols))
    spark.createDataFrame([settings], META).write.json(f"{path}/meta")  # last: only a whole index can be opened
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> TermIndex:
    """The index at `path`; its tables are registered in the session's catalog if they are not yet."""
    meta, name = spark.read.schema(META).json(f"{path}/meta").head(), catalog_name(path)
    for kind, layout in (("postings", f"CLUSTERED BY (doc_id) INTO {meta['shards']} BUCKETS"), ("terms", "")):
        table = f"{name}_{kind}"
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{kind}").schema)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (bucket) {layout} LOCATION '{path}/{kind}'")
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    analyzer = Analyzer(meta["language"], tuple(meta["separators"]), tuple(meta["symbols"]))
    return TermIndex(spark.table(f"{name}_postings"), spark.table(f"{name}_terms"), meta["buckets"], analyzer, tuple(meta["fields"]),
                     meta["n_docs"], meta["shards"])
