"""A term index that grows with its corpus: immutable segments, a delete set, statistics that merge.

Every `add` writes one segment, numbered by a generation: its postings (as the
term index lays them out, partitioned by term bucket), its documents with their
lengths, and its document frequencies. Nothing written is changed again.
Rows that replace or delete documents go to the delete set with the generation
of the operation; a delete hides a document in the segments older than itself
only, so a document added again later stays.

Statistics merge: the live document frequency of a term is the sum over the
segments less what the hidden documents held, and the number of documents and
their mean length come from the small document tables. The index is thus never
rebuilt for a change; `merge` rewrites segments of one size tier into one
(dropping hidden rows) when `fan_in` of them have gathered, so that segments
stay few, about log(corpus) of them.

`term_index` gives the live index the form that lexical search reads, so the
same BM25, keyword and phrase operators answer from it.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import Analyzer
from rankweave.plans.index import BUCKETS, TermIndex, bucket_of, measured, postings_of, shards_for
from rankweave.session import MAX_BROADCAST_ROWS, broadcast_if_small, holds_at_most, workspace, written
from rankweave.sources.corpus_store import newest

FAN_IN = 4
LENGTHS = -1  # the partition of a segment's postings where lengths lie until they have their own table


@dataclass(frozen=True)
class Segments:
    spark: SparkSession
    path: str
    fields: dict[str, str]          # field name -> corpus column
    analyzer: Analyzer
    segments: tuple[tuple[int, int, str], ...]   # (generation, documents, folder), oldest first
    buckets: int = BUCKETS
    clock: int = 0                          # the newest generation given to a segment or a delete

    def grown(self, segments, clock: int | None = None) -> Segments:
        return Segments(self.spark, self.path, self.fields, self.analyzer, tuple(segments), self.buckets,
                        self.clock if clock is None else clock)

    def part(self, segment: tuple, kind: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{segment[2]}/{kind}")
        return rows.filter(F.col("bucket") != LENGTHS) if kind == "postings" else rows

    def deletes(self) -> DataFrame:
        """doc_id, generation of every replace or delete so far."""
        try:
            return self.spark.read.parquet(f"{self.path}/deletes")
        except AnalysisException:
            return self.spark.createDataFrame([], "doc_id long, generation int")

    def hidden(self, segment: tuple) -> DataFrame | None:
        """Ids of the segment that younger deletes hide, written once; None if there are none.

        Deletes hold the ids of every younger add too, mostly of documents that this segment never had.
        """
        younger = self.deletes().filter(F.col("generation") > segment[0]).select("doc_id").distinct()
        ids = written(self.part(segment, "docs").select("doc_id").join(younger, "doc_id", "left_semi").distinct(), "hidden")
        return broadcast_if_small(ids) if ids.limit(1).count() else None

    def live(self, segment: tuple, kind: str, hidden: DataFrame | None) -> DataFrame:
        rows = self.part(segment, kind)
        return rows if hidden is None else rows.join(hidden, "doc_id", "left_anti")


def create(spark: SparkSession, fields: dict[str, str], analyzer: Analyzer = Analyzer(), path: str | None = None,
           buckets: int = BUCKETS) -> Segments:
    """An empty index at a free path."""
    path = path or f"{workspace(spark)}/segments-{uuid.uuid4().hex}"
    index = Segments(spark, path, dict(fields), analyzer, (), buckets)
    _save(index)
    return index


def _save(index: Segments) -> None:
    """A new manifest version: (generation, documents, folder) of the segments, with the settings."""
    manifest = {"fields": index.fields, "language": index.analyzer.language, "separators": list(index.analyzer.separators),
                "symbols": list(index.analyzer.symbols), "buckets": index.buckets, "segments": [list(s) for s in index.segments], "clock": index.clock}
    version = index.clock
    rows = index.spark.createDataFrame([(version, uuid.uuid4().hex, json.dumps(manifest))], "version int, tag string, manifest string")
    rows.write.mode("append").parquet(f"{index.path}/manifest")


def open_segments(spark: SparkSession, path: str) -> Segments:
    """The index by its newest manifest."""
    rows = spark.read.parquet(f"{path}/manifest").orderBy(F.col("version").desc(), F.col("tag")).head()
    m = json.loads(rows["manifest"])
    analyzer = Analyzer(m["language"], tuple(m["separators"]), tuple(m["symbols"]))
    return Segments(spark, path, m["fields"], analyzer, tuple(map(tuple, m["segments"])), m["buckets"], m["clock"])


def _write_segment(index: Segments, folder: str, docs: DataFrame) -> int:
    """Postings, document lengths and document frequencies of `docs` (unique doc_id) in a new folder.

    The texts are read once: lengths come with the postings, and move to their own small table.
    """
    place = f"{index.path}/{folder}"
    fields = {name: F.col(column) for name, column in index.fields.items()}
    bucket = F.when(F.col("term").isNull(), LENGTHS).otherwise(bucket_of(F.col("term"), index.buckets))
    rows = postings_of(docs, fields, index.analyzer, with_lengths=True).withColumn("bucket", bucket)
    rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{place}/postings")
    rows = index.spark.read.schema(rows.schema).parquet(f"{place}/postings")
    rows.filter(F.col("bucket") == LENGTHS).select("field", "doc_id", "doc_len").write.parquet(f"{place}/docs")
    terms = rows.filter(F.col("bucket") != LENGTHS).groupBy("bucket", "field", "term").agg(F.count(F.lit(1)).alias("df"))
    terms.write.parquet(f"{place}/df")
    return index.spark.read.parquet(f"{place}/docs").select("doc_id").distinct().count()


def _placed(batch: DataFrame, order: Column, shards: int) -> DataFrame:
    """The newest row of each id, placed by id in shards of one size: the texts are shuffled once.

    Few ids come twice; only the texts of these are grouped.
    """
    ids = batch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    repeated = written(ids, "repeated")
    if not repeated.limit(1).count():
        return batch.repartition(shards, "doc_id")
    if not holds_at_most(repeated, MAX_BROADCAST_ROWS):
        return newest(batch.repartition(shards, "doc_id"), "doc_id", order)
    again = F.broadcast(repeated)
    once = batch.join(again, "doc_id", "left_anti")
    return once.unionByName(newest(batch.join(again, "doc_id", "left_semi"), "doc_id", order)).repartition(shards, "doc_id")


def add(index: Segments, batch: DataFrame, order: str | None = None) -> Segments:
    """Add documents (doc_id, the field columns); a doc_id met before is replaced.

    Of equal ids in the batch the row with the largest `order` stays (without
    one, the largest by value). Rows without an id are not indexed; a batch
    without rows changes nothing.
    """
    columns = ["doc_id", *sorted(set(index.fields.values()))]
    batch = batch.filter(F.col("doc_id").isNotNull())
    key = F.col(order) if order else F.struct(*columns[1:])
    rows, text_bytes = measured(batch, {name: F.col(column) for name, column in index.fields.items()})
    if not rows:
        return index
    batch = batch.select(*columns, *([order] if order and order not in columns else []))
    docs = _placed(batch, key, shards_for(text_bytes)).select(*columns)
    generation = index.clock + 1
    folder = f"segment-{generation}-{uuid.uuid4().hex[:8]}"
    count = _write_segment(index, folder, docs)
    ids = index.spark.read.parquet(f"{index.path}/{folder}/docs").select("doc_id").distinct()
    ids.withColumn("generation", F.lit(generation)).write.mode("append").partitionBy("generation").parquet(f"{index.path}/deletes")
    grown = index.grown((*index.segments, (generation, count, folder)), generation)
    _save(grown)
    return merge(grown)


def delete(index: Segments, ids: DataFrame) -> Segments:
    """Hide the documents of these ids (a column doc_id) in all segments so far."""
    generation = index.clock + 1
    ids.select(F.col("doc_id").cast("long")).filter(F.col("doc_id").isNotNull()).distinct().withColumn(
        "generation", F.lit(generation)).write.mode("append").partitionBy("generation").parquet(f"{index.path}/deletes")
    grown = index.grown(index.segments, generation)
    _save(grown)
    return grown


def tier(documents: int, fan_in: int) -> int:
    return 0 if documents < fan_in else int(math.log(documents, fan_in))


def merge(index: Segments, fan_in: int = FAN_IN) -> Segments:
    """Rewrite every `fan_in` segments of one size tier, oldest first, into one; hidden rows go."""
    segments = list(index.segments)
    while True:
        tiers: dict[int, list] = {}
        for s in segments:
            tiers.setdefault(tier(s[1], fan_in), []).append(s)
        full = next((group[:fan_in] for group in tiers.values() if len(group) >= fan_in), None)
        if full is None:
            break
        # Merged segments must be neighbours in age, so that no delete falls between them and a younger one.
        first, last = segments.index(full[0]), segments.index(full[-1])
        group = segments[first:last + 1]
        generation = max(g for g, _, _ in group)
        folder = f"segment-{generation}-{uuid.uuid4().hex[:8]}"
        place = f"{index.path}/{folder}"
        hidden = [index.hidden(segment) for segment in group]
        for kind in ("postings", "docs"):
            union = reduce(DataFrame.unionByName, [index.live(segment, kind, ids) for segment, ids in zip(group, hidden)])
            writer = union.write.partitionBy("bucket") if kind == "postings" else union.write
            writer.parquet(f"{place}/{kind}")
        postings = index.spark.read.parquet(f"{place}/postings")
        postings.groupBy("bucket", "field", "term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{place}/df")
        count = index.spark.read.parquet(f"{place}/docs").select("doc_id").distinct().count()
        # The merged segment takes the place and generation of the newest merged one; files are never moved.
        segments = [*segments[:first], (generation, count, folder), *segments[last + 1:]]
    merged = index.grown(segments)
    if merged.segments != index.segments:
        _save(merged)
    return merged


def term_index(index: Segments) -> TermIndex:
    """The live index in the form lexical search reads: postings less hidden rows, merged statistics."""
    spark = index.spark
    if not index.segments:
        raise ValueError("the index has no segment yet")
    hidden = [index.hidden(segment) for segment in index.segments]
    parts = list(zip(index.segments, hidden))
    postings = reduce(DataFrame.unionByName, [index.live(segment, "postings", ids) for segment, ids in parts])
    docs = reduce(DataFrame.unionByName, [index.live(segment, "docs", ids) for segment, ids in parts])
    n_docs = docs.select("doc_id").distinct().count()
    lengths = docs.groupBy("field").agg(F.lit(n_docs).cast("long").alias("n_docs"), (F.sum("doc_len") / F.lit(max(n_docs, 1))).alias("avg_len"))
    # df: the segments' sums less the postings of hidden documents, by term.
    change = reduce(DataFrame.unionByName, [index.part(segment, "df") for segment in index.segments])
    for segment, ids in parts:
        if ids is not None:
            gone = index.part(segment, "postings").join(ids, "doc_id", "left_semi").select("bucket", "field", "term")
            change = change.unionByName(gone.withColumn("df", F.lit(-1).cast("long")))
    df = change.groupBy("bucket", "field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    terms = df.join(F.broadcast(lengths), "field")
    return TermIndex(postings, terms, index.buckets, index.analyzer, tuple(index.fields))
