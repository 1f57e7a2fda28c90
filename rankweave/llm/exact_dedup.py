"""Exact deduplication by a tree merge of sorted digest runs.

Every row is hashed once. Rows fall into runs by a hash of their id, so that a
group of copies, however large, leaves at most one entry per run. Runs are
then merged in rounds: in round r the runs whose numbers differ only in their
r-th digit exchange entries, each partner keeping the slice of digests that
carries its own digit. Every level merges the sorted entries it receives; equal
digests collapse to one entry with the smallest id and the sum of the copies.
After the last round the slices are disjoint and complete. No level sees more
than `fan_in` entries per digest and run, and no task sees all of anything.

Equality is never taken from the digest alone: an entry also carries a second,
independent hash of the text, and only entries that agree in both are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import SPACE, arrow_schema, chosen_rows, partitions, whole
from rankweave.session import written

ENTRY = "place int, digest binary, proof long, keep_id long, copies long"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null reads as empty."""
    return F.regexp_replace(whole(text), SPACE, " ")


def digests(text: Column) -> tuple[Column, Column]:
    flat = normalised(text)
    return F.unhex(F.sha2(flat, 256)).alias("digest"), F.xxhash64(flat).alias("proof")


def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge entries sorted by (place, digest, proof, id): the first of equal ones holds the smallest id."""
    schema, held = arrow_schema(ENTRY), None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch]).cast(schema).combine_chunks()
        if held is not None:
            part = pa.concat_tables([held, part]).combine_chunks()
        place, proof, copies = (part.column(c).to_numpy() for c in ("place", "proof", "copies"))
        digest = np.frombuffer(b"".join(part.column("digest").to_pylist()), dtype=">u8").reshape(-1, 4)
        new = np.r_[True, (np.diff(place) != 0) | (np.diff(proof) != 0) | (digest[1:] != digest[:-1]).any(axis=1)]
        starts = np.flatnonzero(new)
        merged = part.take(pa.array(starts)).set_column(4, "copies", pa.array(np.add.reduceat(copies, starts)))
        held = merged.slice(len(starts) - 1)
        yield from merged.slice(0, len(starts) - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def tree_merge(runs: DataFrame, run_count: int, fan_in: int, rounds: int) -> DataFrame:
    """runs(run, digest, proof, keep_id, copies) -> one entry per different text."""
    n, leading = partitions(runs), F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    piece = (leading * run_count / F.lit(2**32)).cast("int")
    entries = runs.withColumn("place", F.col("run").cast("int"))
    for r in range(1, rounds + 1):
        width = fan_in ** (rounds - r)
        place = (F.floor(piece / F.lit(width)) * width + F.col("run") % width).cast("int")
        entries = (
            entries.withColumn("place", place)
            .repartition(n, "place")
            .sortWithinPartitions("place", "digest", "proof", F.col("keep_id").asc_nulls_last())
        )
        merged = entries.select("place", "digest", "proof", "keep_id", "copies").mapInArrow(merge_sorted, ENTRY)
        entries = merged.withColumn("run", F.col("place") % max(width, 1))
    return entries.select("digest", "proof", "keep_id", F.col("copies").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. A null id is larger than any other: it stays
    only in a group without other ids. Of rows equal in id and text one stays.
    Other columns of the input are not read. An empty input gives no rows.
    """
    rounds, n = 1, partitions(docs)
    while fan_in**rounds < 4 * n:
        rounds += 1
    run_count = fan_in**rounds
    digest, proof = digests(F.col(text_col))
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), digest, proof)
        .groupBy("doc_id", "digest", "proof").agg(F.count("*").alias("repeats")), "digests")
    run = F.pmod(F.xxhash64("doc_id"), F.lit(run_count)).cast("int")
    rows = rows.withColumn("run", run)
    runs = rows.groupBy("run", "digest", "proof").agg(
        F.min("doc_id").alias("keep_id"), F.sum("repeats").alias("copies"))
    best = tree_merge(runs, run_count, fan_in, rounds)
    # Back down the tree: first to the runs, then to the rows of each run.
    at_runs = runs.select("run", "digest", "proof").join(best, ["digest", "proof"])
    out = rows.join(at_runs, ["run", "digest", "proof"])
    first = F.posexplode(F.array_repeat(F.lit(True), F.col("repeats").cast("int"))).alias("_n", "_one")
    return out.select("*", first).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == 0)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    kept = exact_groups(docs.select(id_col, text_col), id_col, text_col).filter("kept")
    kept = kept.select("doc_id", F.unhex("text_sha256").alias("digest"))
    return chosen_rows(docs, id_col, digests(F.col(text_col))[0], kept, "doc_id", "digest")
