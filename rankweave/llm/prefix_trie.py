"""Prefix trie of conversations by a minimal-perfect-hash node table.

A node is a distinct sequence of first turns (role, text); the root is the empty
sequence. Every prefix gets a digest: two running sums, over its turns, of
hashes of (place, role, text), so that one window pass gives all digests of a
conversation. Prefixes are nodes keyed by (depth, digest).

Method. The trie is cut into shards: nodes with more members than `hot` are
upper nodes, all others belong to the subtree of the first node on their path
that is not upper. Shards are dealt to buckets; in each bucket the distinct
digests are enumerated and get slots 0..k-1 (their rank: a minimal perfect hash
of the bucket's keys), verified against collisions (one parent and one turn per
slot), counts are scattered into flat numpy arrays, and subtree sums are added
up through the parent-slot array in depth order, deepest first. The upper nodes,
whose number is bounded by `max_upper` (as `hot` grows with the rows), get the
same treatment in one small table, with the subtrees of the shards below them.
The conversations that end at a node are hashed in id order from segments that
a range-partitioned sort cuts, so that no task sorts or holds a hot node whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import arrow_schema, partitions
from rankweave.session import written

#: Fixed values of the contract: turns taken from the conversation c - c % GROUP, their number crc32(c) % BORROW.
GROUP, BORROW = 5, 9
#: Nodes with more members than this are upper nodes at least.
HOT_MIN = 20_000
#: Most upper nodes; `hot` grows with the number of prefix rows to keep them below it.
MAX_UPPER = 200_000
#: Prefix rows a bucket of shards holds, on average.
BUCKET_ROWS = 500_000
#: Ids in a segment of conversations that end at one node.
SEGMENT = 256
MASK = (1 << 40) - 1

KEY = ["d", "a", "b"]
NODE = ("d int, a long, b long, pd int, pa long, pb long, conv_id long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long")


def rebuilt(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversation ids (c), and c, part, k, role, text: the rebuilt turns of every conversation id (turnless ones have none)."""
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("k", F.row_number().over(order) - 1).drop("turn")
    convs = rows.select("c").distinct().select(
        "c", F.pmod(F.crc32(F.col("c").cast("string")), F.lit(BORROW)).alias("h"), (F.col("c") - F.col("c") % GROUP).alias("base"))
    own = rows.join(convs.select("c", "h"), "c").filter(F.col("k") >= F.col("h")).select("c", F.lit(1).alias("part"), "k", "role", "text")
    lent = rows.filter(F.col("k") < BORROW - 1).withColumnRenamed("c", "base")
    borrowed = convs.join(lent, "base").filter(F.col("k") < F.col("h")).select("c", F.lit(0).alias("part"), "k", "role", "text")
    turns = own.unionByName(borrowed)
    return convs.select("c"), turns


def prefix_rows(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation and depth 0..L: c, d, a, b (digest), pd, pa, pb (parent), tv, nbytes, end."""
    place = Window.partitionBy("c").orderBy("part", "k")
    turns = turns.select("c", F.row_number().over(place).alias("d"), "role", "text")
    roots = convs.select("c", F.lit(0).alias("d"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = turns.unionByName(roots)
    path = Window.partitionBy("c").orderBy("d")
    upto = path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lambda tag: F.when(F.col("d") == 0, F.lit(0)).otherwise(
        F.xxhash64(F.lit(tag), "d", "role", "text").bitwiseAND(F.lit(MASK)))
    rows = rows.select("c", "d", F.sum(first("a")).over(upto).alias("a"), F.sum(first("b")).over(upto).alias("b"),
                       F.when(F.col("d") == 0, F.lit(0)).otherwise(F.xxhash64("role", "text")).alias("tv"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("nbytes"),
                       (F.col("d") == F.max("d").over(Window.partitionBy("c"))).alias("end"))
    return rows.select("*", (F.col("d") - 1).alias("pd"), F.coalesce(F.lag("a").over(path), F.lit(-1)).alias("pa"),
                       F.coalesce(F.lag("b").over(path), F.lit(-1)).alias("pb"))


def slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (sorted rows) and each row's slot: its key's rank among them."""
    distinct, slot = np.unique(keys, axis=0, return_inverse=True)
    return distinct, slot.reshape(-1)


def node_table(rows: pd.DataFrame, outside: dict | None = None) -> pd.DataFrame:
    """Nodes of the prefix rows (columns of `prefix_rows`), with subtree sums in depth order.

    A column `n` gives the members a row stands for (1 without it). `outside` adds to a node's children and subtree what lies beyond these rows:
    key -> (children, leaves, saved). A parent that is not among the rows keeps
    parent_conv_id null.
    """
    keys = rows[KEY].to_numpy(np.int64)
    distinct, slot = slots(keys)
    k = len(distinct)
    # Collision check: every slot has one parent and one last turn.
    told = np.unique(np.c_[slot, rows[["pd", "pa", "pb", "tv"]].to_numpy(np.int64)], axis=0)
    if len(told) != k:
        raise RuntimeError("two prefixes share a digest; widen the digest")
    first = np.unique(slot, return_index=True)[1]
    parent_keys = rows[["pd", "pa", "pb"]].to_numpy(np.int64)[first]
    at = np.searchsorted(distinct.view([("", np.int64)] * 3).reshape(-1), parent_keys.copy().view([("", np.int64)] * 3).reshape(-1))
    at = np.minimum(at, k - 1)
    parent = np.where((distinct[at] == parent_keys).all(axis=1), at, -1)
    weight = rows["n"].to_numpy(np.int64) if "n" in rows else np.ones(len(rows), np.int64)
    n_convs = np.bincount(slot, weights=weight, minlength=k).astype(np.int64)
    conv_id = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(conv_id, slot, rows["c"].to_numpy(np.int64))
    nbytes = rows["nbytes"].to_numpy(np.int64)[first]
    inside = parent >= 0
    children = np.bincount(parent[inside], minlength=k).astype(np.int64)
    leaves, saved = np.zeros(k, np.int64), (n_convs - 1) * nbytes
    if outside:
        for i, key in enumerate(map(tuple, distinct.tolist())):
            extra = outside.get(key)
            if extra:
                children[i] += extra[0]
                leaves[i] += extra[1]
                saved[i] += extra[2]
    leaves += children == 0
    depth = distinct[:, 0]
    for d in np.unique(depth)[::-1]:
        level = np.flatnonzero((depth == d) & inside)
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    parent_conv = np.where(inside, conv_id[np.maximum(parent, 0)], -1)
    return pd.DataFrame({
        "d": depth.astype(np.int32), "a": distinct[:, 1], "b": distinct[:, 2], "pd": parent_keys[:, 0].astype(np.int32),
        "pa": parent_keys[:, 1], "pb": parent_keys[:, 2], "conv_id": conv_id, "parent_conv_id": pd.Series(parent_conv, dtype="Int64").mask(~inside), "n_convs": n_convs.astype(np.int64),
        "n_children": children, "n_leaves": leaves, "saved_tokens": saved})


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (d, a, b, c) -> per node and run of at most SEGMENT ids: first id, ids joined by commas."""
    out = arrow_schema("d int, a long, b long, first long, ids string")
    held: list = []
    for batch in batches:
        df = batch.to_pandas()
        if not len(df):
            continue
        key = df[KEY].to_numpy(np.int64)
        cut = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
        run = np.cumsum(cut) - 1
        place = np.arange(len(df)) - np.flatnonzero(cut)[run]
        group = np.r_[True, cut[1:] | (place[1:] % SEGMENT == 0)]
        starts = np.flatnonzero(group)
        ids = df["c"].astype(str).to_numpy()
        texts = [",".join(ids[s:e]) for s, e in zip(starts, [*starts[1:], len(df)])]
        held.append(pd.DataFrame({"d": df["d"].to_numpy()[starts], "a": key[starts, 1], "b": key[starts, 2],
                                  "first": df["c"].to_numpy()[starts], "ids": texts}))
        if sum(map(len, held)) >= 4096:
            yield pa.RecordBatch.from_pandas(pd.concat(held), schema=out, preserve_index=False)
            held = []
    if held:
        yield pa.RecordBatch.from_pandas(pd.concat(held), schema=out, preserve_index=False)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by (d, a, b, first) -> one SHA-256 per node of its ids in order."""
    out = arrow_schema("d int, a long, b long, ends_sha256 string")
    key, digest, done = None, None, []
    for batch in batches:
        cols = batch.to_pydict()
        for d, a, b, ids in zip(cols["d"], cols["a"], cols["b"], cols["ids"]):
            if (d, a, b) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (d, a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(done) >= 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "a", "b", "ends_sha256"), r)) for r in done], schema=out)
            done = []
    if key is not None:
        done.append((*key, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(("d", "a", "b", "ends_sha256"), r)) for r in done], schema=out)


def ends_digests(rows: DataFrame) -> DataFrame:
    """(d, a, b) -> SHA-256 of the ids of conversations that end there, ascending, comma-joined."""
    n = partitions(rows)
    ends = rows.filter("end").select(*KEY, "c").repartitionByRange(n, *KEY, "c").sortWithinPartitions(*KEY, "c")
    cut = ends.mapInArrow(segments, "d int, a long, b long, first long, ids string")
    return cut.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "d int, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", hot_min: int = HOT_MIN, max_upper: int = MAX_UPPER) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first; ties by role, then text); null role
    or text is empty. Conversation c borrows the first crc32(c) % 9 turns of
    conversation c - c % 5 (truncated remainder; all if fewer, none if absent),
    then keeps its own turns after as many. Rows with a null conv_id name no
    conversation and are left out; repeated rows are separate turns. An input
    without conversations gives no rows; other columns are not read.
    """
    spark = conversations.sparkSession
    convs, turns = rebuilt(conversations, id_col, turn_col, role_col, text_col)
    rows = written(prefix_rows(convs, turns), "trie-rows")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                         "n_leaves long, saved_tokens long, ends_sha256 string")
    hot = max(hot_min, -(-total // max_upper))
    # At most total / hot <= max_upper nodes have more than `hot` rows: a proven bound for the broadcast.
    upper_keys = rows.groupBy(*KEY).count().filter((F.col("count") > hot) | (F.col("d") == 0)).select(*KEY, F.lit(True).alias("upper"))
    flagged = rows.join(F.broadcast(upper_keys), KEY, "left")
    lower = flagged.filter(F.col("upper").isNull()).drop("upper")
    top = F.min(F.struct(*KEY)).over(Window.partitionBy("c"))
    buckets = max(partitions(rows), -(-total // BUCKET_ROWS))
    lower = lower.withColumn("bucket", F.pmod(F.xxhash64(top), F.lit(buckets)))
    columns = ["c", *KEY, "pd", "pa", "pb", "tv", "nbytes"]
    shards = lower.select("bucket", *columns).groupBy("bucket").applyInPandas(lambda df: node_table(df[columns]), NODE)
    shards = written(shards, "trie-shards")

    # Upper nodes: few, aggregated by Spark, summed up in depth order in one table with the shard tops below them.
    upper = flagged.filter("upper").groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("c").alias("c"), F.min("pd").alias("pd"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.min("nbytes").alias("nbytes"), F.min("tv").alias("tv"), F.max("tv").alias("tv_max"),
        F.max("pa").alias("pa_max"), F.max("pb").alias("pb_max"))
    tops = shards.filter(F.col("parent_conv_id").isNull()).groupBy("pd", "pa", "pb").agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    up = upper.collect()
    if any(r["tv"] != r["tv_max"] or r["pa"] != r["pa_max"] or r["pb"] != r["pb_max"] for r in up):
        raise RuntimeError("two prefixes share a digest; widen the digest")
    # Every shard top hangs below an upper node: at most max_upper keys come back.
    below = {(r["pd"], r["pa"], r["pb"]): (r["children"], r["leaves"], r["saved"]) for r in tops.collect()}
    flat = pd.DataFrame([[r[c] for c in ("c", *KEY, "pd", "pa", "pb", "tv", "nbytes", "n")] for r in up],
                        columns=["c", *KEY, "pd", "pa", "pb", "tv", "nbytes", "n"])
    table = node_table(flat, below)
    uppers = spark.createDataFrame(table.astype(object).where(table.notna(), None).values.tolist(), NODE)
    parents = F.broadcast(uppers.select(F.col("d").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                                        F.col("conv_id").alias("upper_parent")))
    lowers = shards.join(parents, ["pd", "pa", "pb"], "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "upper_parent")).drop("upper_parent")
    nodes = lowers.unionByName(uppers).join(ends_digests(rows), KEY, "left")
    return nodes.select(
        "conv_id", F.col("d").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
