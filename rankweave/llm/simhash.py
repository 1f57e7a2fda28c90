"""SimHash near-duplicates by pigeonring filtering.

A fingerprint of 64 bits lies on a ring of four segments of 16 bits. If two
fingerprints differ in at most three bits, the average segment differs in less
than one, and by the pigeonring principle some segment starts a chain whose
running number of differences never exceeds its proportional budget: 0 in the
first segment, at most 1 in the first two, at most 2 in the first three. The
budgets are turned into keys of 32 bits. The first segment is equal. Of the four
bytes of the next two segments at least two are equal: both of the second segment,
or one of it and (having spent a difference there) one of the third. So five keys for each of
four starts find every link, where plain pigeonhole keys would have 16 bits.
Rows that meet under a key are compared in full before anything is linked.

Different fingerprints are linked, not documents: copies meet in one fingerprint
first. Under a key a fingerprint joins the component of its neighbours by a search
that leaves out what it has already reached, so a dense group costs about one comparison
a member and yields fewer links than members. Components of the links come
from alternating star steps, whose tables are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import arrow_schema, chosen_rows, partitions, whole
from rankweave.session import written

SEED, WIDTH, DISTANCE = 42, 3, 3
SEGMENTS, BYTES = 4, 8
#: Equal bytes among the four of the second and third segment of a chain.
EQUAL = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))
BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    """The SimHash of a UTF-8 text: words lower-cased (A-Z), cut at ASCII white space."""
    words = data.lower().split()
    if not words:
        return 0
    k = min(width, len(words))
    text, ends = b" ".join(words), []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts, ends[k - 1:])], dtype=">u8")
    n = len(hashes)
    octets = hashes.view(np.uint8).reshape(n, BYTES)
    if n < 64:
        ones = np.unpackbits(octets, axis=1).sum(axis=0)
    else:
        seen = np.bincount((octets + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(BYTES, 256)
        ones = (seen @ BIT).ravel()
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, proof (a hash of the text), fingerprint (signed long) of every whole text."""
    ddl = "_id long, _proof long, _print long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, width) for t in batch.column(2).to_pylist()]
            signed = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed], schema=arrow_schema(ddl))

    text = whole(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_proof"),
                       text.cast("binary").alias("_text")).mapInArrow(run, ddl).select(
        F.col("_id").alias("doc_id"), F.col("_proof").alias("proof"), F.col("_print").alias("print"))


def chain_keys(prints: DataFrame) -> DataFrame:
    """prints(print) -> key, print: twenty keys, one for each start and each choice of equal bytes."""
    def octet(i: int):
        return F.shiftrightunsigned(F.col("print"), 8 * (BYTES - 1 - i % BYTES)).bitwiseAND(F.lit(255))

    keys = []
    for s in range(SEGMENTS):
        first = 2 * s
        for e, (a, b) in enumerate(EQUAL):
            key = F.lit(s * len(EQUAL) + e).cast("long")
            for i in (first, first + 1, first + 2 + a, first + 2 + b):
                key = F.shiftleft(key, 8).bitwiseOR(octet(i))
            keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("key"), "print")


def spanning_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what lies within `distance` of each other, one less than each component has members."""
    left, links = values, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue[-1]).view(np.uint64)) <= distance
            root = queue.pop()
            found = left[near]
            links += [(int(root), int(x)) for x in found]
            queue += list(found)
            left = left[~near]
    return links


def links_of_keys(distance: int):
    """Links among the rows of each key; rows come sorted by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, key, prints = arrow_schema("a long, b long"), np.array([], np.int64), np.array([], np.int64)

        def link(starts, ends):
            pairs = ends - starts == 2
            a, b = prints[starts[pairs]], prints[starts[pairs] + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
            out = [(a[near], b[near])]
            for s, e in zip(starts[~pairs], ends[~pairs]):
                if found := spanning_links(prints[s:e], distance):
                    out.append(tuple(np.array(found, dtype=np.int64).T))
            a, b = (np.concatenate(c) for c in zip(*out))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy()])
            if not len(key):
                continue
            borders = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            starts, ends = borders[:-2], borders[1:-1]  # the last key may go on
            many = ends - starts > 1
            if many.any():
                yield from link(starts[many], ends[many])
            key, prints = key[borders[-2]:], prints[borders[-2]:]
        if len(key) > 1:
            yield from link(np.array([0]), np.array([len(key)]))

    return run


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root: the smallest node of each component, by large and small star steps."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        small = small.filter("u != v").distinct()
        edges = written(small, "links")  # a cut: the plan does not grow with the rounds
        now = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int) -> DataFrame:
    """doc_id, proof, print, root and component_id of every row; equal roots mean one group."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the keys hold for distances of at most 3")
    prints = written(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    n = partitions(docs)
    keyed = chain_keys(nodes.select("print")).repartition(n, "key").sortWithinPartitions("key")
    roots = components(keyed.mapInArrow(links_of_keys(distance), "a long, b long"))
    of_node = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root"))
    of_root = of_node.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(of_node.join(of_root, "root").select("print", "root", "component_id"), "print")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    A text of fewer words than a shingle is one shingle; null and empty texts, and
    others without words, have fingerprint zero, which is linked like any other.
    Repeated rows each have a row. Null ids are larger than any other. Other columns
    are not read; an empty table gives no rows. `distance` is at most 3.
    """
    return grouped(docs, id_col, text_col, width, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs` that stay, one of each group, with all their columns.

    It is the row with the smallest id; of rows that share the id, the one whose text
    has the smallest hash.
    """
    found = grouped(docs.select(id_col, text_col), id_col, text_col, width, distance)
    best = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min("component_id").alias("doc_id"), F.min("proof").alias("proof"))
    return chosen_rows(docs, id_col, F.xxhash64(whole(F.col(text_col))), best, "doc_id", "proof")
