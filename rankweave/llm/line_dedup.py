"""Line deduplication by pairwise alignment.

Documents that share a block of enough words are found by runs: for each line the
shortest run of lines that starts there and has enough words, and the shortest that
ends there. Every common block is covered by such runs, and both documents have the
same. A run on few documents links each of them with every earlier one. A frequent run
links each with the earliest only, so links grow with occurrences and not with their
square, and it is deleted from every later holder, whether or not the alignment finds
it: as another document has it already, no shared frequent run remains.

Each pair is aligned by patience diff on the line hashes: equal heads and tails are
matched, then lines that are unique on both sides, in their longest common order, and
so on between these. What the later document has in a common block of enough words is
deleted from it.

Only hashes of lines travel to the pairs; a text moves once, when what is left of it
is put together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import arrow_schema, whole
from rankweave.session import written

#: A run on at most this many documents is rare; a block of fewer words is kept.
RARE, MIN_WORDS = 4, 10
SALTS = 32
CUTS = "id long, proof long, cut array<int>"
RUNS = "id long, proof long, runs array<long>"


def lines_of(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def flat_lines(text: Column) -> Column:
    """The lines of a text with their white space evened out."""
    return F.transform(F.split(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), "\n", -1), F.trim)


def line_hash(flat: Column) -> Column:
    """Of an evened-out line; blank lines have null."""
    return F.when(flat != "", F.xxhash64(flat))


def line_words(flat: Column) -> Column:
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1)


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, sorted by the first, that rises in the second."""
    tops, ends, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[k] = ends[at - 1] if at else -1
        tops[at:at + 1] = [j]
        ends[at:at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two lists of line hashes, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, x, j, y = todo.pop()
        while i < x and j < y and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < x and j < y and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
            out.append((x, y))
        if i == x or j == y:
            continue
        in_a, in_b = Counter(a[i:x]), Counter(b[j:y])
        at = {h: k for k, h in enumerate(b[j:y], j) if h is not None and in_b[h] == 1 and in_a[h] == 1}
        chain = longest_rising([(k, at[h]) for k, h in enumerate(a[i:x], i) if h in at])
        for p, q in chain:
            todo.append((i, p, j, q))
            out.append((p, q))
            i, j = p + 1, q + 1
        if chain:
            todo.append((i, x, j, y))
    return sorted(out)


def cut_lines(earlier: list, later: list, words: list[int], min_words: int) -> list[int]:
    """Positions of the later document in common blocks of at least `min_words` words."""
    out, block, last = [], [], None
    for i, j in [*patience(earlier, later), (-1, -1)]:
        if block and (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= min_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def runs(hashes: list, words: list[int], min_words: int) -> set[tuple[int, int, int]]:
    """(hash, first, last) of the shortest runs of lines of at least `min_words` words, from each line on and up to each line.

    The lines of a block of that many words are all in runs that lie in the block.
    """
    out: set[tuple[int, int, int]] = set()
    if min_words <= 0:
        return {(h, k, k) for k, h in enumerate(hashes) if h is not None}
    total, first, before = 0, 0, -1
    for last, w in enumerate(words):
        total += w
        if not w or total < min_words:
            continue
        while total >= min_words:
            # The run from `before` ended at an earlier line; it counts again only as the shortest up to this one.
            if words[first] and (first != before or total - words[first] < min_words):
                out.add((hashes[first] if first == last else hash(tuple(hashes[first:last + 1])), first, last))
            total -= words[first]
            first += 1
        first -= 1
        total += words[first]
        before = first
    return out


def covered(earlier: list, later: list, words: list[int], min_words: int, shared: set[int]) -> list[int]:
    """Positions of the later document in shared runs, and blank lines between them that the earlier has there too."""
    found: set[int] = set()
    for h, first, last in runs(later, words, min_words):
        if h in shared:
            found.update(range(first, last + 1))
    gaps = list(blanks_of(later))
    if gaps and any(p in found and q in found and p + 1 not in found for p, q in gaps):
        known = {(earlier[p], q - p, earlier[q]) for p, q in blanks_of(earlier)}
        for p, q in gaps:
            if p in found and q in found and (later[p], q - p, later[q]) in known:
                found.update(range(p, q))
    return sorted(found)


def blanks_of(hashes: list) -> Iterator[tuple[int, int]]:
    """The lines before and after each gap of blank lines."""
    last = None
    for k, h in enumerate(hashes):
        if h is not None:
            if last is not None and k > last + 1:
                yield last, k
            last = k


def run_hashes(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(RUNS)
        for batch in batches:
            own, proof, hashes, words = (c.to_pylist() for c in batch.columns)
            found = [list({h for h, _, _ in runs(x, w, min_words)}) for x, w in zip(hashes, words)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((own, proof, found), schema)], schema=schema)

    return run


def align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(CUTS)
        for batch in batches:
            own, proof, earlier, later, words, frequent = (c.to_pylist() for c in batch.columns)
            cuts = [cut_lines(a, b, w, min_words) + (covered(a, b, w, min_words, set(f)) if f else [])
                    for a, b, w, f in zip(earlier, later, words, frequent)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((own, proof, cuts), schema)], schema=schema)

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, text (what is left), n_lines, removed_lines, removed_words.

    The earlier of two documents is the one with the smaller id (nulls last), then the
    smaller hash of the text. Rows equal in id and text are one document: nothing is
    deleted between them and all get the same result. A run of lines on more than `rare`
    documents (and more than RARE) is deleted from all but the earliest, in whatever order
    they have it; with a smaller `rare`, runs on up to RARE documents are only aligned with
    the earliest holder. Null text is empty. Blank lines
    never link documents; they go with a block that matches on both sides of them. A
    deleted line goes with its line break. Other columns are not read.
    """
    text = whole(F.col(text_col))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("proof"), text.alias("text"))
    lines = lines_of(F.col("text"))
    flat = own.select("id", "proof", flat_lines(F.col("text")).alias("flat"))
    seqs = written(flat.select("id", "proof", F.transform("flat", line_hash).alias("hashes"),
                               F.transform("flat", line_words).alias("words")).dropDuplicates(["id", "proof"]), "lines")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "proof").alias("key")
    held = seqs.mapInArrow(run_hashes(min_words), RUNS).select(key, F.explode("runs").alias("h"))
    # In two steps, the first salted: a very common run is summed up by many tasks.
    salted = held.groupBy("h", F.pmod(F.xxhash64("key.id"), F.lit(SALTS)).alias("salt")).agg(
        F.count("*").alias("n"), F.min("key").alias("first"))
    shared = salted.groupBy("h").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter("n > 1")
    shared = written(shared, "shared-runs")  # so that the join below is one of two tables, whose hot keys Spark splits
    found = held.join(shared, "h")
    few = found.filter(F.col("n") <= rare)
    others = few.select("h", F.col("key").alias("first"))
    pairs = found.filter("n > %d and key != first" % rare).select("key", "first", F.when(F.col("n") > max(rare, RARE), F.col("h")).alias("h")).union(
        few.drop("first").join(others, "h").filter("first < key").select("key", "first", F.lit(None).cast("long").alias("h")).distinct())
    pairs = pairs.groupBy("key", "first").agg(F.collect_list("h").alias("frequent"))
    left = seqs.select(key, F.col("hashes").alias("later"), "words")
    right = seqs.select(key.alias("first"), F.col("hashes").alias("earlier"))
    pairs = pairs.join(right, "first").join(left, "key").select("key.id", "key.proof", "earlier", "later", "words", "frequent")
    cuts = pairs.mapInArrow(align(min_words), CUTS).filter("size(cut) > 0")
    cuts = cuts.groupBy("id", "proof").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))
    cuts = cuts.withColumnsRenamed({"id": "_id", "proof": "_proof"})
    out = own.join(cuts, own["id"].eqNullSafe(cuts["_id"]) & (own["proof"] == cuts["_proof"]), "left")
    kept = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(
        F.filter(lines, lambda _, i: ~F.array_contains("cut", i)), "\n"))
    gone = F.transform(F.coalesce("cut", F.array().cast("array<int>")), lambda i: line_words(F.get(flat_lines(F.get(lines, i)), 0)))
    return out.select(
        F.col("id").alias(id_col), kept.alias("text"), F.size(lines).alias("n_lines"),
        F.size(gone).alias("removed_lines"), F.aggregate(gone, F.lit(0), lambda s, x: s + x).alias("removed_words"))
