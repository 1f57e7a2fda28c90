"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words: after A-Z is lower-cased, the runs of ASCII digits, a-z and characters
beyond ASCII. Every benchmark item gives its windows of `size` consecutive words;
an item of fewer words, but at least one, is a single window. A window occurs in
a document where its words stand in that order, one after the other; every word
of every occurrence is hit.

Method. The words of all windows are ordered by rarity: by how often they stand
in the documents, ties by the word itself. Containment of a whole window needs
each of its words, so its rarest word alone is a necessary prefix: document
words are joined with these prefix words only, each match fixes where the window
would start, the length and position bounds drop starts before the text or ends
after it, and the candidates left are verified by comparing the document's
words there with the window's words, whole, inside the same join.

All of it runs as Spark SQL expressions and joins (no Python worker). The
windows are broadcast in blocks of a checked number of rows; the document words
are computed once and written as a table that the later passes read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.session import MAX_BROADCAST_ROWS, broadcast_if_small, written

# Fixed values of the contract: the word pattern and the window length.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """window (array of words) -> items (array of item ids as text), one row per distinct window."""
    w = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w"))
    w = w.withColumn("m", F.size("w")).filter("m > 0")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("m") - size, F.lit(0)))).alias("s")
    w = w.select("item", "w", "m", starts).select("item", F.slice("w", F.col("s") + 1, F.least("m", F.lit(size))).alias("window"))
    return w.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def prefixes(windows: DataFrame, doc_words: DataFrame) -> DataFrame:
    """Each window with its rarest word (`word`), that word's first place in it (`k`) and its length (`l`)."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    counts = (doc_words.select(F.explode("words").alias("word"))
              .join(broadcast_if_small(vocabulary), "word", "left_semi")
              .groupBy("word").agg(F.count("*").alias("places")))
    placed = windows.select("window", "items", F.posexplode("window").alias("k", "word"))
    placed = placed.join(counts, "word", "left").fillna(0, ["places"])
    rarest = F.min(F.struct("places", "word", "k")).alias("best")
    return placed.groupBy("window", "items").agg(rarest).select(
        "window", "items", "best.word", "best.k", F.size("window").alias("l"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the document's words inside any occurrence of a window; n_items
    the items with an occurring window; items_sha256 is the SHA-256 (lowercase hex)
    of their ids, sorted as text and joined by commas (none: of the empty text).
    Null text has no words; a null item id is the empty text; items without
    words have no window. Repeated rows and rows sharing an id each get their
    own row; null ids stay null. Other columns of the inputs are not read, so
    their names do not matter. Empty inputs give no rows, or rows without hits.
    """
    doc_words = written(docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("words")),
        "decontaminate-words")
    windows = item_windows(items, item_col, item_text_col, size)
    prefix = written(prefixes(windows, doc_words), "decontaminate-prefixes")
    # The windows go out in broadcast blocks of a checked number of rows; each block
    # meets the words where they are read, and the comparison runs in the same
    # generated code as the explode, so a text is never copied per word.
    blocks = max(1, -(-prefix.count() // MAX_BROADCAST_ROWS))
    places = doc_words.select("row", "words", F.posexplode("words").alias("p", "word"))
    start = F.col("p") - F.col("k")
    inside = (start >= 0) & (start + F.col("l") <= F.size("words"))
    same = F.when(inside, F.slice("words", start + 1, F.col("l")) == F.col("window")).otherwise(F.lit(False))
    found = None
    for block in range(blocks):
        part = prefix.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).withColumnRenamed("word", "w")
        hits = places.join(F.broadcast(part), (F.col("word") == F.col("w")) & same).select("row", start.alias("start"), "l", "items")
        found = hits if found is None else found.unionByName(hits)
    found = written(found, "decontaminate-found")
    # Words hit: the union of [start, start + l) per row, by a sweep in start order.
    spans = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("l")).alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    hit = spans.select("row", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = found.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(
        F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256"))
    out = doc_words.select("row", "doc_id", F.size("words").cast("long").alias("n_words"))
    out = out.join(hit, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.col("n_items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.col("items_sha256"), F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
