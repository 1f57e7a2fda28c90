"""URL rules by a sort-merge range join with a stack of active rules.

A host is keyed by its labels in reverse order ("net.example.www."), so a rule
for a host and its subdomains is an interval of keys. Urls are cut into ranges of
the sorted keys; a rule is sent to every range its interval touches. Inside a
range, rules and urls are swept in key order. Intervals of prefixes nest, so a
stack holds exactly the rules of the hosts above the current url; the path rules
of one host are a sorted list in which each knows the next shorter prefix.

A hot host is cut like any other stretch of keys, since path and a hash of the
row's id are part of the key. Borders come from a sample of the keys; they only
decide where a row is judged, never how.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import arrow_schema, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
JUDGED = "_id long, host string, path string, rule string, verdict string"
LAST = "\U0010ffff"
#: Expected keys sampled for each range.
SAMPLED = 40


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Level:
    """The rules of one host, sorted by path; `above` is the next shorter prefix of each."""

    def __init__(self, key: str):
        self.key, self.paths, self.above, self.rules, self.open = key, [], [], [], []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            if verdict == "block":
                self.rules[-1] = (rule, verdict)
            return
        while self.open and not path.startswith(self.paths[self.open[-1]]):
            self.open.pop()
        self.above.append(self.open[-1] if self.open else -1)
        self.open.append(len(self.paths))
        self.paths.append(path)
        self.rules.append((rule, verdict))

    def find(self, path: str) -> tuple[str, str] | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.above[i]
        return self.rules[i] if i >= 0 else None


def sweep(default: str):
    """Judge the urls of one range, rows sorted by (range, key, kind, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, stack, at = arrow_schema(JUDGED), [], None
        for batch in batches:
            out = []
            for here, key, is_url, path, host, verdict, own in zip(*(batch.column(c).to_pylist() for c in (
                    "_range", "_key", "_is_url", "path", "host", "verdict", "_id"))):
                if here != at:
                    stack, at = [], here
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1].key != key:
                        stack.append(Level(key))
                    stack[-1].add(path, host + path, verdict)
                    continue
                best = None
                for level in reversed(stack):  # of equal lengths the deeper host wins
                    found = level.find(path)
                    if found and (best is None or len(found[0]) > len(best[0])):
                        best = found
                out.append((own, host, path, *(best or (None, default))))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per page: its id, host, path, rule and verdict.

    rules(host, path, verdict): a rule fits its host and all subdomains if the
    path starts with the rule's; the longest host + path wins, of equally long
    ones that of the deeper host, of equal rules the blocking one. A null url or
    one without :// has an empty host and path. Null rule hosts are ignored, null
    rule paths are empty. Without a fitting rule the verdict is `default` and the
    rule null. Other columns are not read; empty tables are fine; repeated rows
    are judged each.
    """
    urls = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    salt = F.lpad(F.hex(F.xxhash64("_id")), 16, "0")
    urls = urls.withColumn("_key", F.concat_ws("\x00", host_key(F.col("host")), "path", salt))
    n, total = partitions(pages), pages.count()
    share = min(1.0, SAMPLED * n / max(total, 1))
    sample = sorted(r[0] for r in urls.select("_key").sample(share, seed=7).collect())
    borders = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(borders, k)).astype("int32")

    rules = rules.filter("host is not null").select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.withColumn("_key", host_key(F.col("host")))
    first, last = place(F.col("_key")), place(F.concat("_key", F.lit(LAST)))
    sent = rules.withColumn("_first", first).withColumn("_last", last).select(
        F.explode(F.sequence("_first", "_last")).alias("_range"), "_key", F.lit(False).alias("_is_url"),
        "path", "host", "verdict", F.lit(None).cast("long").alias("_id"))
    asked = urls.select(place(F.col("_key")).alias("_range"), "_key", F.lit(True).alias("_is_url"),
                        "path", "host", F.lit(None).cast("string").alias("verdict"), "_id")
    both = asked.unionByName(sent).repartition(n, "_range").sortWithinPartitions("_range", "_key", "_is_url", "path")
    return both.mapInArrow(sweep(default), JUDGED).withColumnRenamed("_id", id_col)
