"""Spelling variants by bidirectional FM-index search schemes.

Words: the runs of letters (A-Z, a-z, U+00C0-U+00FF) of every text, A-Z
lower-cased; where 31 divides h = crc32("<doc_id>:<run>") the run loses its code
point h % length. Words of at least 7 code points met at least twice are the
vocabulary, n being how often a word is met. Two words are near when one
inserted, deleted or replaced code point turns one into the other.

Method. A word q of length L has halves P1 = q[:L//2] and P2 = q[L//2:]. One
edit leaves one half whole, so a near word starts with P1 or ends with P2. Two
search schemes use that over a bidirectional FM-index of the delimited
vocabulary (#w1#w2#...#): (a) match #P1 exactly, then extend to the right across
P2 allowing one error, then the closing #; (b) match P2# exactly from the right,
extend to the left across P1 allowing one error, then the opening #. Extensions
keep a pair of suffix-rank intervals, one in the text's suffix array and one in
its reverse's, so that either end can grow.

Spark deals the work: a word is indexed under the half keys by which any query
of length L-1, L or L+1 may look for it, and asks under its own two keys;
keys are hashed to buckets, a key with more than `shard_words` words is split
into salted parts that each query visits. Each bucket builds its index and runs
the schemes of its queries. Forms are then chosen by a join with the counts,
and roots by pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import partitions
from rankweave.session import written

# Fixed values of the contract.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CUT, LEAST, TWICE, FACTOR = 31, 7, 2, 10
#: Words of one salted part of a key, and of a bucket on average.
SHARD_WORDS = 5_000
BUCKET_WORDS = 10_000


def met_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word met, one row per run: word."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), 0)).alias("run"))
    low = F.translate("run", UPPER, LOWER)
    runs = runs.select(low.alias("low"), F.crc32(F.concat("id", F.lit(":"), low)).alias("h"))
    p = (F.col("h") % F.length("low")).cast("int")
    cut = F.concat(F.col("low").substr(F.lit(1), p), F.col("low").substr(p + 2, F.length("low")))
    return runs.select(F.when(F.col("h") % CUT == 0, cut).otherwise(F.col("low")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return (met_words(docs, id_col, text_col).filter(F.length("word") >= LEAST)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= TWICE))


def _key(word: str, scheme: str, length: Column) -> Column:
    """The half a query of `length` code points matches exactly: its first or its last half."""
    if scheme == "p":
        return F.col(word).substr(F.lit(1), F.floor(length / 2).cast("int"))
    tail = (length - F.floor(length / 2)).cast("int")
    return F.col(word).substr(F.length(word) - tail + 1, tail)


def placements(vocab: DataFrame) -> DataFrame:
    """role ('i': indexed, 'q': asks), scheme, key, word."""
    size = F.length("word")
    index = [F.struct(F.lit(s).alias("scheme"), _key("word", s, size + d).alias("key"))
             for s in "ps" for d in (-1, 0, 1)]
    indexed = vocab.select("word", F.explode(F.array_distinct(F.array(*index))).alias("at"))
    indexed = indexed.filter(F.length("at.key") > 0).select(F.lit("i").alias("role"), "at.scheme", "at.key", "word")
    asks = vocab.select("word", F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), _key("word", s, size).alias("key"))
                                                      for s in "ps"])).alias("at"))
    return indexed.unionByName(asks.select(F.lit("q").alias("role"), "at.scheme", "at.key", "word"))


class Index:
    """Bidirectional FM-index of '#w1#w2#...#' (and its reverse) over dense symbols: 0 end, 1 '#', 2.. letters.

    `rank_f[i, c]` counts the symbols smaller than c among the first i of the
    forward text's Burrows-Wheeler transform, `rank_r` the same for the reverse
    text; one table gives both the count of c and the count of smaller ones,
    which the other interval of the pair needs. Searches run on arrays of states,
    all queries of a call at once.
    """

    def __init__(self, words: list[str]):
        letters = sorted({ch for w in words for ch in w})
        self.code = {ch: i + 2 for i, ch in enumerate(letters)}
        self.sigma = len(letters) + 2
        body = [1]
        starts = []
        for w in words:
            starts.append(len(body) - 1)
            body += [self.code[ch] for ch in w] + [1]
        self.words = words
        self.starts = np.array(starts, dtype=np.int64)
        forward = np.array(body + [0], dtype=np.int64)
        backward = np.array(body[::-1] + [0], dtype=np.int64)
        self.sa = suffix_array(forward)
        self.rank_f = ranks(forward, self.sa, self.sigma)
        self.rank_r = ranks(backward, suffix_array(backward), self.sigma)
        counts = np.bincount(forward, minlength=self.sigma)
        self.before = np.r_[0, np.cumsum(counts)[:-1]]
        self.n = len(forward)

    def grow(self, a_lo, a_hi, b_lo, b_hi, c, rank):
        """Extend by c on the side whose transform `rank` counts: b is that index's interval, a the other's."""
        size = (rank[b_hi, c + 1] - rank[b_hi, c]) - (rank[b_lo, c + 1] - rank[b_lo, c])
        nb = self.before[c] + rank[b_lo, c + 1] - rank[b_lo, c]
        na = a_lo + rank[b_hi, c] - rank[b_lo, c]
        return na, na + size, nb, nb + size, size

    def search(self, queries: list[str], scheme: str) -> list[tuple[int, int]]:
        """(query number, word number) of words at exactly one edit whose half stays whole: first ('p') or last ('s')."""
        if not queries:
            return []
        width = max(map(len, queries))
        codes = np.full((len(queries), width), -1, np.int64)
        for i, q in enumerate(queries):
            own = [self.code.get(ch, -1) for ch in (q if scheme == "p" else q[::-1])]
            codes[i, :len(own)] = own
        length = np.array([len(q) for q in queries])
        exact = length // 2 if scheme == "p" else length - length // 2
        # Engine direction: 'p' grows to the right (reverse transform), 's' to the left (forward transform).
        rank = self.rank_r if scheme == "p" else self.rank_f
        n = self.n
        q = np.arange(len(queries))
        a_lo, a_hi, b_lo, b_hi, size = self.grow(np.zeros_like(q), np.full_like(q, n), np.zeros_like(q), np.full_like(q, n),
                                                 np.ones_like(q), rank)
        for t in range(width):
            on = (exact > t) & (size > 0)
            c = codes[:, t]
            go = on & (c >= 0)
            grown = self.grow(a_lo[go], a_hi[go], b_lo[go], b_hi[go], c[go], rank)
            for arr, new in zip((a_lo, a_hi, b_lo, b_hi, size), grown):
                arr[go] = new
            size[on & (c < 0)] = 0
        keep = size > 0
        state = [q[keep], exact[keep], np.zeros(keep.sum(), np.int64), a_lo[keep], a_hi[keep], b_lo[keep], b_hi[keep]]
        found = []
        while len(state[0]):
            qi, j, err, alo, ahi, blo, bhi = state
            nxt = []
            end = j == length[qi]
            # Ends: close with '#', after one error, or after one inserted letter at the end.
            fin = end & (err == 1)
            found.append(self._close(qi[fin], alo[fin], ahi[fin], blo[fin], bhi[fin], rank, scheme))
            tail = end & (err == 0)
            if tail.any():
                iq, x, lo2 = self._letters(qi[tail], alo[tail], ahi[tail], blo[tail], bhi[tail], rank)
                found.append(self._close(iq, *lo2, rank, scheme))
            go = ~end
            qi, j, err, alo, ahi, blo, bhi = (v[go] for v in (qi, j, err, alo, ahi, blo, bhi))
            c = codes[qi, j]
            ok = c >= 0
            m = self.grow(alo[ok], ahi[ok], blo[ok], bhi[ok], c[ok], rank)
            live = m[4] > 0
            nxt.append([qi[ok][live], j[ok][live] + 1, err[ok][live], *(v[live] for v in m[:4])])
            free = err == 0
            if free.any():
                # Deletion: the word lacks q[j].
                nxt.append([qi[free], j[free] + 1, np.ones(free.sum(), np.int64), alo[free], ahi[free], blo[free], bhi[free]])
                iq, x, grown = self._letters(qi[free], alo[free], ahi[free], blo[free], bhi[free], rank)
                jj = j[free][iq[1]]
                sub = x != codes[iq[0], jj]
                ones = np.ones(len(x), np.int64)
                nxt.append([iq[0][sub], jj[sub] + 1, ones[sub], *(v[sub] for v in grown)])   # replaced
                nxt.append([iq[0], jj, ones, *grown])                                         # inserted
            state = [np.concatenate(parts) for parts in zip(*nxt)] if nxt else [np.array([], np.int64)] * 7
        pairs = np.concatenate([f for f in found if len(f)]) if any(len(f) for f in found) else np.empty((0, 2), np.int64)
        return sorted(set(map(tuple, pairs.tolist())))

    def _letters(self, qi, alo, ahi, blo, bhi, rank):
        """Every (state, letter) that the interval continues with, and the grown intervals."""
        counts = np.diff(rank[bhi], axis=1) - np.diff(rank[blo], axis=1)
        counts[:, :2] = 0
        at, x = np.nonzero(counts)
        grown = self.grow(alo[at], ahi[at], blo[at], bhi[at], x, rank)
        return (qi[at], at), x, grown[:4]

    def _close(self, qi, alo, ahi, blo, bhi, rank, scheme):
        """(query, word) pairs for the intervals that a closing '#' keeps."""
        if isinstance(qi, tuple):
            qi = qi[0]
        if not len(qi):
            return np.empty((0, 2), np.int64)
        a_lo, a_hi, b_lo, b_hi, size = self.grow(alo, ahi, blo, bhi, np.ones_like(qi), rank)
        live = size > 0
        lo = (a_lo if scheme == "p" else b_lo)[live]
        many = size[live]
        rows = np.repeat(np.arange(len(lo)), many)
        place = lo[rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many))
        word = np.searchsorted(self.starts, self.sa[place])
        return np.c_[qi[live][rows], word]

    def near(self, q: str, scheme: str) -> set[str]:
        """Words at exactly one edit from q whose half stays whole: the first ('p') or the last ('s')."""
        return {self.words[w] for _, w in self.search([q], scheme)}


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of `t`, whose last symbol is the unique smallest, by prefix doubling."""
    n, rank, k = len(t), t.astype(np.int64), 1
    while True:
        second = np.full(n, -1, np.int64)
        if k < n:
            second[: n - k] = rank[k:]
        sa = np.lexsort((second, rank))
        new = np.r_[False, (rank[sa][1:] != rank[sa][:-1]) | (second[sa][1:] != second[sa][:-1])]
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(new)
        if rank.max() == n - 1:
            return sa
        k *= 2


def ranks(t: np.ndarray, sa: np.ndarray, sigma: int) -> np.ndarray:
    """rank[i, c]: how many of the first i symbols of the Burrows-Wheeler transform are smaller than c (c up to sigma)."""
    bwt = t[sa - 1]
    occ = np.zeros((len(t) + 1, sigma + 1), np.int32)
    occ[np.arange(1, len(t) + 1), bwt + 1] = 1
    return np.cumsum(np.cumsum(occ, axis=0, dtype=np.int32), axis=1, dtype=np.int32)


def search_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows (role, scheme, word) of one bucket -> pairs (word, near) found by the schemes."""
    indexed = sorted(set(rows.loc[rows["role"] == "i", "word"]))
    pairs: set = set()
    if indexed:
        index = Index(indexed)
        asks = rows.loc[rows["role"] == "q", ["scheme", "word"]].drop_duplicates()
        for scheme, part in asks.groupby("scheme"):
            queries = part["word"].tolist()
            pairs.update((queries[i], index.words[w]) for i, w in index.search(queries, scheme))
    return pd.DataFrame(sorted(pairs), columns=["word", "near"])


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shard_words: int = SHARD_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """One row per vocabulary word: word, form, root, n, n_near, form_n.

    form: the near word of largest n (ties: the smallest in code-point order) if
    that n is at least ten times the word's, else null; root: the last word on
    the way of forms (the word itself without a form). Null text has no runs;
    a null doc_id reads as empty text in the hash. Very long texts are read
    whole; repeated rows count twice. Other columns are not read. No words: no rows.
    """
    vocab = written(vocabulary(docs, id_col, text_col), "spelling-vocabulary")
    placed = placements(vocab)
    keys = placed.filter(F.col("role") == "i").groupBy("scheme", "key").agg(F.count("*").alias("size"))
    keys = keys.select("scheme", "key", F.ceil(F.col("size") / shard_words).cast("int").alias("parts"))
    total = vocab.count() * 8
    buckets = max(partitions(vocab), -(-total // bucket_words))
    placed = placed.join(keys, ["scheme", "key"])
    salt = F.when(F.col("role") == "i", F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.select("role", "scheme", "key", "word", F.explode(salt).alias("salt"))
    placed = placed.select("role", "scheme", "word", F.pmod(F.xxhash64("scheme", "key", "salt"), F.lit(buckets)).alias("bucket"))
    pairs = placed.groupBy("bucket").applyInPandas(lambda df: search_bucket(df[["role", "scheme", "word"]]), "word string, near string")
    pairs = written(pairs.distinct(), "spelling-pairs")
    counted = pairs.join(vocab.withColumnRenamed("word", "near").withColumnRenamed("n", "near_n"), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    out = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.m") >= FACTOR * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.m") >= FACTOR * F.col("n"), -F.col("best.m")).alias("form_n"))
    out = written(out, "spelling-forms")
    return out.join(roots(out), "word").select(
        "word", "form", "root", F.col("n").cast("long"), F.col("n_near").cast("long"), F.col("form_n").cast("long"))


def roots(forms: DataFrame) -> DataFrame:
    """word -> root by pointer doubling over word -> form; forms grow tenfold per step, so ways are short."""
    step = forms.select("word", F.coalesce("form", "word").alias("to"))
    while True:
        jumped = step.alias("x").join(step.alias("y"), F.col("x.to") == F.col("y.word")).select(
            F.col("x.word").alias("word"), F.col("y.to").alias("to"), (F.col("x.to") != F.col("y.to")).alias("moved"))
        jumped = written(jumped, "spelling-roots")
        if not jumped.filter("moved").limit(1).count():
            return jumped.select("word", F.col("to").alias("root"))
        step = jumped.select("word", "to")
