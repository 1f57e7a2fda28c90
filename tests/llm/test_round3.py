"""Spelling variants, decontamination and the conversation trie against brute force, on real rows and odd ones."""

import collections
import hashlib
import random
import re
import sys
import zlib

import pytest

from rankweave.llm import decontaminate, prefix_trie, spelling

SF = "/root/testdata/sf0.001"
#: Columns that clash with internal names of the three operators.
EXTRA = "row long, words string, word string, p int, k int, l int, w string, window string, items string, c long, d int, a long, b long, bucket int, upper boolean, n long, near string, role_ string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty texts, a very long text, ties, repeated rows, clashing columns, letters beyond ASCII."""
    rnd = random.Random(7)
    words = ["receiving", "recieving", "receivings", "Receiving", "accommodate", "acommodate", "définition", "definition", "ÀÉÎõüÿ×÷x"]
    long = " ".join(rnd.choice(words) for _ in range(20_000))
    passage = "the quick brown fox jumps over the lazy dog again and again"
    texts = [None, "", "  ", long, long, f"{passage} and more", f"x {passage[:30]}", "Receiving RECEIVING receiving",
             "a1 b2 ÉTÉ été 42 x_y-z", "one two three"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, f"{passage} and more"), (None, "receiving recieving"), (None, None)]
    return spark.createDataFrame([(i, t, *[None] * 18) for i, t in rows], f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="module")
def odd_bench(spark):
    items = [(1, "The quick brown fox jumps over the lazy dog again and again!"), (2, "quick brown"), (3, None), (4, "  ,, "),
             (None, "one two three"), (6, "x the quick brown fox"), (1, "The quick brown fox jumps over the lazy dog again and again!")]
    return spark.createDataFrame([(i, t, None) for i, t in items], "item_id long, text string, window string")


def text_rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# Spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_spelling(rows):
    cnt = collections.Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 31 == 0:
                p = h % len(low)
                low = low[:p] + low[p + 1:]
            cnt[low] += 1
    vocab = {w: n for w, n in cnt.items() if len(w) >= 7 and n >= 2}
    letters = set("".join(vocab))

    def edits(w):
        for i in range(len(w) + 1):
            if i < len(w):
                yield w[:i] + w[i + 1:]
            for c in letters:
                yield w[:i] + c + w[i:]
                if i < len(w) and c != w[i]:
                    yield w[:i] + c + w[i + 1:]

    near = {w: {v for v in edits(w) if v in vocab and v != w} for w in vocab}
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 10 * vocab[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), vocab[w], len(near[w]), vocab[form[w]] if form[w] else None) for w in vocab}


@pytest.mark.parametrize("name,shard", [("docs", 5_000), ("docs", 3), ("odd_docs", 5_000), ("odd_docs", 1)])
def test_spelling(request, name, shard):
    df = request.getfixturevalue(name)
    got = spelling.spelling_groups(df, shard_words=shard).collect()
    assert {tuple(r) for r in got} == brute_spelling(text_rows(df))
    assert len(got) == len({r["word"] for r in got})


def test_index_finds_every_edit():
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abcé") for _ in range(rnd.randint(7, 10))) for _ in range(400)})
    index = spelling.Index(words)
    vocab = set(words)
    for q in words[:80]:
        got = index.near(q, "p") | index.near(q, "s")
        want = {w for w in vocab if w != q and levenshtein_one(q, w)}
        assert got == want


def levenshtein_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_spelling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(empty).count() == 0


# Decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(doc_rows, item_rows):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (s or ""))
    windows = collections.defaultdict(set)
    for i, t in item_rows:
        w = WORD.findall(low(t))
        for s in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows[tuple(w[s:s + min(10, len(w))])].add("" if i is None else str(i))
    out = collections.Counter()
    for i, t in doc_rows:
        w, hit, items = WORD.findall(low(t)), set(), set()
        for p in range(len(w)):
            for k, v in windows.items():
                if tuple(w[p:p + len(k)]) == k:
                    hit.update(range(p, p + len(k)))
                    items |= v
        out[(i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.mark.parametrize("names", [("docs", "bench"), ("odd_docs", "odd_bench"), ("odd_docs", "bench")])
def test_contamination(request, names):
    df, items = (request.getfixturevalue(n) for n in names)
    got = decontaminate.contamination(df, items).collect()
    want = brute_contamination(text_rows(df), [(r["item_id"], r["text"]) for r in items.collect()])
    assert collections.Counter(tuple(r) for r in got) == want


def test_contamination_of_nothing(spark, odd_bench):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.contamination(empty, odd_bench).count() == 0
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, None)], "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in got) == [(1, 4, 0, False), (2, 0, 0, False)]


# Conversation trie

def brute_trie(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    orig = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c in orig:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        rebuilt[c] = orig.get(base, [])[:h] + orig[c][h:]
    nodes = collections.defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids = collections.defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    sub = {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves = sum(sub[ch][0] for ch in kids[k]) + (0 if kids[k] else 1)
        saved = sum(sub[ch][1] for ch in kids[k]) + (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        sub[k] = (leaves, saved)
    out = collections.Counter()
    for k, members in nodes.items():
        ends = sorted(c for c in members if len(rebuilt[c]) == len(k))
        out[(min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), *sub[k],
             hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def convs(spark):
    return spark.read.parquet(f"{SF}/conversations.parquet")


@pytest.fixture(scope="module")
def odd_convs(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, a long text, copies that share first turns, clashing columns."""
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "bye"), (1, 0, "user", "hi"), (1, 1, None, None),
            (2, None, "user", "first"), (2, 1, "user", "ü" * 5000), (2, 1, "user", "ü" * 5000), (3, 5, "system", ""),
            (4, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 1, "assistant", "hello"), (6, 0, "user", "x"), (7, 3, "user", "x"),
            (7, 3, "user", "a"), (None, 0, "user", "hi"), (None, None, None, None), (10, 0, None, "same"), (11, 0, None, "same"),
            (12, 0, "", "same"), (-3, 0, "user", "negative")]
    return spark.createDataFrame([(*r, *[None] * 3) for r in rows], "conv_id long, turn long, role string, text string, a long, d int, bucket int")


@pytest.mark.parametrize("name,hot", [("convs", 20_000), ("convs", 2), ("odd_convs", 20_000), ("odd_convs", 1)])
def test_prefix_trie(request, name, hot):
    df = request.getfixturevalue(name)
    got = prefix_trie.prefix_trie(df, hot_min=hot).collect()
    want = brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert collections.Counter(tuple(r) for r in got) == want


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(empty).count() == 0


def test_kept_rows_leave_clashing_columns_alone(spark):
    from rankweave.llm import exact_dedup

    rows = [(1, "a b", "x1", 7, "k"), (2, "a  b", "x2", 8, "l"), (3, "c", "x3", 9, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __rw_id string, __rw_mark long, `odd``name` string")
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


if __name__ == "__main__":
    sys.exit(pytest.main([__file__, "-q"]))
