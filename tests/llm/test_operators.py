"""Each operator against brute force, on real rows and on odd ones."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from rankweave.llm import (byte_bpe, exact_dedup, html_template, line_dedup, minhash, packing, quality, simhash, url_rules,
                           word_pieces)

SF = "/root/testdata/sf0.001"
RANKS, WORDS, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
#: Columns that clash with those of the results.
EXTRA = "score double, kept boolean, keep_id long, run int, place int, digest string, print long, root long, key long, _id long, cut string, _row int, _digest binary, _proof long, _keep long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, one very long text, ties, repeated rows, clashing columns."""
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta,", "η", "Theta.", "x" * 300]
    long = " ".join(rnd.choice(words) for _ in range(30_000)) + "\n" + "y" * 50_000
    line = "one two three four five six seven eight nine ten eleven"
    texts = [None, "", " \n\t ", "a", "a b", "A  B", "a b c d e f g", long, long, f"{line}\nown one", f"own two\n{line}\n\nlast", line,
             "a b c d e f g", "a b c d e f g", "<|endoftext|> it's 1234 \u00a0\u2028 x\x0b\x0cy \x1c z e\u0301", "\u0301a"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (3, "other words at the same id"), (None, "a b c"), (None, None), (6, "a b c d e f g")]
    data = [(i, t, *[None] * 15) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df):
    return [r.asDict() for r in df.collect()]


def text_rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# Exact dedup

@pytest.mark.parametrize("name", ["docs", "odd"])
def test_exact_dedup(request, name):
    df = request.getfixturevalue(name)
    flat = lambda t: brute.SPACE.sub(" ", t)
    groups = collections.defaultdict(list)
    for i, t in text_rows(df):
        groups[flat(t)].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        best = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            want[(i, best, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    for fan_in in (2, 32):
        got = exact_dedup.exact_groups(df, fan_in=fan_in)
        assert collections.Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got.collect()) == want
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(flat(t) for _, t in text_rows(kept)) == sorted(groups)


# SimHash

def test_fingerprint_is_the_definition():
    for t in ("", " ", "a", "A b", "a b c", "É è a A", " ".join(map(str, range(500)))):
        assert simhash.fingerprint(t.encode()) == brute.simhash(t)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_near_groups(request, name):
    df = request.getfixturevalue(name)
    data = text_rows(df)
    prints = {t: brute.simhash(t) for _, t in data}
    root = brute.reachable(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    first = collections.defaultdict(list)
    for i, t in data:
        first[root[prints[t]]] += [i] if i is not None else []
    want = collections.Counter((i, f"{prints[t]:016x}", min(first[root[prints[t]]], default=None)) for i, t in data)
    assert collections.Counter(tuple(r) for r in simhash.near_groups(df).collect()) == want
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(root[prints[t]] for _, t in text_rows(kept)) == sorted(first)


def test_keys_meet_every_pair_in_reach(spark):
    rnd, base = random.Random(1), 0x0123456789ABCDEF
    for _ in range(60):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 3)))
        both = spark.createDataFrame([(np.uint64(x).astype(np.int64).item(),) for x in (a, b)], "print long") if _ < 6 else None
        if both is not None:
            keys = simhash.chain_keys(both.distinct()).groupBy("key").count().filter("count > 1")
            assert a == b or keys.count() > 0
        octets = [x.to_bytes(8, "big") for x in (a, b)]
        assert any(all(octets[0][i % 8] == octets[1][i % 8] for i in (2 * s, 2 * s + 1, 2 * s + 2 + p, 2 * s + 2 + q))
                   for s in range(4) for p, q in simhash.EQUAL)
    assert base


def test_spanning_links_of_a_dense_group():
    rnd = random.Random(2)
    values = np.array(sorted({sum(1 << k for k in rnd.sample(range(62), 2)) for _ in range(400)} | {0}), dtype=np.int64)
    links = simhash.spanning_links(values, 3)
    assert len(links) == len(values) - 1


def test_components_of_a_long_path(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(
        spark.createDataFrame([(1000, 1001), (1001, 1005)], "a long, b long"))
    got = {r["node"]: r["root"] for r in simhash.components(path).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000, 1005: 1000}


# URL rules

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("example.com", "/de/x", "allow"), ("example.com", "", "allow"), ("a.example.com", "/d", "block"), ("com", "/de/x/y/z/longer", "block")]


def test_url_rules(spark):
    rnd = random.Random(3)
    hosts = ["example.net", "www.example.net", "EXAMPLE.com", "a.example.com", "b.a.example.com", "notexample.net", "org", "x.org", "net",
             "example.net.", "", ".net", "a-b.example.com", "example.com:80"]
    paths = ["", "/", "/en/", "/en/1", "/de/", "/de/x", "/de/x/y/z/longer/1", "/fr/?q=/de/", "/d", "?a=/en/", "#/en/"]
    urls = [f"http://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(600)] + [None, "", "nothing", "x://y://example.net/en/", "http://example.net/en/"]
    urls += ["http://example.net/en/same"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("example.net", "/en/", "allow")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, rules).collect()}
    assert got == {i: brute.url_verdict(u, RULES) for i, u in enumerate(urls)}
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(pages, rules.limit(0), default="ask").collect()} == {"ask"}


# Tokens

def test_bpe_merges_are_the_definition():
    ranks = byte_bpe.read_ranks(RANKS)
    rnd = random.Random(4)
    for _ in range(300):
        data = bytes(rnd.choice(b"aabbett hein\xc3\xa9") for _ in range(rnd.randint(0, 30)))
        assert byte_bpe.merge_bytes(ranks, data) == brute.bpe(ranks, data)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_bpe_is_that_of_the_library(request, name):
    df = request.getfixturevalue(name)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in text_rows(df):
        ids = other.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in byte_bpe.token_digests(df, RANKS, P.PATTERN).collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_encode_and_decode_round_trip(odd):
    got = byte_bpe.decode(byte_bpe.encode(odd, RANKS, P.PATTERN), RANKS)
    assert collections.Counter((r["doc_id"], bytes(r["data"]).decode()) for r in got.collect()) == collections.Counter(text_rows(odd))


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_word_pieces(request, name):
    df = request.getfixturevalue(name)
    pieces = set(word_pieces.vocabulary(PIECES))
    known = {}
    want = []
    for i, t in text_rows(df):
        words = t.encode().split()
        for w in words:
            if w not in known:  # the longest words are as plain as they are long
                known[w] = brute.greedy_pieces(pieces, word_pieces.START + w) if len(w) < 1000 else None
        want.append((i, len(words), None if any(known[w] is None for w in words) else sum(known[w] for w in words)))
    got = [(r["doc_id"], r["n_words"], r["n_pieces"]) for r in word_pieces.count_pieces(df, PIECES).collect()]
    assert collections.Counter(g[:2] for g in got) == collections.Counter(w[:2] for w in want)
    assert collections.Counter(w for w in want if w[2] is not None) - collections.Counter(got) == {}


def check_pieces(df, got, tokenizer, window=2048):
    by = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"], r["doc_tokens"]].append(r)
        windows[r["sequence_id"]].append(r)
    want = collections.Counter()
    for i, t in text_rows(df):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], dtype="<u4")
        cuts = {(r["start"], r["length"]) for r in by[i, len(ids)]}
        for start, length in cuts:
            want[i, start, length, zlib.crc32(ids[start:start + length].tobytes())] += 0
        want[i, len(ids)] += len(ids)
    for (i, n), pieces in by.items():
        assert sum(r["length"] for r in pieces) == want[i, n], (i, n)
        assert all((i, r["start"], r["length"], r["ids_crc32"]) in want for r in pieces)
    padding = 0
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_packing(request, name):
    df = request.getfixturevalue(name)
    got = rows(packing.pack(df, WORDS))
    assert check_pieces(df, got, Tokenizer.from_file(WORDS)) == 0


def test_packer_takes_the_level_that_keeps_squares_smallest():
    rnd, p = random.Random(6), packing.Packer(64, 0)
    for k in range(400):
        s = rnd.randint(1, 63)
        n = p.levels.copy()

        def squares(h):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + s < 64:
                m[h + s] += 1
            return int((m[1:64] ** 2).sum())

        best = min(squares(h) for h in range(64 - s + 1) if h == 0 or n[h])
        p.add(k, b"\0" * 4 * s)
        assert int((p.levels[1:64] ** 2).sum()) == best
    p.join_open(final=True)
    assert p.open == 0 and sum(r[2] for r in p.take()) > 0


def test_packer_joins_when_many_windows_are_open(monkeypatch):
    monkeypatch.setattr(packing, "MAX_OPEN", 5)
    p = packing.Packer(64, 0)
    for k in range(50):
        p.add(k, bytes(4 * 33))
    p.join_open(final=True)
    done = p.take()
    assert sum(r[2] for r in done) == 50 * 33
    lengths = collections.Counter()
    for r in done:
        lengths[r[5]] += r[2]
    assert all(n <= 64 and n & (n - 1) == 0 for n in lengths.values())


# Fingerprints

@pytest.mark.parametrize("name", ["docs", "odd"])
def test_near_report(request, name):
    df = request.getfixturevalue(name)
    data = sorted(text_rows(df), key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    want, true = collections.Counter(), {}
    for (i, t), (_, after) in zip(data, data[1:] + data[:1]):
        want[i, len(t), brute.edited_digest(t, after)] += 1
        cut = len(t) // 4
        true[i, brute.edited_digest(t, after)] = brute.jaccard(t, t[:len(t) - cut] + after[:cut])
    got = rows(minhash.near_report(df))
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    errors = [r["near_edited"] - true[r["doc_id"], r["edited_sha256"]] for r in got]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    for (i, a), (j, b) in zip(data, data[1:]):
        assert a != b or i == j or i is None or prints[i] == prints[j]


def test_likeness_is_not_biased():
    of, rnd = minhash.Fingerprints(), random.Random(7)
    for share in (0.0, 0.3, 0.8, 1.0):
        errors = []
        for _ in range(30):
            a = [str(rnd.random()) for _ in range(800)]
            b = a[:int(800 * share)] + [str(rnd.random()) for _ in range(800 - int(800 * share))]
            a, b = " ".join(a), " ".join(b)
            errors.append(of.likeness(of.packed(a.encode()), of.packed(b.encode())) - brute.jaccard(a, b))
        assert abs(np.mean(errors)) < 0.02


def test_sparse_texts_fill_all_bins():
    of = minhash.Fingerprints()
    assert len(of.packed(b"")) == len(of.packed(b"one")) == minhash.BINS * minhash.BITS // 8
    assert of.packed(b"A  b") == of.packed(b"a b")


# Quality

def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_quality(df, labels).join(labels, "doc_id").filter("held_out").collect()
    assert {r["held_out"] for r in got} == {True} and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.95
    assert all((r["score"] >= 0.3) == r["predicted"] for r in got)


def test_prior_and_bounded_risk(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    _, prior = quality.fit(df, labels)
    share = labels.agg(F.avg("quality")).head()[0]
    assert abs(prior - share) < 0.12


def test_risk_on_negatives_stays_bounded():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, quality.BINS, size=(40, len(quality.FEATURES)))
    hot = quality.one_hot(x).astype(float)
    weights, prior = quality.minimise_risk(hot.T @ hot, hot[:30].T @ hot[:30])
    f = hot @ weights
    assert 0 < prior <= 1 and np.isfinite(f).all() and f[:30].mean() > f[30:].mean()


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(16)] + [(None, 1), (2, None), (99, 1)], "doc_id long, quality int")
    got = rows(quality.score_quality(odd, labels))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(none, labels).count() == 0
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">home</a></li></ul></nav><!-- no <p>ad</p> --><div class="ad">buy</div>
<article><h1>Head {n}</h1><p><b>First &amp; &lt;second&gt; {n}<br>line<p>Third&nbsp;x {n}</p><ul><li>item <i>one</i><li>two {n}</ul>
<div class="comments"><p>me too</p></div><form><input value="q">send</form></article>
<aside>more</aside><footer>&copy; us</footer></body></html>"""


def test_html_text(spark):
    pages = [(n, f"http://h{n % 2}.example/{n}", PAGE.replace("{n}", str(n))) for n in range(8)]
    odd = [(100, None, None), (101, "http://h0.example/x", ""), (102, "http://h0.example/y", "plain &amp; text"),
           (103, "http://h0.example/z", "<div><p>a  <p>b<!-- open"), (104, "x", "<p>1 < 2 & 3"), (104, "x", "<p>1 < 2 & 3"),
           (105, "x", "<script>only"), (106, "x", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("slot", F.lit(1))
    got = {r["page_id"]: r for r in html_template.extract(df).collect()}
    for n in range(8):
        assert got[n]["text"] == f"Head {n}\n\nFirst & <second> {n} line\n\nThird x {n}\n\nitem one\n\ntwo {n}"
    assert [got[i]["text"] for i in (100, 101, 102, 103, 104, 105)] == ["", "", "plain & text", "a\n\nb", "1 < 2 & 3", ""]
    assert got[106]["n_chars"] == 200_000 * 5 - 1
    assert html_template.extract(df).count() == len(pages) + len(odd)
    assert html_template.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page,text", [
    ("<article><p>a <img src=x> b<script>x</script>c <button>go</button> d</article>", "a bc d"),
    ("<main><div class='breadcrumbs'>x</div><article class='post has-comments'><p>t</p><section class=reader-comments>c</section></article></main>", "t"),
    ("<div id=cookie-notice>c</div><div class='page with-sidebar'><p>body</p></div><div class=sidebar-left>s</div>", "body"),
    ("<div class=site-header>h</div><article><div class=entry-header><h1>T</h1></div><p>x<span class=ad>buy</span>y</p></article>", "T\n\nxy"),
    ("<p>a<!-- <p>b --></p><table><tr><td>1<td>2</table><hr>&#x41;&amp;&lt;", "a\n\n1\n\n2\n\nA&<"),
    ("<ARTICLE><P HIDDEN>no</P><P STYLE='display: none'>no</P><dl><dt>k<dd>v</dl></ARTICLE>", "k\n\nv"),
    ("<article>" + "<div>" * 500 + "deep", "deep"),
])
def test_pages_by_their_marks(page, text):
    assert html_template.main_text(page, None) == text


def test_host_without_marks_is_learned_from_its_pages(spark):
    page = ('<html><body><div class="top"><a href="/">all</a> <a href="/b">the same</a></div><div class="x1"><p>{a}</p><p>{b}</p></div>'
            '<div class="x2"><p>always the same words here</p></div></body></html>')
    df = spark.createDataFrame([(n, f"http://one.example/{n}", page.format(a=f"text {n} " * 9, b=f"more {n}")) for n in range(6)],
                               "page_id long, url string, html string")
    got = [r["text"] for r in html_template.extract(df).orderBy("page_id").collect()]
    assert got == [f"{('text %d ' % n) * 9}".strip() + f"\n\nmore {n}" for n in range(6)]


@pytest.mark.parametrize("page,text", [
    ("<article class='post tag-cookies'><h1>T</h1><p>body</p></article><div class=related>r</div>", "T\n\nbody"),
    ("<main><article class='category-social share'><p>body</p></article></main>", "body"),
    ("<div id=content class=search-result-page><h1>T</h1><p>body</p><div class=related>r</div></div>", "T\n\nbody"),
    ("<div class=related-work><p>" + "long " * 20 + "</p></div><p>x</p>", "long " * 19 + "long\n\nx"),
    ("<p>short</p><div class=comments><p>" + "long " * 20 + "</p></div>", "short"),
    ("<article><p>a</p><article class=comment>c</article></article>", "a"),
])
def test_class_words_do_not_drop_articles(page, text):
    assert html_template.main_text(page, None) == text


def texts_of_host(spark, pages):
    df = spark.createDataFrame([(n, f"http://one.example/{n}", p) for n, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_template.extract(df).orderBy("page_id").collect()]


@pytest.mark.parametrize("n", [2, 3, 7])
def test_flat_and_split_articles_stay_whole(spark, n):
    flat = ("<html><head><title>t</title></head><body><h1><a href=/{k}>Head {k}</a></h1>{p}<ul><li>item {k}</li></ul><blockquote>quote {k}</blockquote>"
            "<pre>code {k}</pre></body></html>")
    got = texts_of_host(spark, [flat.format(k=k, p="".join(f"<p>par {k} {i}</p>" for i in range(k + 1))) for k in range(n)])
    assert got == ["\n\n".join([f"Head {k}", *(f"par {k} {i}" for i in range(k + 1)), f"item {k}", f"quote {k}", f"code {k}"]) for k in range(n)]
    split = "<html><body><div class=lead><p>lead {k}</p></div><div class=body><p>body {k} is longer</p></div></body></html>"
    assert texts_of_host(spark, [split.format(k=k) for k in range(n)]) == [f"lead {k}\n\nbody {k} is longer" for k in range(n)]


def test_slots_that_never_change_go(spark):
    page = ("<html><body><div class=wrap><div class=x1>{p}</div><div class=x2><p>always the same words here</p></div></div>"
            "<div class=x3><a href=/{k}>see {k}</a> <a href=/>more {k}</a></div></body></html>")
    pages = [page.format(k=k, p="".join(f"<p>par {k} {i}</p>" for i in range(k + 1))) for k in range(5)]
    want = ["\n\n".join(f"par {k} {i}" for i in range(k + 1)) for k in range(5)]
    assert texts_of_host(spark, pages) == want
    assert texts_of_host(spark, [p.replace("<div class=wrap>", "<article>").replace("</div></div><div class=x3>", "</div></article><div class=x3>")
                                 for p in pages]) == want
    # Pages that are all the same tell nothing of what changes.
    assert texts_of_host(spark, ["<html><body><div><p>one text</p></div></body></html>"] * 3) == ["one text"] * 3


def test_sent_and_salted_slots_agree(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    a = sorted(tuple(r) for r in html_template.extract(df).collect())
    monkeypatch.setattr(html_template, "MAX_SENT", 0)
    assert sorted(tuple(r) for r in html_template.extract(df).collect()) == a


# Lines

def test_patience_is_the_definition():
    rnd = random.Random(8)
    for _ in range(400):
        a, b = ([rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert got == brute.lcs_pairs(a, b)


@pytest.mark.parametrize("rare", [1, 4])
def test_line_dedup(spark, docs, rare):
    data = text_rows(docs)
    want = brute.line_dedup(data, rare, 10)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs, rare=rare).collect()}
    assert {d[0]: t for d, t in want.items()} == {i: r["text"] for i, r in got.items()}
    assert any(r["removed_lines"] for r in got.values())


def test_runs_cover_every_block():
    rnd = random.Random(5)
    for _ in range(300):
        words = [rnd.choice([0, 0, 1, 3, 5, 12]) for _ in range(rnd.randint(0, 12))]
        hashes = [k + 1 if w else None for k, w in enumerate(words)]
        spans = {(i, j) for _, i, j in line_dedup.runs(hashes, words, 10)}
        want = set()
        for i in range(len(words)):
            for j in range(i, len(words)):
                if words[i] and words[j] and sum(words[i:j + 1]) >= 10 and (sum(words[i:j]) < 10 or sum(words[i + 1:j + 1]) < 10):
                    want.add((i, j))
        shortest = {(i, min(b for a, b in want if a == i)) for i, _ in want} | {(max(a for a, b in want if b == j), j) for _, j in want}
        assert shortest <= spans <= want


def test_line_dedup_is_that_of_all_pairs(spark, docs):
    want = brute.line_dedup(text_rows(docs), 10 ** 9, 10)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert {d[0]: t for d, t in want.items()} == got


def test_frequent_passages_go_from_all_later_documents(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    short = ["a b c d", "e f g h", "i j k l"]
    # The earliest holder has the passage twice, so patience diff has no anchor there.
    texts = [f"x0\n{passage}\ny0\n{passage}\nz0"] + [f"x{k}\n{passage}\ny{k}" for k in range(1, 8)]
    # Frequent short lines whose earliest holders have one of them alone; together they are a block.
    texts += short + ["\n".join([f"u{k}", *short, f"v{k}"]) for k in range(8)]
    # The same passages in another order than the earliest holder's.
    other = [f"{w} " * 11 for w in ("red", "green")]
    texts += [f"p0\n{other[0]}\nq0\n{other[1]}\nr0"] + [f"p{k}\n{other[1]}\nq{k}\n{other[0]}\nr{k}" for k in range(1, 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in line_dedup.line_dedup(df).orderBy("doc_id").collect()]
    assert got[:8] == [texts[0]] + [f"x{k}\ny{k}" for k in range(1, 8)]
    assert got[8:12] == texts[8:12] and got[12:19] == [f"u{k}\nv{k}" for k in range(1, 8)]
    assert got[19:] == [texts[19]] + [f"p{k}\nq{k}\nr{k}" for k in range(1, 7)]


def test_line_dedup_of_odd_rows(odd, none):
    got = line_dedup.line_dedup(odd)
    assert got.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    line = "one two three four five six seven eight nine ten eleven"
    assert (texts[9], texts[10], texts[11]) == (f"{line}\nown one", "own two\n\nlast", "")
    assert texts[0] == texts[1] == "" and texts[8] == ""
    assert line_dedup.line_dedup(none).count() == 0


def test_empty_tables(none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert simhash.near_dedup(none).count() == 0
    assert byte_bpe.token_digests(none, RANKS, P.PATTERN).count() == 0
    assert word_pieces.count_pieces(none, PIECES).count() == 0
    assert packing.pack(none, WORDS).count() == 0
    assert minhash.near_report(none).count() == 0
    assert minhash.fingerprints(none).count() == 0
