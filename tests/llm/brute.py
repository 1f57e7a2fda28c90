"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

SPACE = re.compile("[\x20\x09-\x0d]+")


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text: str) -> list[str]:
    return [w for w in SPACE.split(text) if w]


def simhash(text: str) -> int:
    words = words_of(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(nodes: list, linked) -> dict:
    """node -> smallest node it is connected to."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def url_verdict(url: str | None, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = lowered(rest[:cut]), rest[cut:]
        path = rest[:min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None, key=lambda f: (f[0], f[1], f[3] == "block"))
    return host, path, best[2] if best else None, best[3] if best else default


def bpe(ranks: dict[bytes, int], data: bytes) -> list[int]:
    parts = [data[i:i + 1] for i in range(len(data))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def greedy_pieces(vocabulary: set[bytes], word: bytes) -> int:
    n = 0
    while word:
        length = next(k for k in range(len(word), 0, -1) if word[:k] in vocabulary)
        word, n = word[length:], n + 1
    return n


def shingles(text: str, width: int = 5) -> set:
    words = words_of(lowered(text))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def edited_digest(text: str, following: str) -> str:
    cut = len(text) // 4
    return hashlib.sha256((text[:len(text) - cut] + following[:cut]).encode()).hexdigest()


def flat_line(line: str) -> str:
    return " ".join(words_of(line))


def lcs_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff by its definition, recursively."""
    def rec(i, x, j, y):
        out = []
        while i < x and j < y and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        tail = []
        while i < x and j < y and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
            tail.append((x, y))
        left, right = a[i:x], b[j:y]
        anchors = [(i + left.index(h), j + right.index(h)) for h in left if h and left.count(h) == 1 and right.count(h) == 1]
        best: list = []
        chains = []
        for p in anchors:
            before = max((c for c in chains if c[-1][1] < p[1]), key=lambda c: (len(c), -c[-1][1]), default=[])
            chains.append([*before, p])
        best = max(chains, key=lambda c: (len(c), -c[-1][1]), default=[])  # of equally long ones, that ending first
        for p, q in best:
            out += [*rec(i, p, j, q), (p, q)]
            i, j = p + 1, q + 1
        if best:
            out += rec(i, x, j, y)
        return out + tail

    return sorted(rec(0, len(a), 0, len(b)))


def line_dedup(docs: list[tuple], rare: int, min_words: int) -> dict:
    """(id, text) -> what is left of the text."""
    keyed = sorted(docs, key=lambda d: d[0])
    lines = [[flat_line(x) for x in t.split("\n")] for _, t in keyed]
    holders = defaultdict(list)
    for k, ls in enumerate(lines):
        for line in set(ls) - {""}:
            holders[line].append(k)
    pairs = set()
    for ks in holders.values():
        pairs |= {(a, b) for b in ks for a in ks if a < b} if len(ks) <= rare else {(ks[0], b) for b in ks[1:]}
    gone = defaultdict(set)
    for a, b in pairs:
        block, last = [], None
        for i, j in [*lcs_pairs(lines[a], lines[b]), (-1, -1)]:
            if block and (i, j) != (last[0] + 1, last[1] + 1):
                if sum(len(lines[b][k].split(" ")) if lines[b][k] else 0 for k in block) >= min_words:
                    gone[b] |= set(block)
                block = []
            block.append(j)
            last = (i, j)
    return {d: "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone[k]) for k, d in enumerate(keyed)}
