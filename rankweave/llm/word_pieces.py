"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. Where it has no way on, a node knows what greedy
longest matching would do: how many pieces it would cut off (its popped count) and
the node it would then be at (its failure link). Both are worked out once, in
breadth-first order. A word is then read once, symbol by symbol, and its number
of pieces falls out as a sum of popped counts; no piece is ever built and no
symbol read twice, so very long words cost linear time.

Symbols are bytes. All 256 single bytes are pieces too (byte fallback), so every
word can be cut.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import arrow_schema, whole

START = "\u2581".encode()
SYMBOLS = 256
CACHE, CACHED_LENGTH = 300_000, 200
COUNTS = "_id long, n_words long, n_pieces long"


def vocabulary(path: str) -> list[bytes]:
    """The written-out pieces of a vocabulary in which words begin with START, and all single bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i).encode() for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))] + [bytes([b]) for b in range(256)]


class LongestMatch:
    """Trie with failure links and popped counts."""

    def __init__(self, pieces):
        self.go: dict[int, int] = {}
        final, parents = [False], [(0, 0)]
        for piece in pieces:
            node = 0
            for symbol in piece:
                key = node * SYMBOLS + symbol
                if (to := self.go.get(key)) is None:
                    to = self.go[key] = len(final)
                    final.append(False)
                    parents.append((node, symbol))
                node = to
            final[node] = final[node] or node > 0
        below: dict[int, list[int]] = {}
        for node in range(1, len(final)):
            below.setdefault(parents[node][0], []).append(node)
        # Any byte can follow at the root, so failing always ends.
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        queue = deque(below.get(0, ()))
        while queue:
            node = queue.popleft()
            queue.extend(below.get(node, ()))
            if final[node]:  # the whole path is a piece
                self.fail[node], self.popped[node] = 0, 1
                continue
            up, symbol = parents[node]
            at, count = self.fail[up], self.popped[up]
            while at >= 0 and (to := self.go.get(at * SYMBOLS + symbol)) is None:
                count += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = to, count

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match of a word."""
        go, node, count = self.go, 0, 0
        for symbol in word:
            while (to := go.get(node * SYMBOLS + symbol)) is None:
                count += self.popped[node]
                node = self.fail[node]
            node = to
        while node:
            count += self.popped[node]
            node = self.fail[node]
        return count


def count_pieces(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_pieces of every whole text.

    Words are runs without ASCII white space. Null and empty texts have zeros;
    repeated rows, null ids and empty tables are fine; other columns are not read.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))  # one vocabulary: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, schema, known = LongestMatch(pieces.value), arrow_schema(COUNTS), {}

        def one(word: bytes) -> int:
            n = known.get(word)
            if n is None:
                n = match.count(START + word)
                if len(word) <= CACHED_LENGTH:
                    if len(known) >= CACHE:
                        known.clear()
                    known[word] = n
            return n

        for batch in batches:
            rows = []
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = data.split()
                rows.append((own, len(words), sum(map(one, words))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), whole(F.col(text_col)).cast("binary").alias("_text"))
    return texts.mapInArrow(run, COUNTS).withColumnRenamed("_id", id_col)
