"""Sum-of-squares packing of token sequences into windows of a fixed length.

A packer takes the documents of one input split in order. What a document has
beyond whole windows is one item, and the item goes to the fill level that makes
the sum over levels of (open windows at that level) squared smallest: placing s
tokens at level h takes one window from level h and adds one to level h + s. An
array of window counts by level is all the choice needs. So levels stay evenly
used and matching gaps stay in stock.

When a split ends, the windows still open are joined end to end and cut anew at
the window length. The last stretch is cut at the binary digits of its length:
sequences whose length is a power of two need no padding, so nothing is padded.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import arrow_schema, byte_symbols, whole

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
#: Words and pre-tokens remembered by a worker, and the longest of them in bytes. The first
#: ones met are kept: frequent words come early, and no memory is ever thrown away.
WORDS_KEPT, PARTS_KEPT, CACHED_LENGTH = 250_000, 400_000, 100
#: Open windows after which a packer joins and closes them.
MAX_OPEN = 4096
ID = 4  # bytes of an id
STOPS = b".,;:!?"


class Packer:
    """One online packer; pieces are (document, start, tokens of the document, bytes of ids)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.next_sequence = window, first_sequence
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.at: dict[int, list[list]] = {}
        self.open, self.done = 0, []

    def close(self, pieces: list) -> None:
        offset = 0
        for own, start, total, ids in pieces:
            n = len(ids) // ID
            self.done.append((own, start, n, zlib.crc32(ids), total, self.next_sequence, offset))
            offset += n
        self.next_sequence += 1

    def add(self, own: int | None, ids: bytes) -> None:
        size, window = len(ids) // ID, self.window
        whole_end = size - size % window
        for start in range(0, whole_end, window):
            self.close([(own, start, size, ids[start * ID:(start + window) * ID])])
        s = size - whole_end
        if s:
            self.place((own, whole_end, size, ids[whole_end * ID:]), s)

    def place(self, piece: tuple, s: int) -> None:
        n, room = self.levels, self.window - s
        # The change of the sum of squares; full and empty windows do not count in it.
        cost = 2 * (n[s:] - n[:room + 1]) + 2
        cost[room] -= 1
        cost[n[:room + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * n[s] + 1
        h = int(room - np.argmin(cost[::-1]))  # of equal ones the fullest
        pieces = self.at[h].pop() if h else []
        if h:
            n[h] -= 1
            self.open -= 1
        pieces.append(piece)
        if h + s == self.window:
            self.close(pieces)
            return
        n[h + s] += 1
        self.open += 1
        self.at.setdefault(h + s, []).append(pieces)
        if self.open >= MAX_OPEN:
            self.join_open(final=False)

    def join_open(self, final: bool) -> None:
        """Cut the open windows, end to end, into full ones; then, at the end, the rest into powers of two."""
        line, fill = [], 0
        rest = [p for level in sorted(self.at, reverse=True) for w in self.at[level] for p in w]
        left = sum(len(p[3]) for p in rest) // ID
        self.levels[:], self.at, self.open = 0, {}, 0
        target = min(self.window, left)
        if target < self.window:
            target = 1 << target.bit_length() - 1 if final and left else 0
        for own, start, total, ids in rest:
            while ids and target:
                take = min(len(ids) // ID, target - fill)
                line.append((own, start, total, ids[:take * ID]))
                start, ids, fill = start + take, ids[take * ID:], fill + take
                if fill == target:
                    self.close(line)
                    left, line, fill = left - target, [], 0
                    target = self.window if left >= self.window else (1 << left.bit_length() - 1 if left and final else 0)
            if ids:  # not final: what is less than a window stays open
                line.append((own, start, total, ids))
        if line:
            level = sum(len(p[3]) for p in line) // ID
            self.levels[level] += 1
            self.at[level], self.open = [line], 1

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


class Words(dict):
    """Ids of texts, word by word: white space always parts tokens in this vocabulary.

    Maps words as written to their ids (little-endian unsigned 32-bit); what is missing
    is worked out. A word of plain Latin signs is lower-cased and cut into pre-tokens
    here, and the vocabulary's merges run once for each pre-token; any other word goes
    through the whole tokenizer. Both memories are bounded and kept from task to task
    of a worker.
    """

    PLAIN = regex.compile(r"[!-~\u00a1-\u024f--\u0130]+", regex.V1).fullmatch
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.stand_in = {b: c for c, b in byte_symbols().items()}
        self.parts: dict[bytes, bytes] = {}

    def part(self, part: bytes) -> bytes:
        """Ids of a lower-case pre-token."""
        ids = self.parts.get(part)
        if ids is None:
            signs = part.decode() if part.isascii() else part.decode("latin-1").translate(self.stand_in)
            ids = array("I", [t.id for t in self.merge(signs)]).tobytes()
            if len(self.parts) < PARTS_KEPT and len(part) <= CACHED_LENGTH:
                self.parts[part] = ids
        return ids

    def __missing__(self, data: bytes) -> bytes:
        stem = data if data.isalpha() else data.rstrip(STOPS)
        if stem.isalpha():  # ASCII letters, then perhaps one run of stops
            ids = self.part(stem.lower())
            if len(stem) < len(data):
                ids += self.part(data[len(stem):])
        else:
            ids = self.other(data.decode())
        if len(self) < WORDS_KEPT and len(data) <= CACHED_LENGTH:
            self[data] = ids
        return ids

    def other(self, word: str) -> bytes:
        if self.PLAIN(word) and not any(t in word for t in self.special):
            return b"".join([self.part(p.encode()) for p in self.SPLIT(word.lower())])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def ids(self, data: bytes) -> bytes:
        """The ids of a UTF-8 text."""
        return b"".join(map(self.__getitem__, data.split()))


@lru_cache(maxsize=2)
def words_of(tokenizer_json: str) -> Words:
    return Words(tokenizer_json)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; every id of every document lies in exactly one piece.

    A null or empty text is the end id alone. Repeated rows are packed each; null
    ids stay null; an empty table gives no rows; other columns are not read.
    Sequence ids are unique over all splits: each split counts from its own
    multiple of 2^40. A split is packed by itself, so a lost task is redone alone.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary: a fixed size
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, ids_of = arrow_schema(PIECES), words_of(shared.value).ids
        packer = Packer(window, TaskContext.get().partitionId() << 40)

        def out():
            if rows := packer.take():
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(own, ids_of(data.as_py()) + tail)
            yield from out()
        packer.join_open(final=True)
        yield from out()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).cast("binary").alias("_text"))
    return texts.mapInArrow(run, PIECES)
