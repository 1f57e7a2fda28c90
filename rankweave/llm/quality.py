"""A quality classifier from positives and unlabelled text.

Texts are described by style: shares of kinds of bytes and of kinds of words,
repetition, line shape. Each share is put into one of nine bins, and the model is
additive in the bins, so it can learn any threshold of any of them.

The risk is that of positive-unlabelled learning with the squared loss
l(z) = (1 - z)^2 / 4 and class prior c:

    c E_P[l(f)] + max(0, E_U[l(-f)] - c E_P[l(-f)])

where the second part, the risk on negatives, is never let below zero. For a model
linear in one-hot bins, every term is a quadratic form in the counts of bins and of
pairs of bins, among the positives and among the unlabelled. One pass over all texts
gathers these counts; they are whole numbers, so the model does not depend on how
rows were split. The risk is then minimised on the counts alone.

The prior comes from the same counts: with r the best additive estimate of the
density ratio positive : unlabelled, c = 1 / E_P[r] (matching under the Pearson
divergence). Negative labels are not used at all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from rankweave.llm.common import arrow_schema, whole

BINS = 9
#: Byte classes; every byte is in one.
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "bang", "bar", "symbol",
           "bracket", "quote", "other", "high", "control")
WORDS = ("capitals", "with_symbol", "bang_end", "bare_symbols", "short", "long", "mean_length", "repeated_words",
         "repeated_triples", "doubled_words", "top_word", "repeated_lines", "line_ends", "line_length", "length")
FEATURES = (*CLASSES, *WORDS)
DIM = len(FEATURES) * BINS
#: A posterior of 0.3 has score 0.3, one of 0.5 has score 0.5.
STEEPNESS = np.log(7 / 3) / 0.4


def _classes() -> np.ndarray:
    of = np.full(256, CLASSES.index("other"), dtype=np.uint8)
    of[128:] = CLASSES.index("high")
    of[:32] = CLASSES.index("control")
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"),
                        ("space", " \t"), ("newline", "\n\r"), ("stop", "."), ("comma", ",;:"), ("bang", "!?"), ("bar", "|"),
                        ("symbol", "#$%&*+=<>@\\^_`~/"), ("bracket", "()[]{}"), ("quote", "\"'")):
        of[list(chars.encode())] = CLASSES.index(name)
    return of


CLASS_OF = _classes()
SYMBOLS = b"#$%&*+=<>@\\^_`~/|"
NO_SYMBOLS = bytes.maketrans(SYMBOLS, b"#" * len(SYMBOLS))


def shares(data: bytes) -> list[float]:
    """The features of a UTF-8 text as numbers from 0 to 1; all 0 for an empty one."""
    if not data:
        return [0.0] * len(FEATURES)
    n = len(data)
    of = np.bincount(CLASS_OF[np.frombuffer(data, np.uint8)], minlength=len(CLASSES)) / n
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    w, k = max(len(words), 1), max(len(lines), 1)
    marked = data.translate(NO_SYMBOLS).split()
    triples = max(len(words) - 2, 1)
    distinct = set(words)
    top = Counter(words).most_common(1)[0][1] if words else 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [*of,
            sum(map(bytes.isupper, words)) / w,
            sum(b"#" in x for x in marked) / w,
            sum(x.endswith((b"!", b"?")) for x in words) / w,
            sum(not x.strip(b"#") for x in marked) / w,
            (lengths <= 3).sum() / w,
            (lengths >= 12).sum() / w,
            min(1.0, n / w / 64),
            (1 - len(distinct) / w) * min(1.0, 50 / w),
            1 - len(set(zip(words, words[1:], words[2:]))) / triples if len(words) > 2 else 0.0,
            sum(map(eq, words, words[1:])) / w,
            top / w,
            1 - len(set(lines)) / k,
            sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / k,
            min(1.0, n / k / 4096),
            min(1.0, np.log2(n + 1) / 24)]


def codes(data: bytes) -> bytes:
    """The bin of every feature; bins widen with the share."""
    x = np.array(shares(data))
    return np.minimum(np.log2(x * 255 + 1), BINS - 1).astype(np.uint8).tobytes()


@F.pandas_udf(BinaryType())
def codes_of(texts: pd.Series) -> pd.Series:
    return texts.map(codes)


def held_out(id_column: Column, folds: int = 5) -> Column:
    """crc32 of the id as text has remainder 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == 0


def one_hot(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), DIM), dtype=np.float32)
    out[np.arange(len(rows))[:, None], rows + np.arange(0, DIM, BINS)] = 1
    return out


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trusted, codes) -> kind, i, j, n: how many rows have bins i and j; kind 1 counts positives only."""
    total = np.zeros((2, DIM, DIM), dtype=np.int64)
    for batch in batches:
        trusted = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, len(FEATURES)).astype(np.int64)
        for s in range(0, len(rows), 4096):
            x, p = one_hot(rows[s:s + 4096]), trusted[s:s + 4096]
            total[0] += (x.T @ x).astype(np.int64)
            total[1] += (x[p].T @ x[p]).astype(np.int64)
    kind, i, j = np.nonzero(np.triu(total))
    if len(i):
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[kind, i, j])],
            schema=arrow_schema("kind int, i int, j int, n long"))


def minimise_risk(unlabelled: np.ndarray, positive: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights of the bins and the class prior, from pair counts (the diagonals are bin counts)."""
    nu, npos = unlabelled.diagonal()[:BINS].sum(), positive.diagonal()[:BINS].sum()
    if not nu or not npos:  # nothing to learn from: an even score
        return np.zeros(DIM), 0.5
    gu, gp = unlabelled / nu, positive / npos
    mu, mp = gu.diagonal().copy(), gp.diagonal().copy()
    inverse = np.linalg.inv(gu + ridge * np.eye(DIM))
    prior = float(min(1.0, 1.0 / max(mp @ inverse @ mp, 1.0)))

    def negative_risk(w):  # E_U[(1 + f)^2] - c E_P[(1 + f)^2], up to the factor of the loss
        return (1 + 2 * w @ mu + w @ gu @ w) - prior * (1 + 2 * w @ mp + w @ gp @ w)

    def negative_slope(w):
        return 2 * (mu + gu @ w) - prior * 2 * (mp + gp @ w)

    def risk(w):
        return prior * (1 - 2 * w @ mp + w @ gp @ w) + max(0.0, negative_risk(w)) + ridge * w @ w

    w = inverse @ (2 * prior * mp - mu)  # where the unbounded risk is least
    best, least = w, risk(w)
    for t in range(steps if negative_risk(w) < 0 else 0):
        slope = -negative_slope(w) if negative_risk(w) < 0 else (
            prior * 2 * (gp @ w - mp) + negative_slope(w) + 2 * ridge * w)
        w = w - 0.2 / (1 + t) ** 0.5 * inverse @ slope
        if risk(w) < least:
            best, least = w, risk(w)
    return best, prior


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Weights and class prior. Held-out rows take no part, neither labels nor texts.

    Trusted positives are documents all of whose labels are 1; the unlabelled are all
    documents, whatever their labels. Labels that are null or belong to no document
    are ignored.
    """
    described = docs.filter(~held_out(F.col(id_col))).select(
        F.col(id_col).alias("_id"), codes_of(whole(F.col(text_col)).cast("binary")).alias("_codes"))
    good = labels.filter(~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(
        F.min(F.col(label_col)).alias("_label")).filter("_label = 1")
    rows = described.join(good, "_id", "left").select(F.col("_label").isNotNull().alias("trusted"), "_codes")
    counts = rows.mapInArrow(_pair_counts, "kind int, i int, j int, n long").groupBy("kind", "i", "j").agg(F.sum("n").alias("n"))
    total = np.zeros((2, DIM, DIM))
    for r in counts.collect():  # at most DIM x (DIM + 1) rows
        total[r["kind"], r["i"], r["j"]] = total[r["kind"], r["j"], r["i"]] = r["n"]
    return minimise_risk(*total)


def scorer(weights: np.ndarray):
    """A column function: text -> score from 0 to 1."""
    table = weights.reshape(len(FEATURES), BINS)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        rows = np.frombuffer(b"".join(map(codes, texts)), np.uint8).reshape(-1, len(FEATURES))
        f = table[np.arange(len(FEATURES)), rows].sum(axis=1)
        return pd.Series(1 / (1 + np.exp(-STEEPNESS * np.clip(f, -4, 4))))

    return lambda text: score(whole(text).cast("binary"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted of every whole text.

    Null and empty texts are scored by the model like others; repeated rows and null
    ids too. Without documents or positives to learn from every score is 0.5. Only id
    and text are read.
    """
    weights, _ = fit(docs, labels, id_col, text_col, label_col)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), scorer(weights)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns."""
    weights, _ = fit(docs.select(id_col, text_col), labels, id_col, text_col, label_col)
    return docs.filter(scorer(weights)(F.col(text_col)) >= threshold)
