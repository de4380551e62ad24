"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairs cost no more
than the single terms: sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2.

x holds the square roots of the hashed words' shares of the text, and statistics of the text's
structure and size. It is made batch by batch from whole texts. The model is a few hundred
kilobytes whatever the corpus; it is fitted on a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hetweave.llm.common import add_column, free_name, pieces, small_batches, text_buffer
from hetweave.llm.words import find_words, hash_words

WORD_BITS = 11
N_WORDS = 1 << WORD_BITS
PIECE_BYTES = 2 << 20
PIECE_ROWS = 256
STATISTICS = ("log_chars", "log_words", "chars_a_word", "upper", "digits", "space", "ascii_marks", "odd_marks", "ends", "bars", "lines", "not_ascii", "distinct", "top_word", "next_same", "no_words", "few_words")
N_FEATURES = N_WORDS + len(STATISTICS)
_ODD = np.isin(np.arange(256), np.frombuffer(b"!#$%&*<>=@\\^_`{}~[]+/", np.uint8))
_ENDS = np.isin(np.arange(256), np.frombuffer(b".,;:?", np.uint8))


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One float32 row of N_FEATURES for each text; a text without words has zero shares."""
    n = len(offsets) - 1
    data, starts, ends, before = find_words(raw, offsets)
    counts, size = np.diff(before), np.diff(offsets).astype(np.float64)
    row = np.repeat(np.arange(n), counts)
    bucket = (hash_words(data, starts, ends) & np.uint64(N_WORDS - 1)).astype(np.int64)
    shares = np.bincount(row * N_WORDS + bucket, minlength=n * N_WORDS).reshape(n, N_WORDS).astype(np.float32)
    words = np.maximum(counts, 1)
    distinct = (shares > 0).sum(axis=1) / np.minimum(words, N_WORDS)
    shares /= words[:, None]
    same = np.zeros(len(bucket), bool)
    same[1:] = (bucket[1:] == bucket[:-1]) & (row[1:] == row[:-1])
    bytes_ = np.maximum(size, 1)
    chars = _per_row((raw & 0xC0) != 0x80, offsets)
    letters = _per_row((data >= 97) & (data <= 122), offsets)
    part = lambda mask: _per_row(mask, offsets) / bytes_
    stats = [
        np.log1p(chars) / 10,
        np.log1p(counts) / 10,
        np.minimum(np.bincount(row, ends - starts, n) / words, 20) / 10,
        _per_row((raw >= 65) & (raw <= 90), offsets) / np.maximum(letters, 1),
        part((raw >= 48) & (raw <= 57)) * 5,
        part((raw == 32) | ((raw >= 9) & (raw <= 13))) * 3,
        part((raw > 32) & (raw < 127) & ~((raw >= 48) & (raw <= 57)) & ~((data >= 97) & (data <= 122))) * 3,
        np.minimum(part(_ODD[raw]) * 10, 2),
        part(_ENDS[raw]) * 10,
        np.minimum(part(raw == 124) * 10, 2),
        np.minimum(part(raw == 10) * 20, 2),
        part(raw >= 128),
        distinct,
        shares.max(axis=1) if n else np.zeros(0),
        np.bincount(row, same, n) / words,
        counts == 0,
        counts < 5,
    ]
    return np.concatenate((np.sqrt(shares), np.stack(stats, axis=1).astype(np.float32)), axis=1)


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) * self.scale
        pairs = ((x @ self.factors) ** 2).sum(axis=1) - (x**2) @ (self.factors**2).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.weights + pairs / 2, -30, 30).astype(np.float64)))


class PackedRows:
    """Rows of features as the executors packed them, made dense only where they are asked for."""

    def __init__(self, packed: list[bytes]) -> None:
        self.packed = packed

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), N_FEATURES), np.float32)
        for k, row in enumerate(rows.tolist()):
            where, values = np.frombuffer(self.packed[row], "<i4").reshape(2, -1)
            x[k, where] = values.view("<f4")
        return x


def fit(x: np.ndarray | PackedRows, y: np.ndarray, *, rank: int = 4, epochs: int = 25, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """Adam on the logistic loss, in a fixed order; the statistics are centred and scaled.

    Rows are taken 128 at a time, so the driver never holds them all as dense numbers.
    Without rows, or with one class only, the score is the share of label 1 (0.5 without rows).
    """
    rng = np.random.default_rng(seed)
    mean, scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(y):
        tail = np.concatenate([x[np.arange(k, min(k + 128, len(y)))][:, N_WORDS:] for k in range(0, len(y), 128)])
        mean[N_WORDS:] = tail.mean(axis=0)
        scale[N_WORDS:] = 1 / np.maximum(tail.std(axis=0), 0.02)
    model = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(N_FEATURES, np.float32), np.zeros((N_FEATURES, rank), np.float32), mean, scale)
    if len(set(y.tolist())) < 2:
        return model
    theta = [np.full(1, model.bias, np.float32), model.weights, rng.normal(0, 0.02, (N_FEATURES, rank)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 128):
            rows = order[k : k + 128]
            xs, step = (x[rows] - mean) * scale, step + 1
            b, w, v = theta
            inner, squares = xs @ v, xs**2
            z = b[0] + xs @ w + ((inner**2).sum(axis=1) - squares @ (v**2).sum(axis=1)) / 2
            off = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            grads = [np.array([off.sum()], np.float32), xs.T @ off + decay * w, xs.T @ (off[:, None] * inner) - (squares.T @ off)[:, None] * v + decay * v]
            for p, g, m, s in zip(theta, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return FactorisationMachine(float(theta[0][0]), theta[1], theta[2], mean, scale)


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 8000, **options) -> FactorisationMachine:
    """Fit on the labelled rows of least hash, max_rows at most.

    labels has (doc_id, label). Null ids and labels are ignored; of several labels of an id the
    least counts. The ids are few enough to broadcast by their bound; the features are made on
    the executors, and a row of them is N_FEATURES pairs at most, so what the driver gathers
    has a bound that max_rows sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg(F.min(F.col(label)).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("i"), "i").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(known), "i").select("i", "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, x in _featured(whole, "t"):
                full = [np.concatenate((where := np.flatnonzero(r).astype("<i4"), r[where].astype("<f4").view("<i4"))).tobytes() for r in x]
                yield add_column(batch.select(["i", "y"]), "x", pa.array(full, pa.binary()))

    kind = T.StructType([*rows.select("i", "y").schema.fields, T.StructField("x", T.BinaryType())])
    got = sorted(((str(r.i), r.y, bytes(r.x)) for r in rows.mapInArrow(run, kind).collect()), key=lambda r: r[0])
    got = list({r[0]: r for r in got}.values())  # repeated rows of an id count once
    return fit(PackedRows([r[2] for r in got]), np.array([r[1] for r in got], np.float32), **options)


def _featured(whole: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    _, sizes = text_buffer(whole.column(whole.schema.names.index(text)))
    for a, b in pieces(sizes, PIECE_BYTES):
        for c in range(a, b, PIECE_ROWS):
            batch = whole.slice(c, min(PIECE_ROWS, b - c))
            data, offsets = text_buffer(batch.column(batch.schema.names.index(text)))
            yield batch, features(data, offsets)


def with_scores(docs: DataFrame, model: FactorisationMachine, *, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a double column from 0 to 1, higher where label 1 is likelier; also its name.

    The score reads the text alone. Null and empty texts have the score of a text without words.
    All rows and columns pass through, repeated rows with equal scores.
    """
    small_batches(docs.sparkSession)
    name = free_name(docs, "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, x in _featured(whole, text):
                yield add_column(batch, name, pa.array(sent.value.score(x), pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def keep_good(docs: DataFrame, model: FactorisationMachine, *, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least `least`, with the columns of docs."""
    scored, name = with_scores(docs, model, text=text)
    return scored.where(F.col(name) >= least).drop(name)
