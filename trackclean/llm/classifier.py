"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

score = sigmoid(w0 + w.x + sum over pairs i < j of <v_i, v_j> x_i x_j); the pairs are summed in linear time as half the
sum over factors of (sum of v x)**2 - sum of v**2 x**2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import LOWER, SPACE, raw, word_hashes, word_spans
from .tokens import balanced

#: Hashed words have so many columns; factors are so many numbers for each column.
WORDS = 1024
FACTORS = 8
#: The classifier is fitted on at most so many labelled rows: those of the least hash of their doc_id.
SAMPLE = 4000
ROUNDS = 300
RATE = 0.03
DECAY = 1e-4
CUT = 0.7
SHAPES = ("lower", "upper", "digit", "space", "mark", "stop", "other")
_SHAPE = np.full(256, 6, np.uint8)
_SHAPE[SPACE] = 3
_SHAPE[0x61:0x7B], _SHAPE[0x41:0x5B], _SHAPE[0x30:0x3A] = 0, 1, 2
_SHAPE[list(b"!#*$%&|<>@=+/_~^{}[]\\`")] = 4
_SHAPE[list(b".,;:?'\"()-")] = 5
STATISTICS = len(SHAPES) + 6
COLUMNS = WORDS + STATISTICS


def features(column: pa.Array) -> np.ndarray:
    """A row of COLUMNS numbers for each text: root shares of its hashed words, shares of character classes, length,
    mean word and line length, shares of distinct words, distinct lines and the most frequent word."""
    buf, offsets = raw(column)
    n = len(offsets) - 1
    starts, ends, text = word_spans(buf, offsets)
    hashes = word_hashes(LOWER[buf], starts, ends)
    out = np.zeros((n, COLUMNS), np.float32)
    words = np.bincount(text, minlength=n).astype(np.float32)
    counts = np.bincount(text * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    out[:, :WORDS] = np.sqrt(counts / np.maximum(words, 1)[:, None])
    size = np.diff(offsets)
    of = np.repeat(np.arange(n), size)
    shapes = np.bincount(of * len(SHAPES) + _SHAPE[buf], minlength=n * len(SHAPES)).reshape(n, -1) / np.maximum(size, 1)[:, None]
    lines = np.bincount(of, weights=buf == 0x0A, minlength=n) + 1
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    distinct = np.bincount(t[new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    most = np.zeros(n)
    np.maximum.at(most, t[new], runs)
    one = np.maximum(words, 1)
    out[:, WORDS:] = np.column_stack([
        shapes, np.log1p(size) / 10, np.minimum((size / one) / 20, 2), np.log1p(words / lines) / 5,
        distinct / one, most / one, np.log1p(lines) / 5])
    return out


@dataclass
class Machine:
    """A fitted factorisation machine; centre and scale standardise the statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def prepared(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, WORDS:] = np.clip((x[:, WORDS:] - self.centre) / self.scale, -4, 4)
        return x

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = self.prepared(x)
        z = self.bias + x @ self.linear + 0.5 * ((x @ self.factors) ** 2 - (x * x) @ (self.factors**2)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, factors: int = FACTORS, seed: int = 7) -> Machine:
    """Fitted by Adam on the whole sample; both labels weigh half, so that scores do not follow their shares."""
    rng = np.random.default_rng(seed)
    stats = x[:, WORDS:]
    m = Machine(0.0, np.zeros(COLUMNS, np.float32), rng.normal(0, 0.02, (COLUMNS, factors)).astype(np.float32), stats.mean(axis=0) if len(x) else np.zeros(STATISTICS, np.float32), (stats.std(axis=0) if len(x) else np.zeros(STATISTICS, np.float32)) + 1e-3)
    if not len(x) or y.min() == y.max():
        m.bias = 0.0 if not len(x) else (2.0 if y[0] else -2.0)
        m.factors[:] = 0
        return m
    x = m.prepared(x)
    x2 = x * x
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)
    bias = np.zeros(1, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (bias, m.linear, m.factors)]
    for t in range(1, rounds + 1):
        xv = x @ m.factors
        z = bias[0] + x @ m.linear + 0.5 * (xv**2 - x2 @ (m.factors**2)).sum(axis=1)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grads = (g.sum(keepdims=True), x.T @ g + DECAY * m.linear, x.T @ (g[:, None] * xv) - m.factors * (x2.T @ g)[:, None] + DECAY * m.factors)
        for p, d, (a, b) in zip((bias, m.linear, m.factors), grads, state, strict=True):
            a *= 0.9
            a += 0.1 * d
            b *= 0.999
            b += 0.001 * d * d
            p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    m.bias = float(bias[0])
    return m


def is_held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine fitted on at most sample labelled doc_ids that are not held out; only their features reach the driver.

    Of a doc_id with several rows, the one whose features' bytes are least counts, so sample rows are gathered at most.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in balanced(big, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([f.tobytes() for f in features(batch.column("text"))], pa.binary())], ["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("x").alias("x"))
    got = got.toArrow().sort_by([("doc_id", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, COLUMNS)
    return fit(x, got.column("quality").to_numpy().astype(np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    Null and empty texts score as a text without words; equal texts score alike; with no labels, or one label only, all
    score the same; doc_ids labelled twice count as the lower label; other columns are ignored. lang, source and doc_id
    are no features.
    """
    machine = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in balanced(big, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(machine.scores(features(batch.column("text"))))], ["doc_id", "score"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return x.select("doc_id", is_held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
