"""Quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over standardised document
statistics.  Each partition sums its part of the normal equations over all
labelled training rows, the sums are added by a tree of tasks, and one small
ridge system is solved.  Isotonic calibration over a histogram of all training scores
makes scores probabilities.

Defined results: null and blank texts have statistics of zero and are scored
like any other; null labels and labels without an id are left out, of two labels
the higher holds; rows that repeat, share an id or have none are each scored;
very long texts are read whole, in memory proportional to them; without training
rows of both labels every score is the share of label 1, or 0; an empty table
gives an empty result; of the documents only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_texts, materialize, remainder
from .calibration import isotonic
from .statistics import FEATURES, Meter

WIDTH = 256
GAMMA = 0.12
RIDGE = 1.0
BINS = 2000
#: Partial sums added by one task.
FAN = 16
THRESHOLD = 0.5


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: statistics of every text, written once; the texts are not read again."""
    kind = dict(docs.dtypes)["doc_id"]
    held: list[Meter] = []

    def one(text: str | None) -> tuple:
        if not held:
            held.append(Meter())
        return (np.array(held[0].features(text), np.float32),)

    return materialize(map_texts(docs, f"doc_id {kind}, x array<float>", one), "statistics")


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 17):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.spread = draw.normal(0, np.sqrt(2 * GAMMA), (FEATURES, WIDTH))
        self.phase = draw.uniform(0, 2 * np.pi, WIDTH)
        self.weights, self.curve = np.zeros(WIDTH + 1), None

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.spread + self.phase
        return np.hstack([np.cos(z) * np.sqrt(2 / WIDTH), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Ridge scores, held to the range of the histogram."""
        return np.clip(self.map(x) @ self.weights, -0.5, 1.5)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, FEATURES)


def _sum(df: DataFrame) -> list[float] | None:
    """Sums ``v``, an array of doubles on each row, element by element: groups of ``FAN`` partitions, then groups of
    those, until ``FAN`` rows at most come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0):
                x = v.values.to_numpy()
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    n = df.rdd.getNumPartitions()
    while True:
        n = max(1, -(-n // FAN))
        df = df.repartition(n).mapInArrow(add, "v array<double>")
        if n <= FAN:
            break
    rows = [np.array(r.v) for r in df.collect()]
    return np.sum(rows, 0).tolist() if rows else None


def fit(stats: DataFrame, labels: DataFrame, modulus: int = 3, out: int = 1) -> Model:
    """Learns from all labelled training rows."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != out)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = materialize(stats.join(known, "doc_id").select("x", F.col("y").cast("double").alias("y")), "labelled")
    names = ["n", "y", *(f"m{i}" for i in range(FEATURES)), *(f"s{i}" for i in range(FEATURES))]
    sums = rows.agg(F.count("*"), F.avg("y"), *(F.avg(F.col("x")[i]) for i in range(FEATURES)), *(F.stddev_pop(F.col("x")[i]) for i in range(FEATURES))).toDF(*names).first()
    mean = np.array([sums[f"m{i}"] or 0 for i in range(FEATURES)])
    scale = np.array([max(sums[f"s{i}"] or 0, 1e-3) for i in range(FEATURES)])
    model = Model(mean, scale)
    if not sums.n or not 0 < sums.y < 1:
        model.weights[-1] = sums.y or 0.0
        return model
    context, d = stats.sparkSession.sparkContext, WIDTH + 1
    sent = context.broadcast(model)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z, y = sent.value.map(_matrix(part.column(0))), part.column(1).to_numpy()
                left += z.T @ z
                right += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([left.ravel(), right])], pa.list_(pa.float64()))], ["v"])

    total = np.array(_sum(rows.mapInArrow(equations, "v array<double>")))
    ridge = RIDGE * np.eye(d)
    ridge[-1, -1] = 0
    model.weights = np.linalg.solve(total[: d * d].reshape(d, d) + ridge, total[d * d :])
    sent = context.broadcast(model)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((2, BINS + 1))
        for batch in batches:
            at = np.round((sent.value.raw(_matrix(batch.column(0))) + 0.5) / 2 * BINS).astype(int)
            bins += [np.bincount(at, minlength=BINS + 1), np.bincount(at, batch.column(1).to_numpy(), BINS + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([bins.ravel()], pa.list_(pa.float64()))], ["v"])

    n, ones = np.array(_sum(rows.mapInArrow(histogram, "v array<double>"))).reshape(2, -1)
    there = n > 0
    model.curve = isotonic(np.flatnonzero(there) / BINS * 2 - 0.5, ones[there] / n[there], n[there])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, out: int = 1) -> DataFrame:
    """One row per document: split, probability and verdict."""
    stats = measured(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, modulus, out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, x = model.value, _matrix(batch.column(1))
            scores = np.clip(m.curve(m.raw(x)) if m.curve else np.full(len(x), m.weights[-1]), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = stats.select("doc_id", "x").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return rows.select("doc_id", (remainder("doc_id", modulus) == out).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
