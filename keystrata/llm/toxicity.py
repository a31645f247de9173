"""Toxic passages: maximum-scoring segments over token log-odds.

Log-odds of a token come from how many toxic and clean training documents hold
it, with Dirichlet priors: a word's prior is what its first six characters say,
theirs what the first four say, and theirs the classes' shares, so forms never
seen lean on their stem.  Less a drift, scores are negative on average in clean
text, and one linear scan finds every maximal segment (each run of tokens whose
total no extension or part improves).  Segment scores of clean text follow an
extreme-value law whose scale is the positive root of E[exp(scale * score)] = 1
and whose size constant is fitted to clean training documents; with it a
segment's score becomes an expected number of such segments in a text of that
length.  A document's significant segments are added up and calibrated to a
probability by a monotone fit on the training rows.

The model is fitted on at most ``SAMPLE`` labelled rows of each label (a hash of
the id chooses, evenly over all labelled rows); scoring reads whole texts.

Defined results: null, blank and unknown texts get the score of a text without
a segment; a document with two labels is toxic if one says so; null labels and
labels without an id are left out; rows that repeat are each scored; without
training rows of both labels every score is 0; an empty table gives an empty
result; very long texts take time and memory in proportion; of the documents
only ``doc_id`` and ``text`` are read, and a filter keeps all columns as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_texts, materialize, remainder
from .calibration import isotonic

#: Labelled rows of each label that the fit reads, about.
SAMPLE = 12_000
#: Strength of each Dirichlet prior, in documents.
PRIOR = 2.0
#: Subtracted from every token's log-odds.
DRIFT = 0.35
#: A word scores again after so many other tokens.
ECHO = 32
#: Words whose scores a worker keeps at hand.
MEMO = 200_000
#: Tokens whose log-odds are closer to those of an unknown token are not kept.
LEAST = 0.25
THRESHOLD = 0.3


def tokens(text: str | None) -> list[str]:
    """Lower-cased words without marks at their ends."""
    return [w.strip(".,;:!?\"'()[]{}*#$%&|<>") for w in text.lower().split()] if text else []


def sample_labels(docs: DataFrame, labels: DataFrame, label: str, modulus: int, out: int, size: int) -> DataFrame:
    """``doc_id, label, weight`` of about ``size`` training rows of each label at most, evenly spread.

    ``weight`` is the number of rows that a sampled row stands for.  The sample's size is bounded, so it may be broadcast.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != out)).groupBy("doc_id").agg(F.max(label).alias("label"))
    share, weight = F.lit(0), F.lit(1.0)
    for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect():
        share = F.when(F.col("label") == r.label, F.lit(min(1 << 30, int((1 << 30) * size / r.n)))).otherwise(share)
        weight = F.when(F.col("label") == r.label, F.lit(max(1.0, r.n / size))).otherwise(weight)
    return rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id"), 34) < share).withColumn("weight", weight)


#: Lengths of the stems, shortest first; documents that a word or stem needs to have a weight of its own.
STEMS = (4, 5, 6)
LEAST_DOCS = 3


class _Memo(dict):
    """Scores of words met so far, of a bounded number of words."""

    def __init__(self, score):
        super().__init__()
        self.of = score

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        self[word] = found = self.of(word)
        return found


class Model:
    """Token scores, the extreme-value law and the calibration."""

    def __init__(self):
        self.scores: dict[str, float] = {}
        self.stems: list[dict[str, float]] = [{} for _ in STEMS]
        self.scale, self.size, self.curve = 1.0, 1.0, None
        self.memo: _Memo | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}

    def weigh(self, counts: dict[int, dict[str, tuple[int, int]]], totals: tuple[int, int]) -> None:
        """``counts``: by stem length (0: whole words) the clean and toxic documents that hold a word; ``totals``: all such pairs."""
        base = totals[1] / sum(totals)
        odds = lambda p: math.log(p / (1 - p)) - math.log(base / (1 - base))
        shares: dict[str, float] = {}

        def above(word: str) -> float:
            return next((shares[word[:n]] for n in reversed(STEMS) if n <= len(word) and word[:n] in shares), base)

        for n in STEMS:
            shares.update({s: (b + PRIOR * p) / (a + b + PRIOR) for s, (a, b) in counts[n].items() if len(s) == n for p in (above(s),)})
        self.stems = [{s: odds(p) for s, p in shares.items() if len(s) == n} for n in STEMS]
        words = {w: odds((b + PRIOR * p) / (a + b + PRIOR)) for w, (a, b) in counts[0].items() for p in (above(w),)}
        self.scores = {w: x for w, x in words.items() if abs(x - self._stem(w)) >= LEAST}

    def _stem(self, word: str) -> float:
        for n, held in zip(reversed(STEMS), reversed(self.stems), strict=True):
            if len(word) >= n and word[:n] in held:
                return held[word[:n]]
        return 0.0

    def score(self, toks: list[str]) -> np.ndarray:
        if self.memo is None:
            self.memo = _Memo(lambda w: self.scores[w] if w in self.scores else self._stem(w))
        out = np.fromiter(map(self.memo.__getitem__, toks), float, len(toks)) - DRIFT
        # A word that was there a moment ago says nothing new: repetition is no evidence.
        for i in np.flatnonzero(out > 0).tolist():
            if toks[i] in toks[max(0, i - ECHO) : i]:
                out[i] = -DRIFT
        return out

    def law(self, values: np.ndarray, counts: np.ndarray, best: np.ndarray, lengths: np.ndarray) -> None:
        """Scale from the scores of clean text and how often they occur; size constant from its texts' best segments."""
        if not len(values) or values.max() <= 0 or (values * counts).sum() >= 0:
            return
        share = counts / counts.sum()
        low, high = 0.0, 1.0
        with np.errstate(over="ignore"):
            while (share * np.exp(high * values)).sum() < 1 and high < 64:
                high *= 2
            for _ in range(50):
                mid = (low + high) / 2
                low, high = (mid, high) if (share * np.exp(mid * values)).sum() < 1 else (low, mid)
        self.scale = max(high, 1e-3)
        # The mean of length * exp(-scale * best) is 1 / size for a Gumbel law of maxima.
        self.size = 1 / max(float((lengths * np.exp(-self.scale * best)).mean()), 1e-9)

    def passages(self, toks: list[str]) -> list[tuple[int, int, float, float]]:
        """Begin, end, score and expected number by chance of every segment expected less than once."""
        n = len(toks)
        out = []
        for s, a, b in segments(self.score(toks)):
            expected = self.size * n * math.exp(-self.scale * s)
            if expected < 1:
                out.append((a, b, s, expected))
        return out

    def raw(self, toks: list[str]) -> float:
        """Sum of -ln of what chance gives, over a document's significant segments."""
        return sum(-math.log(max(e, 1e-300)) for *_, e in self.passages(toks))

    def probability(self, toks: list[str]) -> float:
        return float(self.curve(self.raw(toks))) if self.curve else 0.0


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as score, begin, end, in time linear in the tokens.

    One pass looks at tokens of positive score only.  Each candidate keeps the running sum before and after it and the
    place of the nearest earlier candidate that began lower; a new one follows these places back to its own, which skips
    each candidate once at most, and joins it if that one ended lower too.
    """
    where = np.flatnonzero(scores > 0)
    after = np.cumsum(scores)[where]
    held: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, begin, end, place of the nearest that began lower
    for at, low, high in zip(where.tolist(), (after - scores[where]).tolist(), after.tolist(), strict=True):
        begin, back = at, len(held) - 1
        while back >= 0 and held[back][0] >= low:
            back = held[back][4]
        while back >= 0 and held[back][1] < high:
            low, _, begin, _, lower = held[back]
            del held[back:]
            back = lower
        held.append((low, high, begin, at + 1, back))
    return [(b - a, i, j) for a, b, i, j, _ in held]


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, out: int = 2) -> Model:
    """Learns from a bounded sample of labelled training rows: weights from two thirds, law and calibration from the rest.

    Only word counts, a histogram of scores and one row of numbers for each sampled document come to the driver.
    """
    spark, model = docs.sparkSession, Model()
    chosen = sample_labels(docs, labels, "toxic", modulus, out, SAMPLE)
    ids = chosen.select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("label"), "weight")
    third = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(3)) == 0
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    rows = materialize(rows.select("text", "label", "weight", third.alias("third")), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[label > 0].update(set(tokens(text)))
        for label, words in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()), pa.array([label] * len(words), pa.int32())], ["word", "n", "label"])

    parts = rows.where("not third").select("text", "label").mapInArrow(count, "word string, n bigint, label int")
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    words = materialize(parts.groupBy("word").agg(of(0).alias("clean"), of(1).alias("toxic")), "toxic-words")
    totals = words.agg(F.sum("clean"), F.sum("toxic")).first()
    if not totals[0] or not totals[1]:
        return model
    counts = {}
    for n in (0, *STEMS):
        by = words if not n else words.where(F.length("word") >= n).groupBy(F.substring("word", 1, n).alias("word")).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        table = by.where(F.col("clean") + F.col("toxic") >= LEAST_DOCS).toArrow()
        counts[n] = dict(zip(table["word"].to_pylist(), zip(table["clean"].to_pylist(), table["toxic"].to_pylist(), strict=True), strict=True))
    model.weigh(counts, tuple(totals))
    sent = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: Counter = Counter()
        for batch in batches:
            best, size = [], []
            for text in batch.column(0).to_pylist():
                scores = sent.value.score(tokens(text))
                values, n = np.unique(np.round(scores, 2), return_counts=True)
                bins.update(dict(zip(values.tolist(), n.tolist(), strict=True)))
                best.append(max((s for s, _, _ in segments(scores)), default=0.0))
                size.append(float(len(scores)))
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(best)), pa.array(best, pa.float64()), pa.array(size, pa.float64())], ["bin", "x", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([True] * len(bins), pa.bool_()), pa.array(list(bins), pa.float64()), pa.array([float(n) for n in bins.values()], pa.float64())], ["bin", "x", "n"])

    seen = rows.where("third and label = 0").select("text").mapInArrow(measure, "bin boolean, x double, n double").toArrow()
    is_bin, x, n = (seen[c].to_numpy() for c in ("bin", "x", "n"))
    model.law(x[is_bin], n[is_bin], x[~is_bin & (n > 0)], n[~is_bin & (n > 0)])
    sent.destroy()
    sent = spark.sparkContext.broadcast(model)
    raws = map_texts(rows.where("third"), "label int, weight double, raw double", lambda t: (sent.value.raw(tokens(t)),), keep=("label", "weight")).toArrow()
    if raws.num_rows:
        model.curve = isotonic(raws["raw"].to_numpy(), raws["label"].to_numpy().astype(float), raws["weight"].to_numpy())
    sent.destroy()
    return model


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, out: int = 2) -> DataFrame:
    """One row per document: split, probability, verdict, and its toxic passages as token spans."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulus, out))
    kind = dict(docs.dtypes)["doc_id"]

    def one(text: str | None) -> tuple:
        toks = tokens(text)
        found = model.value.passages(toks)
        raw = sum(-math.log(max(e, 1e-300)) for *_, e in found)
        return (float(model.value.curve(raw)) if model.value.curve else 0.0, len(found), ",".join(f"{a}:{b}" for a, b, *_ in found))

    rows = map_texts(docs, f"doc_id {kind}, score double, n_passages bigint, passages string", one)
    return rows.select("doc_id", (remainder("doc_id", modulus) == out).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_passages", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without documents whose probability reaches ``threshold``; one pass, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.value.probability(tokens(t)) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
