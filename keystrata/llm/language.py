"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of n-grams, of
lengths 1 to ``ORDER``, that both hold, over the root of the product of how many
each holds.  N-grams are over letters folded to 64 classes of UTF-8 bytes, so a
text's presence set has a fixed bound.  Nystroem landmarks, spread over the
languages, turn kernel values into features; one-versus-rest kernel ridge
regression gives a weight matrix, and texts are scored in batches by two matrix
products: presence by landmarks, landmarks by languages.

The fit uses about ``SAMPLE`` training rows of each language at most (a hash of
id and text chooses, and rows alike in both count once), and ``MOST_ROWS`` or so
of all; only their presence sets come to the driver.

Defined results: null texts and texts without a letter are ``und`` with score 0;
rows whose language is null teach nothing; without training rows every text is
``und``; ties go to the first language in order; rows that repeat, share an id
or have none are each scored; very long texts are read in pieces; an empty table
gives an empty result; only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import remainder

SAMPLE = 250
LANDMARKS = 48
#: Rows of all languages at most, about.
MOST_ROWS = 50_000
#: Landmarks of all languages at most.
MOST_LANDMARKS = 1024
RIDGE = 1e-3
ORDER = 3
#: A letter of any script; numbers such as fractions are none.
_LETTER = regex.compile(r"\p{L}")
_PIECE = 1 << 20


def _classes() -> np.ndarray:
    """Letters by themselves, white space, marks and digits as one class each, other bytes by six bits."""
    out = np.full(256, 27, np.uint8)
    for i in range(26):
        out[65 + i] = out[97 + i] = i
    out[[9, 10, 11, 12, 13, 32]] = 26
    out[48:58] = 28
    # Continuation bytes carry what tells letters apart; upper- and lower-case forms of Latin-1 share a class.
    for b in range(128, 256):
        out[b] = 29 + b % 32 if b < 192 else 61 + (b >= 208) + (b >= 224)
    return out


CLASSES = _classes()
_OFFSETS = (0, 64, 64 + 4096)
SPACE = 64 + 4096 + 262144


def presence(text: str) -> np.ndarray:
    """The numbers of the n-grams that a text holds, in order."""
    raw = CLASSES[np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)].astype(np.int32)
    seen = np.zeros(SPACE, bool)
    for at in range(0, len(raw), _PIECE):
        c = raw[at : at + _PIECE + ORDER - 1]
        seen[c] = True
        two = (c[:-1] << 6) + c[1:]
        seen[_OFFSETS[1] + two] = True
        seen[_OFFSETS[2] + (two[:-1] << 6) + c[2:]] = True
    return np.flatnonzero(seen).astype(np.int32)


class Model:
    """``column`` places n-grams that landmarks hold; ``landmarks`` is n-grams by landmarks, ``weights`` landmarks by languages."""

    def __init__(self, sets: list[np.ndarray], langs: list[str]):
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(self.langs)))
        chosen = [i for lang in self.langs for i in [j for j, x in enumerate(langs) if x == lang][:each]]
        grams = np.unique(np.concatenate([sets[i] for i in chosen]))
        self.column = np.full(SPACE, -1, np.int32)
        self.column[grams] = np.arange(len(grams), dtype=np.int32)
        self.landmarks = np.zeros((len(grams), len(chosen)), np.float32)
        for k, i in enumerate(chosen):
            self.landmarks[self.column[sets[i]], k] = len(sets[i]) ** -0.5
        every = self.kernel(sets)
        own = every[chosen].astype(float)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = np.hstack([every @ root, np.ones((len(sets), 1))])
        aim = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        # Languages weigh alike however many rows each has.
        share = np.array([1 / langs.count(x) for x in self.langs])[[self.langs.index(x) for x in langs]][:, None]
        solved = np.linalg.solve(features.T @ (share * features) + RIDGE * np.eye(features.shape[1]), features.T @ (share * aim))
        self.weights, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts with landmarks, a block of texts at a time."""
        out = np.zeros((len(sets), self.landmarks.shape[1]), np.float32)
        for at in range(0, len(sets), 128):
            block = np.zeros((min(128, len(sets) - at), len(self.landmarks)), np.float32)
            for k, s in enumerate(sets[at : at + 128]):
                cols = self.column[s]
                block[k, cols[cols >= 0]] = max(len(s), 1) ** -0.5
            out[at : at + 128] = block @ self.landmarks
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score; the score is the best language's share after a softmax of the margins."""
        there = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if there:
            margin = (self.kernel([presence(texts[i]) for i in there]) @ self.weights + self.bias).astype(float)
            odds = np.exp(4 * (margin - margin.max(1, keepdims=True)))
            best = margin.argmax(1)
            share = odds[np.arange(len(there)), best] / odds.sum(1)
            for i, b, s in zip(there, best, share, strict=True):
                langs[i], scores[i] = self.langs[b], float(s)
        return langs, scores


def fit(docs: DataFrame, modulus: int = 3, out: int = 1, size: int = SAMPLE) -> Model:
    """Learns from text and language of a bounded, evenly spread sample of training rows."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", modulus) != out))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    size = max(1, min(size, MOST_ROWS // max(1, counts.count())))
    counts = counts.select(F.col("lang").alias("of"), F.least(F.lit(1 << 30), F.floor(F.lit((1 << 30) * size) / F.col("n"))).alias("share"))
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id", "text"), 34)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [presence(t) if _LETTER.search(t) else np.zeros(0, np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["spread", "lang", "grams"])

    # One row for each language, as many as the model itself has to hold.
    chosen = rows.withColumn("spread", spread).join(F.broadcast(counts), F.col("lang") == F.col("of")).where("spread < share").select("spread", "lang", "text")
    chosen = chosen.groupBy("spread", "lang").agg(F.min("text").alias("text")).mapInArrow(sets, "spread bigint, lang string, grams array<int>")
    learnt = sorted(((r.spread, r.lang, np.array(r.grams, np.int32)) for r in chosen.collect() if r.grams), key=lambda x: (x[0], x[1], len(x[2])))
    return Model([x[2] for x in learnt], [x[1] for x in learnt])


def identify(docs: DataFrame, modulus: int = 3, out: int = 1) -> DataFrame:
    """One row per document: split, language and score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, modulus, out))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                langs, scores = model.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (remainder("doc_id", modulus) == out).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
