"""Substring deduplication by content-defined chunks.

A gear hash rolls over the text's UTF-8 bytes; a chunk ends where the hash's low
bits are zero, within a least and a most size, so where chunks end depends on
the text nearby only and an insertion moves the cuts around it, not those after
it.  Chunks are told apart by 64-bit digests.  A chunk that another document has
too is repeated, and a run of two or more repeated chunks is a passage, so one
chance collision makes none.

Digests are counted before they are joined, and only those that occur in two
documents travel back; the places of a digest that very many share are dealt
over several tasks.

Defined results: null and empty texts have no chunks; a text shorter than the
least size is one chunk; chunks that only one document has, however often, are
not repeated; rows of one doc_id are one document, whose different texts keep
their chunks apart (by 19 bits of the text's hash and the chunks' digests) and
whose equal texts count once; rows without an id are in no result; very long
texts are hashed in pieces; only ``doc_id`` and ``text`` are read, so other
columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize, split_join

#: Chunk sizes in bytes: no cut before LEAST, a cut in one of 2**BITS places after it, and one at MOST at the latest.
LEAST, BITS, MOST = 16, 4, 96
#: Words and chunks that a passage of repeated chunks needs.
LEAST_WORDS, LEAST_CHUNKS = 20, 2
#: Bits of a place: a chunk's words, its code points, where it begins, and the text among those of its id.
WORD_BITS, SIZE_BITS, BEGIN_BITS, TEXT_BITS = 6, 7, 31, 19
_PIECE = 1 << 20


def _gear(seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, np.uint32)


GEAR = _gear()
_REACH = 16


def places(raw: np.ndarray) -> np.ndarray:
    """Where a chunk may end: the gear hash of the last ``_REACH`` bytes has ``BITS`` zero bits.

    The hash of each place is put together from those of half its length, and the bits looked at are the oldest
    byte's lowest upwards, which all bytes of the reach have moved.
    """
    out = []
    for at in range(0, len(raw), _PIECE):
        lead = min(at, _REACH - 1)
        h = GEAR[raw[at - lead : at + _PIECE]]
        step = 1
        while step < _REACH:
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h, step = more, step * 2
        out.append(np.flatnonzero((h[lead:] >> np.uint32(_REACH - 1)) & np.uint32((1 << BITS) - 1) == 0) + at + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cuts(raw: bytes) -> list[int]:
    """Ends of a text's chunks.  No cut falls inside a character."""
    n = len(raw)
    data = np.frombuffer(raw, np.uint8)
    ends, last, out = places(data).tolist(), 0, []
    for p in [*ends, n]:
        while p - last > MOST:
            cut = last + MOST
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(cut)
            last = cut
        if p - last >= LEAST and (p == n or raw[p] & 0xC0 != 0x80):
            out.append(p)
            last = p
    if last < n:
        if out and n - last < LEAST:
            out[-1] = n
        else:
            out.append(n)
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, at, digest`` of every chunk; ``at`` packs which of the id's texts holds it, where it begins, its length and its words."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                row, places, made = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    if not text:
                        continue
                    raw = text.encode("utf-8", "surrogatepass")
                    ends = cuts(raw)
                    data = np.frombuffer(raw, np.uint8)
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    space = (data == 32) | ((data >= 9) & (data <= 13))
                    starts = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
                    edges = np.array([0, *ends])
                    begin = points[edges[:-1]] | (digest(raw) >> 64 - TEXT_BITS) << BEGIN_BITS
                    size, words = points[edges[1:]] - points[edges[:-1]], starts[edges[1:]] - starts[edges[:-1]]
                    places.append(((begin << SIZE_BITS) | size) << WORD_BITS | words)
                    row.append(np.full(len(ends), i, np.int32))
                    made += [digest(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                put = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(put(row, np.int32))), pa.array(put(places, np.int64)), pa.array(np.array(made, np.uint64).view(np.int64))], ["doc_id", "at", "digest"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, at bigint, digest bigint")


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, which, begin, end, words, first_doc`` of the chunks that two documents or more have, by document.

    The chunks are cut twice, which costs less than keeping them: once to count digests, summed before they are
    shuffled, and once to be joined with the digests of several documents.
    """
    each = chunks(docs)
    counts = each.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last"), F.count("*").alias("places"))
    shared = materialize(counts.where("first_doc < last").drop("last"), "digests")
    field = lambda skip, bits: F.shiftright("at", skip).bitwiseAND(F.lit((1 << bits) - 1))
    low = WORD_BITS + SIZE_BITS
    rows = split_join(each, shared, ["digest"], "places", F.xxhash64("doc_id", "at")).withColumn("which", field(low + BEGIN_BITS, TEXT_BITS))
    rows = rows.repartition("doc_id", "which").dropDuplicates(["doc_id", "which", "at", "digest"])
    begin = field(low, BEGIN_BITS)
    return rows.select("doc_id", "which", begin.alias("begin"), (begin + field(WORD_BITS, SIZE_BITS)).alias("end"), field(0, WORD_BITS).alias("words"), "first_doc")


def passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per passage: a run of ``LEAST_CHUNKS`` repeated chunks or more of one text with ``least_words`` words or more."""
    order = Window.partitionBy("doc_id", "which").orderBy("begin", "end")
    rows = repeated(docs).withColumn("fresh", (F.col("begin") != F.coalesce(F.lag("end").over(order), F.lit(-1))).cast("int"))
    rows = rows.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("doc_id", "which", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("first_doc").alias("first_doc"), F.count("*").alias("chunks"))
    return runs.where((F.col("words") >= least_words) & (F.col("chunks") >= LEAST_CHUNKS)).drop("run")


def repeated_documents(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document that holds a repeated passage: how many, their words and characters, their spans, and the
    least id of a document that shares one of their chunks."""
    spans = F.transform(F.sort_array(F.collect_list(F.struct("begin", "end"))), lambda x: F.concat_ws(":", x["begin"].cast("string"), x["end"].cast("string")))
    return passages(docs, least_words).groupBy("doc_id").agg(F.count("*").alias("n_passages"), F.sum("words").alias("repeated_words"), F.sum(F.col("end") - F.col("begin")).alias("repeated_chars"), F.min("first_doc").alias("first_doc"), F.concat_ws(",", spans).alias("spans"))
