"""Language-model scores by deleted interpolation.

P(w | uv) mixes the maximum-likelihood estimates c(uvw)/c(uv), c(vw)/c(v), c(w)/N
and the uniform 1/(V+1).  The weights depend on the bucket (binary order of
magnitude) of the pair's count, or of the word's where the pair is unseen, and
are learned by expectation-maximisation on held-out counts: each block of
documents is scored with the counts of all other blocks.  A text starts in the
context of two end tokens, which are counted once a text.

Counts are of all training documents.  Documents are taken in blocks; a block
sends each distinct n-gram once, as the sorted hash and its count in the
block, packed by hash range.  A range adds up its blocks' counts and answers
each block with what the others have, in the block's own order, so neither
n-grams nor occurrences travel twice and a frequent n-gram costs one entry a
block.  The block's documents meet these answers once; what scoring needs of
them is written, and the weights are applied to that.

A block is a run of rows of a file whose texts are of one order of length, the
shorter the run the longer the texts, so that no stretch of long texts makes a
block of over four times its size (but for a text that is longer by itself).
Blocks and ranges are of fixed size up to ``ROOT_FROM`` bytes of text and grow
with the root of the corpus from there, to ``MOST_GROWTH`` times that size.

Defined results: a null text is empty and has the end token only; without
training documents N and V are 0; rows that repeat, share an id or have none are
each counted and scored; a very long text is part of one block, in memory
proportional to it; an empty table gives an empty result; only ``doc_id`` and
``text`` are read.  Words are told apart by 64-bit hashes, pairs and triples by
56 bits.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, remainder, words_of

#: Bytes of text in a block, about, and in what a range receives.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 8 << 20
#: Bytes of text from where both grow, and how far.
ROOT_FROM, MOST_GROWTH = 16 << 30, 4
#: Tasks of a shuffle at most.
MOST_TASKS = 1 << 15
BUCKETS = 16
#: Steps of half a bit for the estimates of triples, pairs and words in the held-out histogram.
STEPS3, STEPS2, STEPS1 = 32, 32, 72
ROUNDS = 40
#: Bits that the hashes of words, pairs and triples do without.
SHIFTS = (np.uint64(0), np.uint64(8), np.uint64(8))
_END = xxhash.xxh3_64_intdigest(b"\x20end")


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed."""
    return zstandard.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(8, -1).T).view("<u8").ravel()


class Block:
    """The tokens of some texts, by place among the block's sorted distinct hashes of words, pairs and triples."""

    def __init__(self, texts: list[str | None], train: list[bool]):
        place: defaultdict = defaultdict()
        place.default_factory = place.__len__
        place[None]  # the end token is 0
        tokens, lengths = [], []
        for text in texts:
            ids = [place[w] for w in words_of(text)]
            ids.append(0)
            lengths.append(len(ids))
            tokens.append(np.array(ids, np.int32))
        del place[None]
        hashes = np.fromiter((_END, *map(xxhash.xxh3_64_intdigest, place)), np.uint64, len(place) + 1)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)[: len(lengths)]
        words, at = _distinct(hashes)
        self.end = int(at[0])
        word = at[np.concatenate(tokens)] if tokens else np.zeros(0, np.int32)
        del tokens, place
        hashes = words[word]
        pair = _mix(self.after(hashes, words[self.end]), hashes)
        first = _mix(words[[self.end]], words[[self.end]])[0]
        #: Distinct hashes of words, pairs and triples, and each token's place among them.
        self.grams = [(words, word), _distinct(pair), _distinct(_mix(self.after(pair, first), hashes))]
        self.train = np.repeat(np.array(train, bool), self.lengths)
        self.counts = [np.bincount(at[self.train], minlength=len(u)).astype(np.int64) for u, at in self.grams]

    def after(self, x: np.ndarray, first) -> np.ndarray:
        """The value of the token before; ``first`` where a text starts."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.starts] = first
        return out


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(hashes, return_inverse=True)
    return found, at.astype(np.int32)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of both, its last byte clear."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & ~np.uint64(0xFF)


def _blocks(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """``docs`` with ``__block`` and ``__class``, an order of length; about how many blocks and hash ranges there are.

    Blocks are rows of a class that lie together in a file.  The place in a file is the same whenever and however
    the file is read.  What isn't read from files, or has a column named as Spark names a row's place, is written first.
    """
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018
        own = "_metadata" in map(str.lower, docs.columns)
    except AnalysisException:
        own = True
    if own:
        docs = materialize(docs.select("doc_id", "text"), "documents")
    n, total = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    total = total or 0
    growth = min(max(math.sqrt(total / ROOT_FROM), 1.0), MOST_GROWTH)
    rows = max(1, min(1 << 16, n // 8 + 1, int(growth * BLOCK_BYTES * n / max(total, 1))))
    # Texts of up to 4 times the average are in class 0, up to 16 times in class 1, in runs of a quarter of the rows.
    last = math.ceil(math.log(rows, 4))
    length = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)) / max(total / max(n, 1), 1.0), F.lit(1.0))
    order = F.least(F.greatest(F.ceil(F.log2(length) / 2) - 1, F.lit(0)), F.lit(last)).cast("int")
    run = F.greatest(F.floor(F.lit(rows) / F.pow(F.lit(4.0), F.col("__class"))), F.lit(1))
    block = F.xxhash64(F.col("_metadata.file_path"), F.col("__class"), F.floor(F.col("_metadata.row_index") / run))
    made = docs.withColumn("__class", order).withColumn("__block", block)
    return made, n // rows + 1, max(1, int(total / (growth * RANGE_BYTES)))


def _send(ranges: int, most: int):
    """Packs the n-grams of each block that lies in a partition; what is held at once has ``most`` characters or so."""

    def blobs(block: int, texts: list, train: list) -> pa.RecordBatch:
        b = Block(texts, train)
        out: list[list] = [[], [], [], [], []]
        for kind, ((hashes, _), counts) in enumerate(zip(b.grams, b.counts, strict=True)):
            of = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
            steps = hashes >> SHIFTS[kind]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for column, x in zip(out, (block, kind, int(of[lo]), pack(np.diff(steps[lo:hi], prepend=np.uint64(0))), pack(counts[lo:hi])), strict=True):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())], ["block", "kind", "r", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list, list]] = {}
        size = 0
        for batch in batches:
            for block, order, text, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if order in held and held[order][0] != block:
                    done = held.pop(order)
                    size -= sum(len(x or "") for x in done[1])
                    yield blobs(*done)
                _, texts, train = held.setdefault(order, (block, [], []))
                texts.append(text)
                train.append(t)
                size += len(text or "")
                if size > most:
                    # The rest of these blocks is sent apart.
                    for k in list(held):
                        yield blobs(*held.pop(k))
                    size = 0
        for done in held.values():
            yield blobs(*done)

    return run


_ANSWER = "block bigint, kind int, r bigint, others binary, types bigint, tokens bigint"


def _answer(table: pa.Table) -> pa.Table:
    """For one range: the counts that other blocks have of each block's n-grams, and the range's totals."""
    r = table["r"][0].as_py()
    out: list[tuple] = []
    for kind, shift in enumerate(SHIFTS):
        some = table.filter(pc.equal(table["kind"], kind))
        mine = list(zip(*(some[x].to_pylist() for x in ("block", "hashes", "counts")), strict=True))
        if not mine:
            continue
        hashes = [np.cumsum(unpack(h), dtype=np.uint64) << shift for _, h, _ in mine]
        counts = [unpack(c).astype(np.int64) for *_, c in mine]
        every, at = np.unique(np.concatenate(hashes), return_inverse=True)
        own = np.concatenate(counts)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, at, own)
        out.append((None, kind, r, None, int((total > 0).sum()), int(total.sum())))
        cuts = np.cumsum([0, *map(len, hashes)])
        places: dict[int, list[int]] = {}
        for i, (b, *_) in enumerate(mine):
            places.setdefault(b, []).append(i)
        for b, parts in places.items():
            # A block that lies in two partitions sends twice; its order is that of the sorted union.
            spot = np.concatenate([at[cuts[i] : cuts[i + 1]] for i in parts])
            n = np.concatenate([own[cuts[i] : cuts[i + 1]] for i in parts])
            spots, back = np.unique(spot, return_inverse=True)
            local = np.zeros(len(spots), np.int64)
            np.add.at(local, back, n)
            out.append((b, kind, r, pack(total[spots] - local), 0, 0))
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["block", "kind", "r", "others", "types", "tokens"])


def bucket(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The bucket of a context: by the pair's count, or by its last word's where the pair is unseen."""
    size = np.minimum(np.ceil(np.log2(np.where(pair > 0, pair, word) + 1.0)), BUCKETS - 1).astype(np.int64)
    return np.where(pair > 0, size, BUCKETS + size)


def step(count: np.ndarray, of: np.ndarray, steps: int) -> np.ndarray:
    """The step of an estimate; 0 if it is zero."""
    with np.errstate(divide="ignore"):
        halves = -2 * np.log2(count / np.maximum(of, 1))
    return np.where(count > 0, 1 + np.minimum(np.round(halves), steps - 2), 0).astype(np.int64)


def _meet(total: int, types: int, doc_kind: pa.DataType):
    """For one block: base scores, the counts that scoring needs, and the held-out histogram."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], [], [], [], [], [], [], [], doc_kind)
        b = Block(docs["text"].to_pylist(), [not x for x in docs["held_out"].to_pylist()])
        rows = sorted(zip(answers["kind"].to_pylist(), answers["r"].to_pylist(), answers["others"].to_pylist(), strict=True))
        others = [np.concatenate([unpack(x).astype(np.int64) for k, _, x in rows if k == kind]) for kind in range(3)]
        places = [at for _, at in b.grams]
        c1, c2, c3 = ((o + c)[at] for o, c, at in zip(others, b.counts, places, strict=True))
        sums = lambda x: np.add.reduceat(x, b.starts)
        base = sums(np.log10((c1 + 1) / (total + types + 1)))
        known = sums((c1 > 0).astype(np.int64))
        payload = []
        for s, n in zip(b.starts, b.lengths, strict=True):
            payload.append(pack(np.concatenate([c3[s : s + n], c2[s : s + n], c1[s : s + n]])))
        end = int(others[0][b.end] + b.counts[0][b.end])
        # Held-out counts: those of the other blocks, for the training tokens of this one.
        o1, o2, o3 = (o[at] for o, at in zip(others, places, strict=True))
        before, pair = (b.after(x, others[0][b.end])[b.train] for x in (o1, o2))
        o1, o2, o3 = o1[b.train], o2[b.train], o3[b.train]
        rest = max(total - int(b.counts[0].sum()), 1)
        three, two, one = step(o3, pair, STEPS3), step(o2, before, STEPS2), step(o1, np.array(rest), STEPS1)
        cell = ((bucket(pair, before) * STEPS3 + three) * STEPS2 + two) * STEPS1 + one
        cells, n = np.unique(cell, return_counts=True)
        return _table(docs["doc_id"].to_pylist(), docs["held_out"].to_pylist(), b.lengths, known, base, payload, cells, n, doc_kind, end)

    return run


def _table(ids, held, lengths, known, base, payload, cells, counts, kind, end=0) -> pa.Table:
    n, m = len(ids), 1 if len(cells) else 0
    col = lambda x, more, t: pa.array([*x, *([more] * m)], t)
    return pa.Table.from_arrays([
        col([True] * n, False, pa.bool_()), col(ids, None, kind), col(held, None, pa.bool_()), col(lengths, None, pa.int64()), col(known, None, pa.int64()), col(base, None, pa.float64()),
        col(payload, None, pa.binary()), pa.array([*[end] * n, *[end] * m], pa.int64()), pa.array([*[None] * n, *[cells] * m], pa.list_(pa.int64())), pa.array([*[None] * n, *[counts] * m], pa.list_(pa.int64())),
    ], names=["is_doc", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "payload", "end", "cells", "counts"])


def learn(cells: np.ndarray, counts: np.ndarray, types: int) -> np.ndarray:
    """Weights of triple, pair, word and uniform for each bucket, by expectation-maximisation on the histogram."""
    # In a fixed order, so that sums of the same histogram agree to the last bit.
    order = np.argsort(cells)
    cells, counts = cells[order], counts[order]
    weights = np.array([[0.4, 0.3, 0.25, 0.05]] * BUCKETS + [[0, 0, 0.9, 0.1]] + [[0, 0.4, 0.5, 0.1]] * (BUCKETS - 1))
    three, two, one = cells // (STEPS1 * STEPS2) % STEPS3, cells // STEPS1 % STEPS2, cells % STEPS1
    estimate = lambda x: np.where(x > 0, 2.0 ** (-(x - 1) / 2), 0)
    p = np.stack([estimate(three), estimate(two), estimate(one), np.full(len(cells), 1 / (types + 1))], 1)
    of = cells // (STEPS1 * STEPS2 * STEPS3)
    for b in np.unique(of):
        at = of == b
        w, n, q = weights[b], counts[at].astype(float), p[at]
        for _ in range(ROUNDS):
            part = w * q
            part *= (n / part.sum(1))[:, None]
            w = part.sum(0) / n.sum()
        # Unseen events keep a share; a context without counts has no estimate of its own.
        w = np.maximum(w, [0, 0, 0, 1e-4])
        weights[b] = w / w.sum()
    return weights


def score(docs: DataFrame, modulus: int = 7, out: int = 2) -> DataFrame:
    """One row per document: split, token counts, base score and the model's log10 probability of the text."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    slim, blocks, ranges = _blocks(docs)
    held = remainder("doc_id", modulus) == out
    sent = slim.select("__block", "__class", "text", (~held).alias("train")).mapInArrow(_send(ranges, 8 * MOST_GROWTH * BLOCK_BYTES), "block bigint, kind int, r bigint, hashes binary, counts binary")
    # As many tasks as ranges and blocks, so that none gets more as the corpus grows.
    answers = materialize(sent.repartition(min(ranges, MOST_TASKS), "r").groupBy("r").applyInArrow(_answer, _ANSWER), "ngram-answers")
    types, total = answers.where("block is null and kind = 0").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    from pyspark.sql.pandas.types import to_arrow_type

    tasks = min(2 * blocks, MOST_TASKS)
    left = slim.select("doc_id", "text", held.alias("held_out"), F.col("__block").alias("block")).repartition(tasks, "block").groupBy("block")
    right = answers.where("block is not null").select("block", "kind", "r", "others").repartition(tasks, "block").groupBy("block")
    schema = f"is_doc boolean, doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, payload binary, end bigint, cells array<bigint>, counts array<bigint>"
    met = materialize(left.cogroup(right).applyInArrow(_meet(int(total), int(types), to_arrow_type(kind)), schema), "ngram-counts")
    cells = met.where("not is_doc").select(F.explode(F.arrays_zip("cells", "counts")).alias("x")).groupBy("x.cells").agg(F.sum("x.counts").alias("n")).toArrow()
    weights = learn(cells["cells"].to_numpy(), cells["n"].to_numpy(), int(types))
    model = spark.sparkContext.broadcast((weights, int(total), int(types)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n, v = model.value
        for batch in batches:
            scores = []
            for raw, end in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                both = unpack(raw).astype(float)
                c3, c2, c1 = np.split(both, 3)
                cuv, cv = np.concatenate([[end], c2[:-1]]), np.concatenate([[end], c1[:-1]])
                mix = w[bucket(cuv, cv)]
                p = mix[:, 0] * c3 / np.maximum(cuv, 1) + mix[:, 1] * c2 / np.maximum(cv, 1) + mix[:, 2] * c1 / max(n, 1) + mix[:, 3] / (v + 1)
                scores.append(float(np.log10(p).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([n] * len(scores), pa.int64()), batch.column(4), pa.array(scores, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = met.where("is_doc").select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "payload", "end")
    return rows.mapInArrow(finish, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
