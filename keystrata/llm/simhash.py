"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's bit is set if it is set in over half of the XXH64 (seed 42) of
the text's word shingles, repeats included.  Fingerprints within ``distance``
bits are linked: cut into ``m`` parts, such a pair agrees on ``m - distance`` of
them, so it shares at least one of the keys made of ``m - distance`` parts.
``m`` follows the number of distinct fingerprints, so that chance alone gives a
key few members; keys that still have many members are replaced by keys of
sixteen parts, which leave twelve bits free and so have 4096 members at most.
Members of a key are compared in blocks and give spanning links, never all
pairs.  All of this is exact.

Defined results: null and blank texts have fingerprint zero and are linked like
any other; texts shorter than a shingle have one shingle; equal fingerprints
are one node; a repeated row is repeated in the result; a null doc_id has a
fingerprint and takes part, but is never the least id of a group that has one;
very long texts are hashed in pieces; an empty table gives an empty result; only
``doc_id`` and ``text`` decide, and other columns may have any name.  Distances
over three bits are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import deal_of, map_texts, materialize, popcount, split_join, unused, words_of
from .components import components

#: A key with more members is cut finer.
HOT = 4096
FINE = 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint, as a signed number."""
    words = words_of(text)
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends[shingle - 1 :].tolist() or [len(line)]
    digest = xxhash.xxh64_intdigest
    votes, total = np.zeros(64, np.int64), len(ends)
    for at in range(0, total, 1 << 18):
        h = np.fromiter((digest(line[s:e], 42) for s, e in zip(starts[at : at + (1 << 18)], ends[at : at + (1 << 18)], strict=False)), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp`` (signed 64-bit) for every row."""
    kinds = dict(docs.dtypes)
    return map_texts(docs, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "fp bigint"]), lambda text: (fingerprint(text, shingle),), keep)


def plan(count: int, distance: int = 3) -> int:
    """The least number of parts whose keys have bits for sixteen times ``count`` values."""
    need = max(count, 1).bit_length() + 4
    return next((m for m in range(distance + 1, FINE) if 64 * (m - distance) // m >= need), FINE)


def _masks(m: int, distance: int) -> list[int]:
    cuts = [64 * i // m for i in range(m + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, m - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _keys(fps: DataFrame, m: int, distance: int) -> DataFrame:
    """Each fingerprint with its keys, a key being the table's number and the bits kept."""
    made = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(x)).alias("bits")) for i, x in enumerate(_masks(m, distance))))
    return fps.select("fp", F.explode(made).alias("k")).select("fp", "k.t", "k.bits")


def spanning_links(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what pairs within ``distance`` bits join, one fewer than members at most."""
    left, out = members.view(np.uint64), []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = popcount(left ^ x) <= distance
            if near.any():
                found = left[near]
                out += [(x, y) for y in found]
                reached += list(found)
                left = left[~near]
    return [(int(x.astype(np.int64)), int(y.astype(np.int64))) for x, y in out]


def _links(keys: DataFrame, distance: int) -> DataFrame:
    """Spanning links of all keys; rows arrive sorted by key, one key's members at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None
        members: list[np.ndarray] = []

        def close() -> list[tuple[int, int]]:
            return spanning_links(np.concatenate(members), distance) if members else []

        for batch in batches:
            t, bits, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            out: list[tuple[int, int]] = []
            if len(t):
                cuts = np.flatnonzero((t[1:] != t[:-1]) | (bits[1:] != bits[:-1])) + 1
                for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True):
                    key = (int(t[a]), int(bits[a]))
                    if key != held:
                        out += close()
                        held, members = key, []
                    members.append(fp[a:b].astype(np.int64))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
        out = close()
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return keys.select("t", "bits", "fp").repartition("t", "bits").sortWithinPartitions("t", "bits").mapInArrow(run, "a bigint, b bigint")


def link(fps: DataFrame, distance: int = 3) -> DataFrame:
    """``a, b``: spanning links of distinct fingerprints ``fp`` within ``distance`` bits."""
    if not 0 <= distance <= 3:
        raise ValueError("fingerprints are linked within 0 to 3 bits: beyond that the finest keys have too many members")
    m = plan(fps.count(), distance)
    keys = _keys(fps, m, distance)
    counts = materialize(keys.groupBy("t", "bits").count().where("count > 1"), "key-counts")
    shared = materialize(split_join(keys, counts, ["t", "bits"], "count", F.xxhash64("fp")), "keys")
    links = _links(shared.where(F.col("count") <= HOT), distance)
    hot = shared.where(F.col("count") > HOT).select("fp").distinct()
    if m < FINE and not hot.isEmpty():
        links = links.unionByName(_links(_keys(hot, FINE, distance), distance))
    return links


def groups(docs: DataFrame, shingle: int = 3, distance: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``fp, root, component_id`` for every row of ``docs``; ``root`` tells components apart."""
    marked = materialize(fingerprints(docs, shingle, keep), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    roots = components(link(nodes.select("fp"), distance))
    of = materialize(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "roots")
    least = materialize(of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "least")
    named = materialize(split_join(of, least, ["root"], "members", F.xxhash64("fp")).drop("members"), "named")
    # A written table's rows keep their numbers, so a row that is read again is dealt to the same part.
    return split_join(marked, named, ["fp"], "rows", F.xxhash64(F.monotonically_increasing_id())).select(*keep, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The query's rows: id, fingerprint in hexadecimal, component."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the least id (null comes last), then of the least text digest.

    Rows of different components all stay, also those that share an id or have none.
    """
    return first_of_each(docs, groups(marked(docs), keep=("doc_id", "digest")))


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, text, digest``."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))


def first_of_each(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """As ``deduplicate``, by the components of ``marked``: ``doc_id``, ``digest`` of the text, ``root``.

    Of rows alike in id and text the first in the order of their columns written as JSON stays.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("digest").alias("d"))
    rows = marked.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n"))
    kept = rows.groupBy("root").agg(F.min(F.struct(first.alias("first"), "n")).alias("x"))
    # Ids that are null count as a value of their own.
    digest, no_id, some = (unused(docs.columns, c) for c in ("digest", "no_id", "id_or_not"))
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept = materialize(kept.select(F.col("x.first.no_id").alias(no_id), written("x.first.id").alias(some), F.col("x.first.d").alias(digest), F.col("x.n").alias(unused(docs.columns, "alike"))), "kept")
    alike = kept.columns[-1]
    left = docs.withColumns({no_id: F.col("doc_id").isNull(), some: written("doc_id"), digest: F.xxhash64("text")})
    left = split_join(left, kept, [no_id, some, digest], alike, deal_of(docs))
    # Rows that are alike in id and text meet in another shuffle, which is left out where there are none.
    if not kept.where(F.col(alike) > 1).isEmpty():
        whole = F.struct(*docs.columns)
        left = left.groupBy(no_id, some, digest).agg(F.min_by(whole, F.to_json(whole)).alias(digest + "_row")).select(f"{digest}_row.*")
    return left.select(*docs.columns)
