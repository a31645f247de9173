"""Benchmark decontamination: a prefix-filtered set join of documents with item windows.

A window is ``window`` consecutive words of an item.  Its word shingles are
ordered by how often they occur in the documents; a document that contains the
window contains its rarest shingle, so a prefix of one shingle is necessary.
The shingle's place in the window fixes where the window would lie, which the
document's bounds must allow (positions and length), and there its words are
compared one by one.

The benchmark is read in parts of ``PART_WORDS`` words or so, each sent to all
executors; a larger benchmark has more parts.  They are taken one by one: a part
is indexed, joined with all documents and dropped before the next one is read,
and the parts' hits are put together by row.

Defined results: a null text or item has no words and hits nothing; an item
shorter than a window is one window; items that repeat count as often as they
have different ids; an item without an id hits and counts as one item, but has
no part in the digest of ids; ids are written as Spark casts them to text;
documents that repeat, share an id or have none are each judged by their own
text; very long texts take memory in proportion; empty tables hit nothing; only
``doc_id``, ``text`` and ``item_id`` are read, and a filter keeps all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, unused

#: Words are what is left between these characters; A-Z are lower-cased.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Benchmark words sent to the executors at once.
PART_WORDS = 200_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class Windows:
    """The windows of some items and the shingles that find them."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = 13, shingle: int = 5):
        self.window, self.shingle = window, shingle
        self.holders: dict[tuple[bytes, ...], list] = {}
        for item, words in items:
            for at in range(max(1, len(words) - window + 1) if words else 0):
                held = self.holders.setdefault(tuple(words[at : at + window]), [])
                if item not in held[-1:]:
                    held.append(item)
        self.shingles = {s for w in self.holders for _, s in self._of(w)}
        self.starts = self._starts(self.shingles)

    @staticmethod
    def _starts(shingles) -> dict[bytes, tuple[int, ...]]:
        """Lengths of the shingles that begin with a word."""
        out: dict[bytes, set[int]] = {}
        for s in shingles:
            out.setdefault(s[0], set()).add(len(s))
        return {w: tuple(sorted(n)) for w, n in out.items()}

    def _of(self, window: tuple[bytes, ...]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        n = min(self.shingle, len(window))
        for at in range(len(window) - n + 1):
            yield at, window[at : at + n]

    def count(self, words: list[bytes], counts: dict) -> None:
        """Adds a document's occurrences of shingles."""
        starts, known = self.starts, self.shingles
        for at, w in enumerate(words):
            if w in starts:
                for n in starts[w]:
                    s = tuple(words[at : at + n])
                    if s in known:
                        counts[s] = counts.get(s, 0) + 1

    def index(self, counts: dict) -> None:
        """Chooses each window's rarest shingle; one that no document has needs no entry."""
        self.prefix: dict[tuple[bytes, ...], dict[tuple[int, int], None]] = {}
        for w in self.holders:
            rare, at, s = min((counts.get(s, 0), at, s) for at, s in self._of(w))
            if rare:
                self.prefix.setdefault(s, {})[(at, len(w))] = None
        self.first = self._starts(self.prefix)

    def hits(self, words: list[bytes]) -> list[tuple[int, int, list]]:
        """Begin, end and items of each window that occurs, by position."""
        out, total = [], len(words)
        first, prefix, holders = self.first, self.prefix, self.holders
        for p, w in enumerate(words):
            if w in first:
                for n in first[w]:
                    for at, size in prefix.get(tuple(words[p : p + n]), ()):
                        begin = p - at
                        if begin >= 0 and begin + size <= total:
                            found = holders.get(tuple(words[begin : begin + size]))
                            if found is not None:
                                out.append((begin, begin + size, found))
        return sorted(out, key=lambda x: x[:2])


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside at least one span."""
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark's words in parts of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    parts = -(-words // PART_WORDS)
    return [rows.where(F.pmod(F.xxhash64(F.col("item_id")), F.lit(parts)) == i) for i in range(parts)]


def _windows(docs: DataFrame, part: DataFrame, window: int, shingle: int):
    """A broadcast of the part's windows, indexed by rarity in ``docs``."""
    context = docs.sparkSession.sparkContext
    found = Windows([(r.item_id, words_of(r.text)) for r in part.orderBy("item_id").collect()], window, shingle)
    numbers = {s: i for i, s in enumerate(sorted(found.shingles))}
    first = context.broadcast((found, numbers))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, number = first.value
        counts: dict = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                windows.count(words_of(text), counts)
        yield pa.RecordBatch.from_pydict({"shingle": pa.array([number[s] for s in counts], pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    order = sorted(numbers)
    found.index({order[r.shingle]: r.n for r in rows.collect()})
    return context.broadcast(found)


def _verdict(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _found(spans: list[tuple[int, int]], items: list, n_words: int) -> tuple:
    """Words hit, number and digest of items, verdict."""
    n_hit, ids = covered(spans), set(items)
    return n_hit, len(ids), hashlib.sha256(",".join(sorted(i for i in ids if i is not None)).encode()).hexdigest(), _verdict(n_hit, n_words)


def _scan(which, close: bool):
    """Scans the last column for windows; gives verdicts if the benchmark has one part, else what the parts' scans put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = which.value if which else None
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found = windows.hits(words) if windows else []
                spans = list(dict.fromkeys((a, b) for a, b, _ in found))
                items = list(dict.fromkeys(i for _, _, held in found for i in held))
                rows.append((len(words), *(_found(spans, items, len(words)) if close else ([{"begin": a, "end": b} for a, b in spans], items))))
            yield _rows(batch.column(0), rows, close)

    return run


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, spans, items = (batch.column(i).to_pylist() for i in (1, 2, 3))
        yield _rows(batch.column(0), [(k, *_found([(x["begin"], x["end"]) for x in s], i, k)) for k, s, i in zip(n, spans, items, strict=True)], True)


_OPEN = "n_words bigint, spans array<struct<begin:bigint,end:bigint>>, items array<string>"
_CLOSED = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _rows(ids: pa.Array, rows: list[tuple], close: bool) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()) if close else (pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()))
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *(x.split()[0] for x in (_CLOSED if close else _OPEN).split(", "))])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5) -> DataFrame:
    """``docs`` as ``doc_id`` with ``n_words, spans, items``: word spans of the windows found, and ids of their items as text."""
    return _hits(docs, _parts(benchmark), window, shingle)


def _hits(docs: DataFrame, parts: list[DataFrame], window: int, shingle: int) -> DataFrame:
    slim = docs.select("doc_id", "text")
    if len(parts) < 2:
        which = _windows(slim, parts[0], window, shingle) if parts else None
        return slim.mapInArrow(_scan(which, False), f"doc_id {dict(docs.dtypes)['doc_id']}, {_OPEN}")
    # Several parts: rows get a number, frozen by writing it, by which the parts' hits meet.
    rows = materialize(slim.withColumn("doc_id", F.struct("doc_id", F.monotonically_increasing_id().alias("row"))), "numbered")
    made = None
    for part in parts:
        which = _windows(rows, part, window, shingle)
        found = materialize(rows.mapInArrow(_scan(which, False), f"doc_id {dict(rows.dtypes)['doc_id']}, {_OPEN}"), "hits")
        which.destroy()
        made = found if made is None else made.unionByName(found)
    # Every row is in the first part's hits, so rows without a hit stay.
    put = made.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return put.withColumn("doc_id", F.col("doc_id")["doc_id"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5) -> DataFrame:
    """One row per document: words, words hit, items, the items' digest and the verdict."""
    slim, parts = docs.select("doc_id", "text"), _parts(benchmark)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {_CLOSED}"
    if len(parts) < 2:
        return slim.mapInArrow(_scan(_windows(slim, parts[0], window, shingle) if parts else None, True), schema)
    return _hits(slim, parts, window, shingle).mapInArrow(_close, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5) -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept; each row is judged by its own text, whatever its id."""
    parts = _parts(benchmark)
    if not parts:
        return docs
    if len(parts) > 1:
        row, other = (unused(docs.columns, c) for c in ("row", "bad"))
        rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        slim = rows.select(F.col(row).alias("doc_id"), "text")
        bad = _hits(slim, parts, window, shingle).mapInArrow(_close, f"doc_id bigint, {_CLOSED}").where("contaminated").select(F.col("doc_id").alias(other))
        return rows.join(bad, F.col(row) == F.col(other), "left_anti").drop(row)
    which, at = _windows(docs.select("doc_id", "text"), parts[0], window, shingle), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = which.value
        for batch in batches:
            clean = []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                clean.append(not _verdict(covered([(a, b) for a, b, _ in windows.hits(words)]), len(words)))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
