"""Shared helpers: durable intermediate tables, joins that split hot keys, ASCII folding, document splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import fresh_path, materialize, shared_dir  # noqa: F401

#: Lower-cases A-Z in UTF-8 bytes and touches nothing else.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: A key of more rows than this, and of more than one in ``HOT_KEYS`` of all rows, is split.
HOT_ROWS, HOT_KEYS = 4096, 1024


def bounded(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df`` in a copy of its session that hands Python workers ``rows`` texts at once at most.

    The caller's session keeps its own setting.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if 0 < int(spark.conf.get(key, "10000")) <= rows:
        return df
    own = spark._jsparkSession.cloneSession()
    copy = SparkSession(spark.sparkContext, own)
    copy.conf.set(key, str(rows))
    made = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, df._jdf.queryExecution().analyzed())
    return DataFrame(made, copy)


def unused(columns: list[str], name: str) -> str:
    """A column name that ``columns`` lack."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def deal_of(df: DataFrame, skip: tuple[str, ...] = ("text",)) -> Column:
    """A hash of a row's columns, those left out that are long or have no hash."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if c not in skip and "map<" not in kind and kind != "variant"), F.lit(1))


def split_join(rows: DataFrame, few: DataFrame, on: list[str], count: str, deal: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, a written table of one row for each key with the number of ``rows`` that have it.

    Hot keys, ``HOT_KEYS`` of them at most as each has more than that share of all rows, go to every task; their rows
    are dealt by the hash ``deal`` over parts of ``HOT_ROWS`` or so, and their row of ``few`` is repeated for each part.
    """
    total = few.agg(F.sum(count)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    parts, part = unused([*rows.columns, *few.columns], "parts"), unused([*rows.columns, *few.columns], "part")
    heavy = few.where(F.col(count) > limit).select(*on, F.ceil(F.col(count) / limit).cast("int").alias(parts))
    if heavy.isEmpty():
        return rows.join(few, on, how)
    left = rows.join(F.broadcast(heavy), on, "left").withColumn(part, F.coalesce(F.pmod(deal, F.col(parts)), F.lit(0)).cast("int")).drop(parts)
    last = F.greatest(F.ceil(F.col(count) / limit).cast("int"), F.lit(1)) - 1
    right = few.withColumn(part, F.explode(F.sequence(F.lit(0), last)))
    return left.join(right, [*on, part], how).drop(part)


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as remainder -1 and so as a training row of every split."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus, F.lit(-1))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


def map_texts(
    df: DataFrame,
    schema: str,
    per_text: Callable[[str | None], tuple],
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Applies ``per_text`` to each text in bounded slices; ``keep`` columns go through, then its results follow.

    ``schema`` is a DDL string of the whole result, kept columns first.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                made = list(zip(*map(per_text, part.column(len(keep)).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *map(pa.array, made)], names=names)

    return df.select(*keep, text).mapInArrow(run, schema)


def popcount(x: np.ndarray) -> np.ndarray:
    """Bits set in each unsigned 64-bit number."""
    return np.bitwise_count(x)
