"""Batch lookups on (partition, address) order: one result per probe.

``find`` and ``contains`` are equi-joins.  Floor, ceil, lower and upper bound are
as-of joins with two ways to run:

* a base of at most ``SMALL_ROWS`` numeric keys and ``SMALL_BYTES`` of flat fields
  (counted first) is sorted once and sent to all executors, where each batch of
  probes is searched; no probe moves;
* any other base is put next to the probes by window over ranges of keys, and a
  range without an answer takes it from the nearest range that has one.  Ranges
  are at most ``RANGES``, so the table of their ends stays small at any size.
  They are of equal width where that spreads the rows well enough, and cut at
  the keys' quantiles where keys bunch.  Windows run with the lookup's
  direction, so each row is looked at once.

Probes that repeat a key are answered once and joined back, so a key that very
many probes ask for does not fill one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.widths import integral_div
from ..sources.storage import ensure_checkpoints

SMALL_ROWS, SMALL_BYTES = 200_000, 64 << 20
RANGES = 4096
#: A range of equal width may hold so many rows, or so many times its even share; fuller ones make the ranges quantiles.
FULL_ROWS, FULL_SHARE = 1 << 20, 4
#: Fixed by what each lookup means: the direction, and whether an equal key is an answer.
WAYS = {"floor": (True, True), "ceil": (False, True), "lower_bound": (False, True), "upper_bound": (False, False)}


def find(probes: DataFrame, base: DataFrame, on: list[str], fields: list[str] | None = None) -> DataFrame:
    """``probes`` with the fields of the record that has the same key, null where none has."""
    keep = [c for c in base.columns if c not in on] if fields is None else fields
    return probes.join(base.select(*on, *keep), on, "left")


def contains(probes: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """The probes whose key the base has."""
    return probes.join(base.select(*on), on, "left_semi")


def missing(probes: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """The probes whose key the base lacks."""
    return probes.join(base.select(*on), on, "left_anti")


def contains_flag(probes: DataFrame, base: DataFrame, on: list[str], name: str = "found") -> DataFrame:
    marked = base.select(*on, F.lit(True).alias("__there"))
    return probes.join(marked, on, "left").withColumn(name, F.col("__there").isNotNull()).drop("__there")


def as_of(probes: DataFrame, base: DataFrame, how: str, fields: list[str], partition: str = "partition", address: str = "address", prefix: str = "", strategy: str = "auto", repeats: bool = True) -> DataFrame:
    """``probes`` with the answering record's partition, address and ``fields``, named with ``prefix``; null at the end.

    ``strategy``: ``broadcast``, ``window`` or ``auto``, which counts the base up to the bound.  ``repeats=False``
    says that no two probes share a key, which saves joining answers back.
    """
    if how not in WAYS:
        raise ValueError(f"no lookup {how!r}")
    payload = [partition, address, *fields]
    numeric = all(dict(base.dtypes)[c] in ("int", "bigint") for c in (partition, address))
    if dict(base.dtypes)[address] != dict(probes.dtypes)[address] and "binary" in (dict(base.dtypes)[address], dict(probes.dtypes)[address]):
        # A number asked of binary addresses, or the reverse, finds nothing.
        return probes.select("*", *(F.lit(None).cast(dict(base.dtypes)[c]).alias(f"{prefix}{c}") for c in payload))
    slim = base.select(*payload)
    if strategy == "auto":
        strategy = "broadcast" if numeric and _small(slim) else "window"
    if strategy == "broadcast":
        return _search(probes, slim, how, payload, partition, address, prefix)
    key = [partition, address]
    if not repeats:
        return _windowed(probes, slim, how, payload, key, prefix)
    asked = probes.select(*key).where(F.col(partition).isNotNull() & F.col(address).isNotNull()).distinct()
    answers = _windowed(asked, slim, how, payload, key, prefix)
    back = answers.select(*(F.col(k).alias(f"__{k}") for k in key), *(F.col(f"{prefix}{c}").alias(f"{prefix}{c}") for c in payload)) if prefix else answers
    if prefix:
        cond = (probes[partition] == back[f"__{partition}"]) & (probes[address] == back[f"__{address}"])
        return probes.join(back, cond, "left").drop(*(f"__{k}" for k in key))
    return probes.join(back, key, "left")


def _small(base: DataFrame) -> bool:
    """Whether a base of flat columns is within the bounds of what is sent to all executors."""
    if any(kind.split("<")[0] in ("array", "map", "struct", "variant") for _, kind in base.dtypes):
        return False
    long = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in base.dtypes if kind in ("string", "binary")]
    row = base.limit(SMALL_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(long, F.lit(0)) + 16 * len(base.columns)), F.lit(0)).alias("size")).first()
    return row.n <= SMALL_ROWS and row["size"] <= SMALL_BYTES


def _search(probes: DataFrame, base: DataFrame, how: str, payload: list[str], partition: str, address: str, prefix: str) -> DataFrame:
    """Binary search of each batch in the sorted base, which is held as Arrow columns by every worker."""
    back, same = WAYS[how]
    table = base.orderBy(partition, address).toArrow()
    p, a = (table[c].to_numpy().astype(np.int64) for c in (partition, address))
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
    sent = probes.sparkSession.sparkContext.broadcast((table.combine_chunks(), a, p[starts], np.r_[starts, len(p)]))
    at = [probes.columns.index(partition), probes.columns.index(address)]
    types, names = dict(base.dtypes), [*probes.columns, *(f"{prefix}{c}" for c in payload)]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in probes.dtypes), *(f"`{prefix}{c}` {types[c]}" for c in payload)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, addresses, parts, cuts = sent.value
        n = len(addresses)
        for batch in batches:
            null = np.zeros(batch.num_rows, bool)
            keys = []
            for i in at:
                null |= np.asarray(batch.column(i).is_null())
                keys.append(np.asarray(batch.column(i).fill_null(0)).astype(np.int64))
            slot = np.searchsorted(parts, keys[0], "left")
            here = (slot < len(parts)) & (parts[np.minimum(slot, max(len(parts) - 1, 0))] == keys[0]) if len(parts) else np.zeros(len(slot), bool)
            # Keys before the probe, or up to it: those of earlier partitions, then a search within its own.
            low, high = cuts[np.minimum(slot, len(cuts) - 1)].astype(np.int64), cuts[np.minimum(slot + here, len(cuts) - 1)].astype(np.int64)
            right = (how == "floor") or not same
            while (low < high).any():
                mid = (low + high) // 2
                value = addresses[np.minimum(mid, n - 1)]
                up = (low < high) & ((value <= keys[1]) if right else (value < keys[1]))
                low, high = np.where(up, mid + 1, low), np.where((low < high) & ~up, mid, high)
            place = low - 1 if back else low
            miss = (place < 0) | (place >= n) | null
            index = pa.array(np.where(miss, 0, place), pa.int64(), mask=miss)
            got = [records[c].take(index) for c in payload]
            got = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, *got], names)

    return probes.mapInArrow(run, schema)


def _ranged(rows: DataFrame, partition: str, address: str) -> DataFrame:
    """``rows`` with ``__r``, a range that follows the key's order: ``RANGES`` of them at most, none of them much fuller than the others."""
    kinds = dict(rows.dtypes)
    whole = [kinds[c] in ("int", "bigint", "decimal(20,0)") for c in (partition, address)]
    ends = [f(c).alias(f"{k}_{c}") for c, w in zip((partition, address), whole, strict=True) if w for k, f in (("lo", F.min), ("hi", F.max))]
    row = rows.agg(F.count("*").alias("n"), *ends).first()
    place = _equal_widths(row, partition, address, kinds, whole)
    if place is not None:
        even = rows.withColumn("__r", F.coalesce(place, F.lit(-1)))
        if row.n <= FULL_ROWS or even.groupBy("__r").count().agg(F.max("count")).first()[0] <= max(FULL_ROWS, FULL_SHARE * row.n // RANGES):
            return even
    parts = min(RANGES, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), row.n // FULL_ROWS))
    # Written before it is used, so that what a lost executor held isn't cut at other keys.
    ensure_checkpoints(rows.sparkSession)
    return rows.repartitionByRange(parts, partition, address).withColumn("__r", F.spark_partition_id().cast("bigint")).checkpoint()


def _equal_widths(row, partition: str, address: str, kinds: dict[str, str], whole: list[bool]) -> Column | None:
    """Ranges of equal width over the partitions, or over the addresses of an only partition; None where keys aren't numbers."""
    if not whole[0] or row[f"lo_{partition}"] is None:
        return None
    one = row[f"lo_{partition}"] == row[f"hi_{partition}"] and whole[1] and row[f"lo_{address}"] is not None
    name = address if one else partition
    lo, hi = int(row[f"lo_{name}"]), int(row[f"hi_{name}"])
    step = (hi - lo) // RANGES + 1
    big = kinds[name] == "decimal(20,0)"
    ahead = F.col(name).cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)") if big or hi - lo >= 2**62 else F.col(name) - F.lit(lo)
    return integral_div(ahead, step) if step > 1 or big else ahead.cast("bigint")


def _windowed(probes: DataFrame, base: DataFrame, how: str, payload: list[str], key: list[str], prefix: str) -> DataFrame:
    back, same = WAYS[how]
    partition, address = key
    # An equal key comes before its probe if it answers a floor, after it if it answers a ceil, before it (and so is passed over) in an upper bound.
    base_first = back or not same
    record = F.struct(*payload)
    left = base.select(F.col(partition).alias("__p"), F.col(address).alias("__a"), F.lit(0 if base_first else 1).alias("__o"), record.alias("__rec"), F.lit(None).cast(probes.schema).alias("__row"))
    right = probes.select(F.col(partition).alias("__p"), F.col(address).alias("__a"), F.lit(1 if base_first else 0).alias("__o"), F.lit(None).cast(base.select(record.alias("x")).schema["x"].dataType).alias("__rec"), F.struct(*(F.col(c) for c in probes.columns)).alias("__row"))
    ranged = _ranged(left.unionByName(right), "__p", "__a")
    # Against the direction of the lookup, so that the answer is the last record seen.
    towards = lambda *names: [F.col(c).asc() if back else F.col(c).desc() for c in names]
    seen = Window.partitionBy("__r").orderBy(*towards("__p", "__a", "__o")).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumn("__in", F.last("__rec", ignorenulls=True).over(seen)).where(F.col("__row").isNotNull())
    # The ends of ranges, one row for each range; ranges without records have none.
    record_rows = ranged.where(F.col("__rec").isNotNull()).select("__r", F.struct("__p", "__a", "__rec").alias("held"))
    ends = record_rows.groupBy("__r").agg((F.max("held") if back else F.min("held"))["__rec"].alias("__end"))
    asked = ranged.select("__r").distinct()
    ends = asked.join(ends, "__r", "left")
    before = Window.orderBy(*towards("__r")).rowsBetween(Window.unboundedPreceding, -1)
    near = ends.select(F.col("__r").alias("__r2"), F.last("__end", ignorenulls=True).over(before).alias("__near"))
    # The rows lie by range already, so only the ends move.
    joined = rows.join(near, rows["__r"] == near["__r2"], "left").withColumn("__got", F.coalesce("__in", "__near"))
    # A probe without a key has no answer.
    asks = F.col("__p").isNotNull() & F.col("__a").isNotNull()
    return joined.select("__row.*", *(F.when(asks, F.col("__got")[c]).alias(f"{prefix}{c}") for c in payload))


def neighbours(base: DataFrame, partition: str = "partition", address: str = "address") -> DataFrame:
    """Each record with the key before and after it."""
    ranged = _ranged(base, partition, address)
    key = F.struct(F.col(partition).alias("p"), F.col(address).alias("a"))
    order = Window.partitionBy("__r").orderBy(partition, address)
    across = Window.orderBy("__r")  # one row for each range
    ends = ranged.groupBy("__r").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    ends = ends.select("__r", F.lag("hi").over(across).alias("__before"), F.lead("lo").over(across).alias("__after"))
    rows = ranged.withColumns({"__prev": F.lag(key).over(order), "__next": F.lead(key).over(order)}).join(F.broadcast(ends), "__r")
    rows = rows.withColumns({"__prev": F.coalesce("__prev", "__before"), "__next": F.coalesce("__next", "__after")})
    return rows.select(*base.columns, F.col("__prev.p").alias("prev_partition"), F.col("__prev.a").alias("prev_address"), F.col("__next.p").alias("next_partition"), F.col("__next.a").alias("next_address"))


def range_scan(base: DataFrame, low, high, key: str = "key") -> DataFrame:
    """Records with low <= key < high; the filter reaches the scan."""
    return base.where((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high)))


def ranked_scan(base: DataFrame, partition: str = "partition", address: str = "address", reverse: bool = False, name: str = "rank") -> DataFrame:
    """Each record's place in (partition, address) order, from 1: its place in its range plus the records before that."""
    ranged = _ranged(base, partition, address)
    order = lambda *names: [F.col(c).desc() if reverse else F.col(c).asc() for c in names]
    inside = F.row_number().over(Window.partitionBy("__r").orderBy(*order(partition, address)))
    before = F.sum("count").over(Window.orderBy(*order("__r")).rowsBetween(Window.unboundedPreceding, -1))  # one row for each range
    counts = ranged.groupBy("__r").count().select("__r", F.coalesce(before, F.lit(0)).alias("__before"))
    rows = ranged.withColumn("__k", inside).join(F.broadcast(counts), "__r")
    return rows.select(*base.columns, (F.col("__k") + F.col("__before")).cast("bigint").alias(name))


def bounds(base: DataFrame, partition: str = "partition", address: str = "address") -> DataFrame:
    """The first and the last key."""
    key = F.struct(partition, address)
    return base.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).select(F.col("lo")[partition].alias("first_partition"), F.col("lo")[address].alias("first_address"), F.col("hi")[partition].alias("last_partition"), F.col("hi")[address].alias("last_address"))
