"""Lookups against bisect, both strategies, at, before and after every key."""

import bisect
import random

import pytest

from keystrata.functions.widths import decimal_address_of, decimal_partition_of, ipv4, key_of, le_bytes_to_long, trimmed, untrimmed
from keystrata.operators import lookup
from pyspark.sql import functions as F

HOWS = ["floor", "ceil", "lower_bound", "upper_bound"]


def answer(keys, q, how):
    i = {"floor": bisect.bisect_right(keys, q) - 1, "ceil": bisect.bisect_left(keys, q), "lower_bound": bisect.bisect_left(keys, q), "upper_bound": bisect.bisect_right(keys, q)}[how]
    return keys[i] if 0 <= i < len(keys) else None


def gaps(n, step, seed):
    rng, out, k = random.Random(seed), [], 0
    for _ in range(n):
        k += rng.randrange(1, step)
        out.append(k)
    return out


def frame(spark, keys, bits):
    return spark.createDataFrame([(k >> bits, k & ((1 << bits) - 1), k) for k in keys], "partition bigint, address bigint, k bigint")


@pytest.mark.parametrize("strategy", ["broadcast", "window"])
@pytest.mark.parametrize("bits,step", [(8, 500), (4, 3000), (40, 50)])
def test_as_of_against_bisect(spark, strategy, bits, step):
    keys = gaps(300, step, 42)
    probes = sorted({q for k in keys for q in (k - 1, k, k + 1)} | {0, 2**62})
    base, asked = frame(spark, keys, bits), frame(spark, probes, bits).withColumnRenamed("k", "q")
    for how in HOWS:
        got = {r.q: r.got_k for r in lookup.as_of(asked, base, how, ["k"], prefix="got_", strategy=strategy).collect()}
        assert got == {q: answer(keys, q, how) for q in probes}, how


@pytest.mark.parametrize("strategy", ["broadcast", "window"])
def test_edges(spark, strategy):
    keys = [0x0110, 0x0120, 0x0705]
    cases = {0x0000: None, 0x010F: None, 0x0110: 0x0110, 0x011F: 0x0110, 0x0120: 0x0120, 0x0121: 0x0120, 0x0500: 0x0120, 0x0704: 0x0120, 0x0705: 0x0705, 0xFFFF: 0x0705}
    asked = frame(spark, list(cases), 8).withColumnRenamed("k", "q")
    got = lookup.as_of(asked, frame(spark, keys, 8), "floor", ["k"], prefix="got_", strategy=strategy)
    assert {r.q: r.got_k for r in got.collect()} == cases
    sparse = [(5 << 8) + 3, (1 << 30) + 9, (1 << 40) + 2]
    asked = frame(spark, [q + d for q in sparse for d in (-1, 0, 1)], 8).withColumnRenamed("k", "q")
    for how in HOWS:
        assert all(r.got_k == answer(sparse, r.q, how) for r in lookup.as_of(asked, frame(spark, sparse, 8), how, ["k"], prefix="got_", strategy=strategy).collect())


@pytest.mark.parametrize("strategy", ["broadcast", "window"])
def test_empty_base_null_and_repeated_probes(spark, strategy):
    base = frame(spark, [5, 9], 2)
    asked = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (None, 1, "c"), (1, None, "d"), (0, 0, "e")], "partition bigint, address bigint, name string")
    got = {r["name"]: r.got_k for r in lookup.as_of(asked, base, "floor", ["k"], prefix="got_", strategy=strategy).collect()}
    assert got == {"a": 5, "b": 5, "c": None, "d": None, "e": None}
    got = lookup.as_of(asked, base.where("k < 0"), "ceil", ["k"], prefix="got_", strategy=strategy).collect()
    assert len(got) == 5 and all(r.got_k is None for r in got)


def test_wide_addresses_are_ordered_by_bytes(spark):
    rng = random.Random(6060)
    rows = sorted({(p, rng.randbytes(14)) for p in range(0, 40, 2) for _ in range(10)})
    base = spark.createDataFrame([(p, bytearray(a), i) for i, (p, a) in enumerate(rows)], "partition bigint, address binary, k bigint")
    asked = [(p, a) for p, a in rows] + [(rng.randrange(42), rng.randbytes(14)) for _ in range(200)]
    probes = spark.createDataFrame([(p, bytearray(a), i) for i, (p, a) in enumerate(asked)], "partition bigint, address binary, q bigint")
    for how in HOWS:
        got = {r.q: r.got_k for r in lookup.as_of(probes, base, how, ["k"], prefix="got_").collect()}
        for i, q in enumerate(asked):
            want = answer(rows, q, how)
            assert got[i] == (None if want is None else rows.index(want))
    numbers = spark.createDataFrame([(0, 1)], "partition bigint, address bigint")
    assert lookup.as_of(numbers, base, "floor", ["k"], prefix="got_").first().got_k is None


def test_ranges_stay_few_and_split_one_partition(spark, monkeypatch):
    monkeypatch.setattr(lookup, "RANGES", 7)
    keys = gaps(200, 90, 3)
    base, asked = frame(spark, keys, 62), frame(spark, list(range(0, 18000, 11)), 62).withColumnRenamed("k", "q")
    got = lookup.as_of(asked, base, "ceil", ["k"], prefix="got_", strategy="window").collect()
    assert all(r.got_k == answer(keys, r.q, "ceil") for r in got)


def test_bunched_keys_are_cut_at_quantiles(spark, monkeypatch):
    """A partition that holds nearly all keys is spread over many ranges, and answers stay the same."""
    monkeypatch.setattr(lookup, "FULL_ROWS", 50)
    monkeypatch.setattr(lookup, "RANGES", 16)
    keys = gaps(600, 5, 4) + [1 << 50]
    base, asked = frame(spark, keys, 20), frame(spark, [*range(0, 3000, 7), 1 << 49, 1 << 51], 20).withColumnRenamed("k", "q")
    ranged = lookup._ranged(base, "partition", "address")
    assert max(r["count"] for r in ranged.groupBy("__r").count().collect()) < 200
    for how in HOWS:
        got = lookup.as_of(asked, base, how, ["k"], prefix="got_", strategy="window", repeats=False).collect()
        assert all(r.got_k == answer(keys, r.q, how) for r in got) and len(got) == asked.count(), how
    assert [r.k for r in lookup.ranked_scan(base, reverse=True).orderBy("rank").collect()] == keys[::-1]
    rows = lookup.neighbours(base).orderBy("k").collect()
    assert [r.prev_address for r in rows] == [None, *(r.address for r in rows[:-1])]
    assert [r.next_partition for r in rows] == [*(r.partition for r in rows[1:]), None]


def test_find_does_not_fall_through(spark):
    base, asked = frame(spark, [3, 9], 2), frame(spark, [3, 4, 9, 10], 2).withColumnRenamed("k", "q")
    on = ["partition", "address"]
    assert {r.q: r.k for r in lookup.find(asked, base, on).collect()} == {3: 3, 4: None, 9: 9, 10: None}
    assert sorted(r.q for r in lookup.contains(asked, base, on).collect()) == [3, 9]
    assert sorted(r.q for r in lookup.missing(asked, base, on).collect()) == [4, 10]
    assert {r.q: r.found for r in lookup.contains_flag(asked, base, on).collect()} == {3: True, 4: False, 9: True, 10: False}


def test_scan_and_neighbours(spark):
    keys = gaps(100, 400, 8)
    base = frame(spark, keys, 8)
    assert [r.k for r in lookup.ranked_scan(base).orderBy("rank").collect()] == keys
    assert [r.k for r in lookup.ranked_scan(base, reverse=True).orderBy("rank").collect()] == keys[::-1]
    rows = {r.k: r for r in lookup.neighbours(base).collect()}
    for i, k in enumerate(keys):
        r = rows[k]
        assert (None if r.prev_address is None else (r.prev_partition << 8) + r.prev_address) == (keys[i - 1] if i else None)
        assert (None if r.next_address is None else (r.next_partition << 8) + r.next_address) == (keys[i + 1] if i + 1 < len(keys) else None)
    b = lookup.bounds(base).first()
    assert (b.first_partition << 8) + b.first_address == keys[0] and (b.last_partition << 8) + b.last_address == keys[-1]
    assert [r.k for r in lookup.range_scan(base, keys[10], keys[20], "k").orderBy("k").collect()] == keys[10:20]


def test_key_functions(spark):
    one = spark.createDataFrame([(bytearray(b"\x01\x02\x00"), bytearray(b"\x00\x00\x07\x08"), "10.0.1.255", "1.2.3", 0x0A0000)], "le binary, raw binary, ip string, bad string, n bigint")
    two, skip = F.lit(2), F.lit(2)
    r = one.select(
        le_bytes_to_long(F.col("le"), 3).alias("le"), le_bytes_to_long(F.col("le"), 4).alias("short"), ipv4(F.col("ip")).alias("ip"), ipv4(F.col("bad")).alias("bad"),
        trimmed(F.col("raw"), skip, two, True).alias("t"), untrimmed(trimmed(F.col("raw"), skip, two, True), skip, two, 4, True).alias("u"),
        trimmed(F.col("n"), skip, F.lit(1), False).alias("tn"), untrimmed(trimmed(F.col("n"), skip, F.lit(1), False), skip, F.lit(1), 3, False).alias("un"), key_of(F.lit(3), F.lit(5), 8).alias("k"),
    ).first()
    assert (r.le, r.short, r.ip, r.bad) == (0x0201, None, 0x0A0001FF, None)
    assert (bytes(r.t), bytes(r.u), r.tn, r.un, r.k) == (b"\x07\x08", b"\x00\x00\x07\x08", 0x0A, 0x0A0000, 0x305)
    big = spark.sql("select cast(18446744073709551615 as decimal(20,0)) as k")
    d = big.select(decimal_partition_of(F.col("k"), 32).alias("p"), decimal_address_of(F.col("k"), 32).alias("a")).first()
    assert int(d.p) == int(d.a) == 2**32 - 1
