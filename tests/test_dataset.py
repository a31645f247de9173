"""Build, write, open, validate."""

import json
import random

import pytest
from pyspark.sql import functions as F

from keystrata.plans.model import BuildError, FormatError, Options, Schema, Status, keyed, split, wide
from keystrata.sources.dataset import TypedKey, build, open_dataset, try_open
from keystrata.sources.storage import read_json, write_json
from keystrata.streaming.stream_lookup import find_stream

COUNTRY = Schema.of(country="text", region="text", population="uint", temp_c="sint")


def countries(spark, n, distinct, seed=7):
    rng, k, out = random.Random(seed), 0, []
    for _ in range(n):
        k += 1 + rng.randrange(5)
        t = rng.randrange(distinct)
        out.append((k, f"c{t % 5}", f"r{t // 5 % 5}", 1000 + t % 200, -20 + t % 50))
    return spark.createDataFrame(out, "key bigint, country string, region string, population bigint, temp_c bigint")


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("interning", ["never", "always"])
def test_round_trip(spark, tmp_path, interning):
    df = countries(spark, 500, 20)
    report = build(df, keyed("key", 8), COUNTRY, Options(interning=interning)).write(str(tmp_path))
    d = open_dataset(spark, str(tmp_path), verify=True)
    assert d.interned == (interning == "always") and d.size == 500 and d.image_size == report.image_bytes > 0
    assert same(d.records().select(d.key_column().alias("key"), *COUNTRY.names), df.select("key", *COUNTRY.names))
    assert [r.key for r in d.scan().select(d.key_column().alias("key")).collect()] == sorted(r.key for r in df.collect())
    got = d.find(df.select(F.col("key").alias("q")), "q")
    assert got.where("country is null").isEmpty() and got.count() == 500


def test_cost_model_decides(spark):
    assert build(countries(spark, 3000, 20), keyed("key", 12), COUNTRY).report.interned
    apart = spark.range(3000).select(F.col("id").alias("key"), F.lit("US").alias("country"), F.lit("north").alias("region"), (1000 + F.col("id")).alias("population"), F.col("id").alias("temp_c"))
    assert not build(apart, keyed("key", 12), COUNTRY).report.interned


def test_all_kinds_and_wrong_kinds(spark, tmp_path):
    df = spark.createDataFrame([(42, 12345, -9876, 1.5, -2.25, bytearray(b"\xde\xad\xbe\xef\x00\x11"), "hello")], "key bigint, u bigint, s bigint, a float, d double, mac binary, x string")
    schema = Schema.of(u="uint", s="sint", a="f32", d="f64", mac="bytes6", x="text")
    build(df, keyed("key"), schema).write(str(tmp_path))
    d = open_dataset(spark, str(tmp_path))
    r = d.records().select(d.read("u", "uint"), d.read("x", "text"), d.read("mac", "bytes"), d.read("u", "text").alias("wrong"), d.read("zzz", "uint").alias("none")).first()
    assert (r.u, r.x, bytes(r.mac), r.wrong, r.none) == (12345, "hello", b"\xde\xad\xbe\xef\x00\x11", None, None)
    assert d.field("mac").width == 6 and d.field("zzz") is None


def test_nulls_read_as_zero_or_empty(spark):
    df = spark.createDataFrame([(1, None, None), (2, 150, "x")], "key bigint, v bigint, t string")
    b = build(df, keyed("key"), Schema.of(v="uint", t="text"))
    assert [(r.v, r.t) for r in b.records.orderBy("address").collect()] == [(0, ""), (150, "x")] and b.layout[0].bias == 0


def test_build_errors(spark):
    s = Schema.of(v="uint")
    rows = lambda x, t="k bigint, v bigint": spark.createDataFrame(x, t)
    for df, key, schema, options in (
        (rows([(1, 1)]), keyed("k"), Schema(), Options()), (rows([(1, 1)]), keyed("z"), s, Options()), (rows([(1, 1), (1, 2)]), keyed("k"), s, Options()), (rows([(None, 1)]), keyed("k"), s, Options()),
        (rows([(1, "a")], "k bigint, v string"), keyed("k"), s, Options()), (rows([(1, -1)]), keyed("k"), s, Options()), (rows([(1, 1)]), keyed("k"), s, Options(order="assume_sorted")),
        (rows([(1, bytearray(b"ab"), 1), (1, bytearray(b"abc"), 1)], "p bigint, a binary, v bigint"), wide("p", "a"), s, Options()), (rows([(1, bytearray(b""), 1)], "p bigint, a binary, v bigint"), wide("p", "a"), s, Options()),
        (rows([(1, bytearray(b"ab"), 1)], "p bigint, a binary, v bigint"), split("p", "a"), s, Options()), (rows([(1, bytearray(b"x" * 256), 1)], "p bigint, a binary, v bigint"), wide("p", "a"), s, Options()),
        (rows([(1, bytearray(b"ab"))], "k bigint, v binary"), keyed("k"), Schema.of(v="bytes3"), Options()),
    ):
        with pytest.raises(BuildError):
            build(df, key, schema, options)


def test_order_is_checked_by_arrival(spark):
    s, o = Schema.of(v="uint"), Options(order="assume_sorted", sequence="n")
    good = spark.range(200).select((F.col("id") * 3).alias("k"), F.lit(1).cast("bigint").alias("v"), F.col("id").alias("n"))
    assert not build(good, keyed("k", 4), s, o).report.sorted_during_finish
    for bad in (good.withColumn("n", F.when(F.col("k") == 300, -1).otherwise(F.col("n"))), good.unionByName(good.limit(1).withColumn("n", F.lit(500).cast("bigint")))):
        with pytest.raises(BuildError):
            build(bad, keyed("k", 4), s, o)
    assert build(good.withColumn("n", -F.col("n")), keyed("k", 4), s).report.sorted_during_finish


def test_empty_and_single(spark, tmp_path):
    none = spark.createDataFrame([], "k bigint, v bigint")
    build(none, keyed("k"), Schema.of(v="uint")).write(str(tmp_path / "a"))
    d = open_dataset(spark, str(tmp_path / "a"), verify=True)
    assert d.empty and d.partition_count == 0 and d.has_key_mapping
    assert d.floor(spark.createDataFrame([(5,)], "q bigint"), "q").first().got_v is None
    build(spark.createDataFrame([(7, 9)], "k bigint, v bigint"), keyed("k"), Schema.of(v="uint")).write(str(tmp_path / "b"))
    d = open_dataset(spark, str(tmp_path / "b"))
    assert [r.got_v for r in d.ceil(spark.createDataFrame([(6,), (7,), (8,)], "q bigint"), "q").orderBy("q").collect()] == [9, 9, None]


def test_remap(spark):
    df = spark.range(400 * 100).select(F.floor(F.col("id") / 100).alias("p"), (F.col("id") % 100).alias("a")).select((F.col("p") * 256 + F.col("a")).alias("k"), (F.col("p") * 10 + F.col("a") % 10).alias("v"))
    r = build(df, keyed("k", 8), Schema.of(v="uint"), Options(interning="always")).report
    assert (r.distinct_values, r.ref_width, r.remapped_partitions, r.remap_saved_bytes) == (4000, 2, 400, 24000)
    off = build(df, keyed("k", 8), Schema.of(v="uint"), Options(interning="always", remap=False)).report
    assert off.remapped_partitions == 0 and off.image_bytes == r.image_bytes + 24000 + 400 * (off.directory_stride - r.directory_stride)


def test_trim_narrow(spark):
    a = spark.range(1, 1001)
    df = a.select(F.lit(0).cast("bigint").alias("p"), F.shiftleft("id", 16).alias("a")).unionByName(a.select(F.lit(1).cast("bigint").alias("p"), F.col("id").alias("a"))).unionByName(spark.range(1).select(F.lit(2).cast("bigint").alias("p"), F.lit(0xFF000000).cast("bigint").alias("a"))).unionByName(spark.range(1).select(F.lit(3).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("a"))).withColumn("v", F.lit(1).cast("bigint"))
    from keystrata.operators.measure import directory

    b = build(df, split("p", "a"), Schema.of(v="uint"))
    assert {r.partition: (r.skip, r.width) for r in directory(b.records, b.schema).collect()} == {0: (2, 2), 1: (0, 2), 2: (3, 1), 3: (0, 0)}
    assert (b.report.address_width, b.report.narrowed_partitions, b.report.address_bytes_total) == (4, 4, 4001)
    assert build(df, split("p", "a"), Schema.of(v="uint"), Options(trim=False)).report.address_saved_bytes == 0


def test_trim_wide_and_probes(spark, tmp_path):
    rng = random.Random(31337)
    rows = [(0, bytes(rng.randrange(1, 256) for _ in range(4)) + bytes(8)) for _ in range(50)] + [(1, bytes(rng.randrange(1, 256) for _ in range(12))) for _ in range(50)] + [(2, bytes(2) + bytes(rng.randrange(1, 256) for _ in range(2)) + bytes(8)) for _ in range(30)]
    rows = sorted(set(rows))
    df = spark.createDataFrame([(p, bytearray(a), i) for i, (p, a) in enumerate(rows)], "p bigint, a binary, v bigint")
    build(df, wide("p", "a"), Schema.of(v="uint")).write(str(tmp_path))
    d = open_dataset(spark, str(tmp_path), verify=True)
    assert {r.partition: (r.skip, r.width) for r in d.directory().collect()} == {0: (0, 4), 1: (0, 12), 2: (2, 2)}
    assert d.trims_addresses and not d.has_key_mapping and not d.narrow_address and d.address_width == 12
    probes = spark.createDataFrame([(0, bytearray(rows[0][1])), (0, bytearray(b"x" * 11))], "partition bigint, address binary")
    assert sorted((len(r.address or b""), r.got_v) for r in d.floor(probes).collect()) == [(0, None), (12, 0)]
    assert d.floor(spark.createDataFrame([(5,)], "q bigint"), "q").first().got_v is None
    assert d.find(spark.createDataFrame([(0, 5)], "partition bigint, address bigint")).first().v is None


def test_dedup_give_up(spark):
    apart = spark.range(500).select(F.col("id").alias("k"), F.col("id").alias("v"))
    o = Options(dedup_sample=100, emulate_give_up=True)
    assert build(apart, keyed("k"), Schema.of(v="uint"), o).report.dedup_abandoned
    r = build(apart.withColumn("v", F.col("k") % 3), keyed("k"), Schema.of(v="uint"), o).report
    assert (r.dedup_abandoned, r.distinct_values) == (False, 3)


@pytest.mark.parametrize("interning", ["never", "always"])
def test_floats_keep_their_bits(spark, tmp_path, interning):
    values = [0.0, -0.0, 1.5, -0.0, float("nan"), float("inf"), float("nan"), -1.5, 0.0]
    df = spark.createDataFrame([(i, x, x, "t") for i, x in enumerate(values)], "k bigint, v double, s float, t string")
    b = build(df, keyed("k"), Schema.of(v="f64", s="f32", t="text"), Options(interning=interning))
    assert b.report.distinct_values == 6 and b.values().count() == 6
    b.write(str(tmp_path))
    d = open_dataset(spark, str(tmp_path), verify=True)
    rows = d.records().orderBy("address").collect()
    assert [str(r.v) for r in rows] == [str(r.s) for r in rows] == [str(x) for x in values]
    assert [str(r.v) for r in d.find(df.select(F.col("k").alias("q")), "q").orderBy("q").collect()] == [str(x) for x in values]


def test_texts_and_ids(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["b", "a", "", "b", "ü"])], "k bigint, t string")
    for name, rows in (("full", df), ("none", df.limit(0))):
        build(rows, keyed("k"), Schema.of(t="text")).write(str(tmp_path / name))
    d = open_dataset(spark, str(tmp_path / "full"), verify=True)
    assert [r.text for r in d.dictionary("t").orderBy("dict_id").collect()] == ["", "a", "b", "ü"]
    asked = spark.createDataFrame([("a",), ("zzz",), ("ü",), (None,)], "x string")
    assert {r.x: r.dict_id for r in d.text_ids(asked, "t", "x").collect()} == {"a": 1, "zzz": None, "ü": 3, None: None}
    ids = spark.createDataFrame([(0,), (3,), (4,), (None,)], "i bigint")
    assert {r.i: r.text for r in d.texts(ids, "t", "i").collect()} == {0: "", 3: "ü", 4: None, None: None}
    assert [r.t for r in d.encoded().orderBy("address").collect()] == [2, 1, 0, 2, 3]
    assert open_dataset(spark, str(tmp_path / "none"), verify=True).dictionary("t").count() == 0


def test_long_fields_are_not_sent_to_all(spark, monkeypatch):
    from keystrata.operators import lookup

    monkeypatch.setattr(lookup, "SMALL_BYTES", 10_000)
    rows = spark.range(40).select((F.col("id") * 3).alias("partition"), F.col("id").alias("address"), F.repeat(F.lit("x"), 500).alias("long"))
    assert not lookup._small(rows) and lookup._small(rows.drop("long")) and not lookup._small(rows.withColumn("a", F.array("address")))
    probes = spark.range(100).select(F.col("id").alias("partition"), F.lit(0).cast("bigint").alias("address"))
    got = lookup.as_of(probes, rows, "ceil", ["long"], prefix="got_")
    assert got.where("got_long is null and partition < 117").isEmpty()


def test_dry_run_and_size_limit(spark, tmp_path):
    b = build(countries(spark, 50, 5), keyed("key", 8), COUNTRY)
    assert b.write(str(tmp_path / "x"), dry_run=True) == b.report and not (tmp_path / "x").exists()
    with pytest.raises(BuildError):
        b.write(str(tmp_path / "x"), most_bytes=b.report.image_bytes - 1)


def test_typed_keys(spark):
    t = TypedKey(lambda h: (F.shiftrightunsigned(h, 4), h.bitwiseAND(F.lit(15))), lambda p, a: F.shiftleft(p, 4).bitwiseOR(a))
    r = t.probes(spark.createDataFrame([(1000,)], "h bigint"), "h").withColumn("back", t.key()).first()
    assert (r.partition, r.address, r.back) == (62, 8, 1000)
    with pytest.raises(BuildError):
        TypedKey(t.split).key()


def test_tampering_is_found(spark, tmp_path):
    path = str(tmp_path / "d")
    build(countries(spark, 300, 10), keyed("key", 8), COUNTRY, Options(interning="always")).write(path)
    good = read_json(spark, f"{path}/manifest")

    def status(**change):
        write_json(spark, f"{path}/manifest", json.loads(json.dumps(good)) | change)
        return try_open(spark, path, verify=True)[1]

    assert status() is Status.OK and try_open(spark, str(tmp_path / "none"))[1] is Status.TOO_SMALL
    assert status(format="x") is Status.BAD_MAGIC and status(version=9) is Status.BAD_VERSION
    assert [status(address_bits=b) for b in (65, 254, 255)] == [Status.BAD_SCHEMA] * 3
    assert status(schema=[]) is Status.BAD_SCHEMA and status(report=good["report"] | {"records": 5}) is Status.BAD_SIZE
    assert status(report=good["report"] | {"partitions": 1}) is Status.BAD_DIRECTORY
    status()
    values = [tuple(r) for r in spark.read.parquet(f"{path}/values").collect()]
    schema = spark.read.parquet(f"{path}/values").schema
    spark.createDataFrame([v for v in values if v[-1] != len(values) - 1], schema).write.mode("overwrite").parquet(f"{path}/values")
    d, found = try_open(spark, path)
    assert found is Status.OK and not d.records().where("country is null").isEmpty()
    assert d.records().where("address is null").isEmpty()
    with pytest.raises(FormatError):
        open_dataset(spark, path, verify=True)


def test_stream_lookup(spark, tmp_path):
    df = countries(spark, 100, 5)
    build(df, keyed("key", 8), COUNTRY).write(str(tmp_path / "d"))
    df.select(F.col("key").alias("q")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("q bigint").parquet(str(tmp_path / "in"))
    q = find_stream(stream, open_dataset(spark, str(tmp_path / "d")), "q").writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from found where country is not null").count() == 100


def test_bytes_asked_of_numbers_are_little_endian(spark, tmp_path):
    df = spark.createDataFrame([(3, 0x0201, 7), (3, 0x0301, 8)], "p bigint, a bigint, v bigint")
    build(df, split("p", "a"), Schema.of(v="uint")).write(str(tmp_path))
    d = open_dataset(spark, str(tmp_path))
    probes = spark.createDataFrame([(3, bytearray(b"\x01\x02")), (3, bytearray(b"\x01\x02\x00"))], "partition bigint, address binary")
    assert sorted((r.v or 0) for r in d.find(probes).collect()) == [0, 7]
    assert d.contains(probes).count() == 1 and d.missing(probes).count() == 1


def test_unsigned_keys_beyond_the_signed_range(spark, tmp_path):
    keys = [0, 5, 2**63 - 1, 2**63, 2**64 - 2**32, 2**64 - 1]
    df = spark.createDataFrame([(str(k), i) for i, k in enumerate(keys)], "k string, v bigint").select(F.col("k").cast("decimal(20,0)").alias("k"), "v")
    for bits in (0, 1, 32, 64):
        path = str(tmp_path / str(bits))
        b = build(df, keyed("k", bits), Schema.of(v="uint"))
        b.write(path)
        d = open_dataset(spark, path, verify=True)
        assert sorted(int(r.k) for r in d.records().select(d.key_column().alias("k")).collect()) == keys
        probes = spark.createDataFrame([(str(q),) for k in keys for q in (max(k - 1, 0), k, min(k + 1, 2**64 - 1))], "q string").select(F.col("q").cast("decimal(20,0)").alias("q")).distinct()
        for how in ("floor", "ceil", "upper_bound"):
            for r in d.as_of(probes, how, "q").collect():
                q = int(r.q)
                want = {"floor": max((k for k in keys if k <= q), default=None), "ceil": min((k for k in keys if k >= q), default=None), "upper_bound": min((k for k in keys if k > q), default=None)}[how]
                assert r.got_v == (None if want is None else keys.index(want)), (bits, how, q)


def test_stored_stretch_view_and_typed_build(spark, tmp_path):
    df = spark.createDataFrame([(i, i << 16, i) for i in range(1, 300)], "p bigint, a bigint, v bigint").withColumn("p", F.lit(0).cast("bigint"))
    b = build(df, split("p", "a"), Schema.of(v="uint"))
    b.write(str(tmp_path))
    d = open_dataset(spark, str(tmp_path))
    assert {(r.skip, r.stored == r.v) for r in d.stored().collect()} == {(2, True)}
    b.view("kept")
    assert spark.sql("select count(*) from kept").first()[0] == 299
    t = TypedKey(lambda ip: (F.conv(F.hex(F.substring(ip, 1, 1)), 16, 10).cast("bigint") % 8, F.substring(ip, 2, 15)))
    rng = random.Random(777)
    ips = spark.createDataFrame([(bytearray(rng.randbytes(16)), i) for i in range(50)], "ip binary, v bigint")
    t.build(ips, ["ip"], Schema.of(v="uint")).write(str(tmp_path / "w"))
    w = open_dataset(spark, str(tmp_path / "w"), verify=True)
    assert {r.v for r in w.find(t.probes(ips.select("ip"), "ip")).collect()} == set(range(50))


def test_same_records_in_every_layout(spark, tmp_path):
    df = countries(spark, 400, 30)
    rows = []
    for i, (key, o) in enumerate((k, o) for k in (keyed("key", 8), keyed("key", 64)) for o in (Options(interning="always"), Options(interning="never", trim=False), Options(interning="always", remap=False, align=True))):
        build(df, key, COUNTRY, o).write(str(tmp_path / str(i)))
        d = open_dataset(spark, str(tmp_path / str(i)))
        rows.append(sorted(d.records().select(d.key_column().alias("key"), *COUNTRY.names).collect()))
    assert all(r == rows[0] for r in rows) and len(rows[0]) == 400
