"""Queries over datasets that are built, written and opened again, and the SQL that checks them.

Each dataset is written once a session under the shared folder, from whole
tables: purchases and all events by event id, inline and interned; orders with a
field of every kind; documents by the bytes of an MD5; events beyond the signed
range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.widths import byte_used, exact_width_for, ipv4, untrimmed, width_for
from ..operators import lookup
from ..sources import dataset
from ..sources.storage import fresh_path, read_json, table, write_json
from .catalogue import _WIDTH, Query
from .layout import dictionary_size
from .model import BuildError, Key, Options, Schema, keyed, split, wide

BITS = 8
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_paths: dict[tuple[str, str, str], str] = {}


def _query(name: str, sql: str):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return put


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    raw = F.unhex(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 12))
    return rows.select(
        F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), (5000 - F.col("o_custkey")).alias("below"), F.col("o_totalprice").cast("float").alias("single"),
        F.when(F.col("o_orderstatus") == "F", F.lit(-0.0)).when(F.col("o_orderstatus") == "O", F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("price"), raw.alias("tag"), F.col("o_orderpriority").alias("priority"),
    )


ALL_KINDS = Schema.of(cust="uint", below="sint", single="f32", price="f64", tag="bytes6", priority="text")


def _places(spark: SparkSession, d: str) -> DataFrame:
    raw = F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.conv(F.hex(F.substring(raw, 1, 2)), 16, 10).cast("bigint").alias("partition"), F.substring(raw, 3, 14).alias("address"))


def _unsigned(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select((F.col("event_id").cast("decimal(20,0)") * 3 + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)").alias("key"), "event_id")


_PURCHASES = Schema.of(user_id="uint", event_type="text")
_FEW = Schema.of(event_type="text")
BUILDS: dict[str, Callable[[SparkSession, str], dataset.Built]] = {
    "inline": lambda s, d: dataset.build(_events(s, d).where("event_type = 'purchase'"), keyed("event_id", BITS), _PURCHASES, Options(interning="never")),
    "interned": lambda s, d: dataset.build(_events(s, d).where("event_type = 'purchase'"), keyed("event_id", BITS), _PURCHASES, Options(interning="always")),
    "events": lambda s, d: dataset.build(_events(s, d), keyed("event_id", BITS), _FEW),
    "kinds": lambda s, d: dataset.build(_orders(s, d), keyed("key", 12), ALL_KINDS, Options(interning="never")),
    "kinds_interned": lambda s, d: dataset.build(_orders(s, d), keyed("key", 12), ALL_KINDS, Options(interning="always")),
    "wide": lambda s, d: dataset.build(_places(s, d).where("lang = 'en'"), wide("partition", "address"), Schema.of(id="uint")),
    "unsigned": lambda s, d: dataset.build(_unsigned(s, d), keyed("key", 32), Schema.of(event_id="uint")),
    "split": lambda s, d: dataset.build(table(s, d, "orders").select((F.col("o_orderkey") % 16).alias("p"), (F.floor(F.col("o_orderkey") / 16) * 256).alias("a"), F.col("o_custkey").alias("cust")), split("p", "a"), Schema.of(cust="uint")),
}


def stored(spark: SparkSession, d: str, name: str) -> dataset.Dataset:
    """The dataset ``name`` over the tables in ``d``, opened; built and written where this session hasn't."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _paths:
        path = fresh_path(spark, f"dataset-{name}")
        BUILDS[name](spark, d).write(path)
        _paths[key] = path
    return dataset.open_dataset(spark, _paths[key])


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Places between the events' ids, among them and beyond the last."""
    return table(spark, d, "events").select((F.col("event_id") * 2 - F.col("event_id") % 2).alias("q"))


# Exact and ordered lookups

_ASKED = "SELECT event_id * 2 - event_id % 2 AS q FROM events"
_BASE = "(SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase')"
_HOWS = {"floor": ">=", "ceil": "<=", "lower_bound": "<=", "upper_bound": "<"}

for _form in ("inline", "interned"):

    @_query(f"dataset_find_{_form}", f"SELECT q, user_id, event_type FROM ({_ASKED}) LEFT JOIN {_BASE} ON q = event_id")
    def _find(spark: SparkSession, d: str, form: str = _form) -> DataFrame:
        return stored(spark, d, form).find(_asked(spark, d), "q").select("q", "user_id", "event_type")

    for _how, _op in _HOWS.items():

        @_query(f"dataset_{_how}_{_form}", f"SELECT q, b.event_id AS key, user_id, event_type FROM ({_ASKED}) p ASOF LEFT JOIN {_BASE} b ON q {_op} b.event_id")
        def _as_of(spark: SparkSession, d: str, form: str = _form, how: str = _how) -> DataFrame:
            got = getattr(stored(spark, d, form), how)(_asked(spark, d), "q")
            return got.select("q", (F.col("got_partition") * (1 << BITS) + F.col("got_address")).alias("key"), F.col("got_user_id").alias("user_id"), F.col("got_event_type").alias("event_type"))

    @_query(f"dataset_records_{_form}", "SELECT event_id AS key, user_id, event_type FROM events WHERE event_type = 'purchase'")
    def _records(spark: SparkSession, d: str, form: str = _form) -> DataFrame:
        found = stored(spark, d, form)
        return found.records().select(found.key_column().alias("key"), "user_id", "event_type")


for _how, _op in _HOWS.items():

    @_query(f"window_{_how}", f"SELECT q, b.event_id AS key, user_id FROM ({_ASKED}) p ASOF LEFT JOIN {_BASE} b ON q {_op} b.event_id")
    def _window(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        """The way a base of any size takes."""
        got = stored(spark, d, "inline").as_of(_asked(spark, d), how, "q", strategy="window")
        return got.select("q", (F.col("got_partition") * (1 << BITS) + F.col("got_address")).alias("key"), F.col("got_user_id").alias("user_id"))


@_query("dataset_contains", f"SELECT q FROM ({_ASKED}) WHERE q IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def dataset_contains(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "inline").contains(_asked(spark, d), "q").select("q")


@_query("dataset_missing", f"SELECT q FROM ({_ASKED}) WHERE q NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def dataset_missing(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "inline").missing(_asked(spark, d), "q").select("q")


@_query("dataset_scan_rank", "SELECT event_id AS key, row_number() OVER (ORDER BY event_id) AS rank, row_number() OVER (ORDER BY event_id DESC) AS back FROM events WHERE event_type = 'purchase'")
def dataset_scan_rank(spark: SparkSession, d: str) -> DataFrame:
    found = stored(spark, d, "interned")
    rows = lookup.ranked_scan(lookup.ranked_scan(found.records()), reverse=True, name="back")
    return rows.select(found.key_column().alias("key"), "rank", "back")


_MD5 = "SELECT doc_id AS id, lang, substr(md5(doc_id::VARCHAR), 1, 4) AS p, substr(md5(doc_id::VARCHAR), 5) AS a FROM documents"


@_query("wide_find", f"SELECT p.id AS q, b.id AS id FROM ({_MD5}) p LEFT JOIN (SELECT * FROM ({_MD5}) WHERE lang = 'en') b ON p.p = b.p AND p.a = b.a")
def wide_find(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "wide").find(_places(spark, d).select(F.col("id").alias("q"), "partition", "address")).select("q", "id")


for _how, _op in _HOWS.items():

    @_query(f"wide_{_how}", f"SELECT p.id AS q, b.id AS id FROM ({_MD5}) p ASOF LEFT JOIN (SELECT id, p || a AS k FROM ({_MD5}) WHERE lang = 'en') b ON p.p || p.a {_op} b.k")
    def _wide(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        got = getattr(stored(spark, d, "wide"), how)(_places(spark, d).select(F.col("id").alias("q"), "partition", "address"))
        return got.select("q", F.col("got_id").alias("id"))


@_query("wide_key_space", f"SELECT count(*) AS records, count(DISTINCT p) AS partitions, 14 AS address_width, 0 AS key_hits, 0 AS number_hits, 0 AS short_hits, count(*) AS whole_hits FROM ({_MD5}) WHERE lang = 'en'")
def wide_key_space(spark: SparkSession, d: str) -> DataFrame:
    """Without a key space a key, a number or a byte string of another length finds nothing; whole addresses do."""
    found, rows = stored(spark, d, "wide"), _places(spark, d).where("lang = 'en'")
    one = found.records().agg(F.count("*").alias("records"), F.countDistinct("partition").alias("partitions"), F.max(F.octet_length("address")).alias("address_width"))
    hits = {
        "key": found.contains(rows.select(F.col("id").alias("q")), "q"), "number": found.contains(rows.select("partition", F.col("id").alias("address"))),
        "short": found.contains(rows.select("partition", F.substring("address", 1, 13).alias("address"))), "whole": found.contains(rows.select("partition", "address")),
    }
    for name, df in hits.items():
        one = one.join(F.broadcast(df.agg(F.count("*").alias(f"{name}_hits"))))  # two tables of one row each
    return one


@_query("bytes_asked_of_numbers", "SELECT o_custkey AS cust, o_orderkey AS key FROM orders WHERE (o_orderkey // 16) < 65536")
def bytes_asked_of_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Little-endian byte strings of the address's width find its records."""
    found = stored(spark, d, "split")
    digits = F.lpad(F.hex(F.floor(F.col("o_orderkey") / 16) * 256), 2 * found.address_width, "0")
    little = F.concat(*(F.unhex(F.substring(digits, 2 * i + 1, 2)) for i in reversed(range(found.address_width))))
    probes = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 16).alias("partition"), little.alias("address"))
    return found.find(probes).where("key < 16 * 65536").select("key", "cust")


@_query("unsigned_floor", "SELECT q::VARCHAR AS q, b.event_id AS event_id FROM (SELECT event_id::HUGEINT * 5 + 9223372036854775800 AS q FROM events) p ASOF LEFT JOIN (SELECT event_id, event_id::HUGEINT * 3 + 9223372036854775808 AS k FROM events) b ON q >= k")
def unsigned_floor(spark: SparkSession, d: str) -> DataFrame:
    probes = _events(spark, d).select((F.col("event_id").cast("decimal(20,0)") * 5 + F.lit(str(2**63 - 8)).cast("decimal(20,0)")).cast("decimal(20,0)").alias("q"))
    return stored(spark, d, "unsigned").floor(probes, "q").select(F.col("q").cast("string").alias("q"), F.col("got_event_id").alias("event_id"))


# Typed access

_KINDS = """SELECT o_orderkey AS key, o_custkey AS cust, 5000 - o_custkey AS below, o_totalprice::FLOAT::DOUBLE AS single,
CASE WHEN o_orderstatus IN ('F', 'O') THEN 0.0 ELSE o_totalprice END AS price, o_orderstatus = 'F' AS minus, lower(substr(md5(o_orderkey::VARCHAR), 1, 12)) AS tag, o_orderpriority AS priority FROM orders"""

for _form in ("kinds", "kinds_interned"):

    @_query(f"typed_reads_{_form}", _KINDS)
    def _typed(spark: SparkSession, d: str, form: str = _form) -> DataFrame:
        found = stored(spark, d, form)
        rows = found.records().select(found.key_column().alias("key"), *(found.read(f.name, f.kind) for f in ALL_KINDS.fields))
        minus = F.col("price").cast("string").startswith("-")
        return rows.select("key", "cust", "below", F.col("single").cast("double").alias("single"), F.abs("price").alias("price"), minus.alias("minus"), F.lower(F.hex("tag")).alias("tag"), "priority")


@_query("wrong_kinds_are_null", "SELECT name, kind, (SELECT count(*) FROM orders) AS records, CASE WHEN name = 'zzz' OR kind <> own THEN 0 ELSE (SELECT count(*) FROM orders) END AS read FROM (VALUES ('cust', 'uint'), ('below', 'sint'), ('single', 'f32'), ('price', 'f64'), ('tag', 'bytes'), ('priority', 'text'), ('zzz', 'none')) f(name, own), (VALUES ('uint'), ('sint'), ('f32'), ('f64'), ('bytes'), ('text')) k(kind)")
def wrong_kinds_are_null(spark: SparkSession, d: str) -> DataFrame:
    """How many values each field, and one that isn't there, gives when read as each kind."""
    found, kinds = stored(spark, d, "kinds"), ("uint", "sint", "f32", "f64", "bytes", "text")
    cells = [F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.count("*").alias("records"), F.count(found.read(n, k)).alias("read")) for n in (*ALL_KINDS.names, "zzz") for k in kinds]
    return found.records().agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


_FIELD_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, min({x}) AS lo, max({x}) AS hi FROM orders" for n, x in (("cust", "o_custkey"), ("below", "5000 - o_custkey")))


@_query("tuple_encoding", "SELECT o_orderkey AS key, o_custkey - (SELECT min(o_custkey) FROM orders) AS cust, (SELECT max(o_custkey) FROM orders) - o_custkey AS below, (SELECT count(DISTINCT x.o_orderpriority) FROM orders x WHERE x.o_orderpriority < o.o_orderpriority) AS priority FROM orders o")
def tuple_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Numbers less their bias, texts as ids of their dictionary."""
    found = stored(spark, d, "kinds")
    return found.encoded().select(found.key_column().alias("key"), "cust", "below", "priority")


@_query("field_layout", f"SELECT name, lo AS bias, {_WIDTH.format('(hi - lo)')} AS width FROM ({_FIELD_SQL})")
def field_layout(spark: SparkSession, d: str) -> DataFrame:
    found = stored(spark, d, "kinds")
    rows = [(f.name, f.bias, f.width) for f in found.layout if f.kind in ("uint", "sint")]
    return spark.createDataFrame(rows, "name string, bias bigint, width int")


@_query("text_to_id", "SELECT t AS text, CASE WHEN t IN (SELECT o_orderpriority FROM orders) THEN (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority < t) END AS dict_id FROM (SELECT DISTINCT o_orderpriority AS t FROM orders UNION ALL SELECT DISTINCT event_type FROM events)")
def text_to_id(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "orders").select(F.col("o_orderpriority").alias("text")).distinct().unionByName(table(spark, d, "events").select(F.col("event_type").alias("text")).distinct())
    return stored(spark, d, "kinds").text_ids(asked, "priority", "text").select("text", "dict_id")


@_query("id_to_text", "SELECT o_custkey AS key, t AS text FROM orders LEFT JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT o_orderpriority AS t FROM orders)) ON i = o_custkey % 8")
def id_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Ids beyond the dictionary give null."""
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_custkey") % 8).alias("i"))
    return stored(spark, d, "kinds").texts(asked, "priority", "i").select("key", "text")


# Addresses as they are kept

_SPLIT = "SELECT o_orderkey % 16 AS p, (o_orderkey // 16) * 256 AS a, o_custkey AS cust FROM orders"


@_query("stored_addresses", f"SELECT p AS partition, a AS address, CASE WHEN w = 0 THEN 0 ELSE 1 END AS skip, CASE WHEN w = 0 THEN a ELSE a >> 8 END AS stored, a AS back FROM (SELECT *, bit_or(a) OVER (PARTITION BY p) AS w FROM ({_SPLIT}))")
def stored_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The stretch of each address that its partition keeps, and the whole address from it."""
    found = stored(spark, d, "split")
    back = untrimmed(F.col("stored"), F.col("skip"), F.lit(0), found.address_width, False)
    return found.stored().select("partition", "address", "skip", "stored", back.alias("back"))


@_query("stored_directory", f"SELECT p AS partition, count(*) AS count, max(a) AS most_address, count(DISTINCT cust) AS \"distinct\" FROM ({_SPLIT}) GROUP BY p")
def stored_directory(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "split").directory().select("partition", "count", "most_address", "distinct")


@_query("address_bytes", f"SELECT p AS partition, bool_or(a & 255 <> 0) AS byte0, bool_or((a >> 8) & 255 <> 0) AS byte1, bool_or((a >> 16) & 255 <> 0) AS byte2 FROM ({_SPLIT}) GROUP BY p")
def address_bytes(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "split").records().groupBy("partition").agg(*(F.bool_or(byte_used(F.col("address"), i)).alias(f"byte{i}") for i in range(3)))


# Reports, sinks, checks

_EXACT = "CASE WHEN {0} < 256 THEN 1 WHEN {0} < 65536 THEN 2 WHEN {0} < 16777216 THEN 3 ELSE 4 END"


@_query(
    "build_report",
    f"""WITH s AS ({_SPLIT}), v AS (SELECT count(*) AS n, count(DISTINCT cust) AS u, count(DISTINCT p) AS parts, max(a) AS most, max(cust) - min(cust) AS span FROM s),
w AS (SELECT sum(c * CASE WHEN b = 0 THEN 0 ELSE {_EXACT.format('(b >> 8)')} END)::BIGINT AS kept FROM (SELECT bit_or(a) AS b, count(*) AS c FROM s GROUP BY p)),
x AS (SELECT *, {_EXACT.format('most')} AS aw, {_WIDTH.format('(u - 1)')} AS rw, {_WIDTH.format('span')} AS vw FROM v, w)
SELECT n AS records, u AS distinct_values, parts AS partitions, aw AS address_width, rw AS ref_width, vw AS value_stride, kept AS address_bytes_total, n * aw - kept AS address_saved_bytes, kept + n * vw AS inline_estimate FROM x""",
)
def build_report(spark: SparkSession, d: str) -> DataFrame:
    r = stored(spark, d, "split").report
    names = ["records", "distinct_values", "partitions", "address_width", "ref_width", "value_stride", "address_bytes_total", "address_saved_bytes", "inline_estimate"]
    return spark.createDataFrame([tuple(getattr(r, n) for n in names)], ", ".join(f"{n} bigint" for n in names))


@_query("key_widths", f"SELECT o_custkey AS number, {_WIDTH.format('o_custkey')} AS width, {_EXACT.format('o_custkey')} AS exact FROM (SELECT DISTINCT o_custkey * 37 AS o_custkey FROM orders)")
def key_widths(spark: SparkSession, d: str) -> DataFrame:
    """The two width rules as columns, made of their values at the edges."""
    n = F.col("number")
    rule = lambda of: F.array_max(F.array(*(F.when(n >= edge, F.lit(of(edge))).otherwise(F.lit(1)) for edge in (0, *(1 << 8 * k for k in range(1, 8))))))
    return table(spark, d, "orders").select((F.col("o_custkey") * 37).alias("number")).distinct().select("number", rule(width_for).alias("width"), rule(exact_width_for).alias("exact"))


@_query("dictionary_sizes", "SELECT 'priority' AS field, count(*) AS entries, 16 + 4 * (count(*) + 1) + sum(strlen(t))::BIGINT AS bytes FROM (SELECT DISTINCT o_orderpriority AS t FROM orders)")
def dictionary_sizes(spark: SparkSession, d: str) -> DataFrame:
    row = stored(spark, d, "kinds").dictionary("priority").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return spark.createDataFrame([("priority", row.n, dictionary_size(row.n, row.b, False))], "field string, entries bigint, bytes bigint")


@_query("sinks", "SELECT * FROM (VALUES ('dry run', true, false), ('limit at the size', true, true), ('limit below the size', false, false), ('view', true, true)) t(sink, accepted, made)")
def sinks(spark: SparkSession, d: str) -> DataFrame:
    """What takes a dataset, and whether its records are there afterwards."""
    built = BUILDS["events"](spark, d)
    n, path = built.report.records, fresh_path(spark, "sinks")
    out = [("dry run", built.write(path, dry_run=True) == built.report, dataset.try_open(spark, path)[0] is not None)]
    for name, most in (("limit below the size", built.report.image_bytes - 1), ("limit at the size", built.report.image_bytes)):
        try:
            accepted = built.write(path, most_bytes=most) == built.report
        except BuildError:
            accepted = False
        opened = dataset.try_open(spark, path)[0]
        out.append((name, accepted, opened is not None and opened.records().count() == n))
    held = built.view("sinks_view")
    out.append(("view", True, spark.sql("SELECT count(*) FROM sinks_view").first()[0] == n))
    spark.catalog.dropTempView("sinks_view")
    held.unpersist()
    return spark.createDataFrame(out, "sink string, accepted boolean, made boolean")


@_query(
    "sort_policy",
    """SELECT arrival, bool_and(prev IS NULL OR prev < event_id) AS accepted, false AS sorted FROM (SELECT 'event_id' AS arrival, event_id, lag(event_id) OVER (ORDER BY event_id) AS prev FROM events
UNION ALL SELECT 'user_id', event_id, lag(event_id) OVER (ORDER BY user_id, event_id) FROM events) GROUP BY arrival UNION ALL SELECT 'any', true, true""",
)
def sort_policy(spark: SparkSession, d: str) -> DataFrame:
    """Rows that were said to arrive sorted are accepted if they do; without that they are sorted."""
    rows, out = table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") * 2**40 + F.col("event_id")).alias("user_id")), []
    for arrival in ("event_id", "user_id"):
        try:
            made = dataset.build(rows.withColumn("seq", F.col(arrival)), keyed("event_id", BITS), _FEW, Options(order="assume_sorted", sequence="seq"))
            out.append((arrival, True, made.report.sorted_during_finish))
        except BuildError:
            out.append((arrival, False, False))
    out.append(("any", True, BUILDS["events"](spark, d).report.sorted_during_finish))
    return spark.createDataFrame(out, "arrival string, accepted boolean, sorted boolean")


@_query("build_errors", "SELECT * FROM (VALUES ('repeated keys', (SELECT count(*) > count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)), ('null keys', true), ('no fields', true), ('no such column', true), ('another kind', true), ('below zero', (SELECT min(c_acctbal) < 0 FROM customer)), ('unique keys', false)) t(flaw, refused)")
def build_errors(spark: SparkSession, d: str) -> DataFrame:
    lines, events = table(spark, d, "lineitem"), _events(spark, d)
    flaws: list[tuple[str, DataFrame, Key, Schema]] = [
        ("repeated keys", lines.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "l_partkey"), split("l_orderkey", "line"), Schema.of(l_partkey="uint")),
        ("null keys", events.withColumn("event_id", F.when(F.col("user_id") >= 0, F.lit(None)).otherwise(F.col("event_id"))), keyed("event_id"), _FEW),
        ("no fields", events, keyed("event_id"), Schema()), ("no such column", events, keyed("zzz"), _FEW), ("another kind", events, keyed("event_id"), Schema.of(event_type="uint")),
        ("below zero", table(spark, d, "customer").select("c_custkey", F.floor("c_acctbal").alias("whole")), keyed("c_custkey"), Schema.of(whole="uint")), ("unique keys", events, keyed("event_id"), _FEW),
    ]
    out = []
    for flaw, df, key, schema in flaws:
        try:
            dataset.build(df, key, schema)
            out.append((flaw, False))
        except BuildError:
            out.append((flaw, True))
    return spark.createDataFrame(out, "flaw string, refused boolean")


@_query("validation", "SELECT * FROM (VALUES ('none', 'OK'), ('no folder', 'TOO_SMALL'), ('format', 'BAD_MAGIC'), ('version', 'BAD_VERSION'), ('key bits', 'BAD_SCHEMA'), ('record count', 'BAD_SIZE'), ('partition count', 'BAD_DIRECTORY'), ('stride', 'BAD_DIRECTORY'), ('lost value', 'BAD_DICTIONARY'), ('lost text', 'BAD_DICTIONARY')) t(damage, status)")
def validation(spark: SparkSession, d: str) -> DataFrame:
    """The status that a damaged copy of a dataset opens with."""
    path = fresh_path(spark, "damaged")
    BUILDS["interned"](spark, d).write(path)
    good = read_json(spark, f"{path}/manifest")
    r, out = good["report"], []

    def status(damage: str, at: str = path) -> None:
        out.append((damage, dataset.try_open(spark, at, verify=True)[1].name))

    changes = {"none": {}, "format": {"format": "other"}, "version": {"version": 99}, "key bits": {"address_bits": 65}, "record count": {"report": r | {"records": r["records"] + 1}}, "partition count": {"report": r | {"partitions": r["partitions"] + 1}}, "stride": {"report": r | {"record_stride": 99}}}
    for damage, change in changes.items():
        write_json(spark, f"{path}/manifest", good | change)
        status(damage)
    write_json(spark, f"{path}/manifest", good)
    status("no folder", f"{path}-not-there")
    for damage, part, name in (("lost text", "dictionary/event_type", "dict_id"), ("lost value", "values", "value_id")):
        held = spark.read.parquet(f"{path}/{part}")
        kept = fresh_path(spark, "kept")
        held.write.parquet(kept)
        spark.read.schema(held.schema).parquet(kept).where(F.col(name) > 0).write.mode("overwrite").parquet(f"{path}/{part}")
        status(damage)
        spark.read.schema(held.schema).parquet(kept).write.mode("overwrite").parquet(f"{path}/{part}")
    return spark.createDataFrame(out, "damage string, status string")


# Keys by functions of the user


@_query("typed_key_round_trip", "SELECT o_orderkey AS key, o_orderkey >> 4 AS high, o_orderkey & 15 AS low, o_custkey AS cust FROM orders")
def typed_key_round_trip(spark: SparkSession, d: str) -> DataFrame:
    typed = dataset.TypedKey(lambda h: (F.shiftrightunsigned(h, 4), h.bitwiseAND(F.lit(15))), lambda p, a: F.shiftleft(p, 4).bitwiseOR(a))
    path = fresh_path(spark, "typed")
    typed.build(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cust")), ["o_orderkey"], Schema.of(cust="uint")).write(path)
    return dataset.open_dataset(spark, path).records().select(typed.key().alias("key"), F.col("partition").alias("high"), F.col("address").alias("low"), "cust")


@_query("ipv4_keys", "SELECT o_orderkey AS q, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS route FROM orders")
def ipv4_keys(spark: SparkSession, d: str) -> DataFrame:
    """Dotted quads as keys, split at /16."""
    quad = F.concat_ws(".", *(F.shiftright(F.col("o_orderkey") * 257, 8 * i).bitwiseAND(F.lit(255)).cast("string") for i in (3, 2, 1, 0)))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", quad.alias("ip"))
    typed = dataset.TypedKey(lambda ip: (F.shiftrightunsigned(ipv4(ip), 16), ipv4(ip).bitwiseAND(F.lit(0xFFFF))))
    path = fresh_path(spark, "routes")
    typed.build(rows.where("o_orderstatus = 'F'").select("ip", F.col("o_orderkey").alias("route")), ["ip"], Schema.of(route="uint")).write(path)
    return dataset.open_dataset(spark, path).find(typed.probes(rows.select(F.col("o_orderkey").alias("q"), "ip"), "ip")).select("q", "route")
