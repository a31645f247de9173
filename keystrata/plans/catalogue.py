"""The queries over the driver's tables and the SQL that checks them.

Datasets over those tables: orders and events keyed by their ids with 8 address
bits; purchases, the events of one type, as a base with gaps; events by user and
time; conversations by id and turn; documents by the bytes of an MD5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.widths import address_of, byte_used, key_of, micros, partition_of, width_column
from ..operators import lookup, measure
from ..sources.storage import table
from .model import Schema

BITS = 8
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"partition": partition_of(F.col(key), BITS), "address": address_of(F.col(key), BITS)})


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "event_id")


def _purchases(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("event_type = 'purchase'")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), "o_orderkey")


def _as_of_purchase(spark: SparkSession, d: str, how: str) -> DataFrame:
    probes = _events(spark, d).select(F.col("event_id").alias("q"), "partition", "address")
    got = lookup.as_of(probes, _purchases(spark, d), how, ["event_id", "user_id", "value"], prefix="got_", repeats=False)
    return got.select("q", F.col("got_event_id").alias("k"), F.col("got_user_id").alias("user_id"), F.col("got_value").alias("value"))


def _purchase_sql(op: str) -> str:
    return f"""SELECT p.event_id AS q, b.event_id AS k, b.user_id AS user_id, b.value AS value
FROM events p ASOF LEFT JOIN (SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase') b ON p.event_id {op} b.event_id"""


# Lookups


@_query("""SELECT l.l_linenumber AS line, l.q AS q, o.o_custkey AS custkey, o.o_orderpriority AS priority
FROM (SELECT l_linenumber, l_orderkey + l_partkey AS q FROM lineitem) l LEFT JOIN orders o ON l.q = o.o_orderkey""")
def find_orders(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("line"), (F.col("l_orderkey") + F.col("l_partkey")).alias("q"))
    base = _orders(spark, d).select("partition", "address", F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"))
    return lookup.find(_keyed(probes, "q"), base, ["partition", "address"]).select("line", "q", "custkey", "priority")


@_query("SELECT q FROM (SELECT user_id * 7 AS q, event_id FROM events) p WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.event_id = p.q)")
def contains_events(spark: SparkSession, d: str) -> DataFrame:
    probes = _keyed(table(spark, d, "events").select((F.col("user_id") * 7).alias("q")), "q")
    return lookup.contains(probes, _purchases(spark, d), ["partition", "address"]).select("q")


@_query("SELECT q FROM (SELECT user_id * 7 AS q, event_id FROM events) p WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.event_id = p.q)")
def missing_events(spark: SparkSession, d: str) -> DataFrame:
    probes = _keyed(table(spark, d, "events").select((F.col("user_id") * 7).alias("q")), "q")
    return lookup.missing(probes, _purchases(spark, d), ["partition", "address"]).select("q")


@_query("SELECT e.event_id AS q, EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.event_id = e.event_id) AS found FROM events e")
def contains_flag(spark: SparkSession, d: str) -> DataFrame:
    return lookup.contains_flag(_events(spark, d).withColumnRenamed("event_id", "q"), _purchases(spark, d), ["partition", "address"]).select("q", "found")


@_query(_purchase_sql(">="))
def floor_purchase(spark: SparkSession, d: str) -> DataFrame:
    return _as_of_purchase(spark, d, "floor")


@_query(_purchase_sql("<="))
def ceil_purchase(spark: SparkSession, d: str) -> DataFrame:
    return _as_of_purchase(spark, d, "ceil")


@_query(_purchase_sql("<="))
def lower_bound_purchase(spark: SparkSession, d: str) -> DataFrame:
    return _as_of_purchase(spark, d, "lower_bound")


@_query(_purchase_sql("<"))
def upper_bound_purchase(spark: SparkSession, d: str) -> DataFrame:
    return _as_of_purchase(spark, d, "upper_bound")


@_query("""SELECT p.user_id AS q_user, epoch_us(p.ts) AS q_micros, b.user_id AS user_id, b.us AS us, b.event_id AS event_id
FROM (SELECT *, user_id::HUGEINT * 1000000000000000000 + epoch_us(ts) AS k FROM events WHERE event_type <> 'purchase') p
ASOF LEFT JOIN (SELECT user_id, epoch_us(ts) AS us, event_id, user_id::HUGEINT * 1000000000000000000 + epoch_us(ts) AS k FROM events WHERE event_type = 'purchase') b ON p.k >= b.k""")
def floor_at_user_ts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("user_id").alias("partition"), micros("ts").alias("address"))
    probes = rows.where("event_type <> 'purchase'").select("partition", "address")
    got = lookup.as_of(probes, rows.where("event_type = 'purchase'"), "floor", ["event_id"], prefix="got_", strategy="window", repeats=False)
    return got.select(F.col("partition").alias("q_user"), F.col("address").alias("q_micros"), F.col("got_partition").alias("user_id"), F.col("got_address").alias("us"), F.col("got_event_id").alias("event_id"))


_WIDE = "SELECT doc_id, lang, substr(md5(doc_id::VARCHAR), 1, 4) AS p, substr(md5(doc_id::VARCHAR), 5) AS a FROM documents"


def _wide(spark: SparkSession, d: str, how: str) -> DataFrame:
    raw = F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary")))
    rows = table(spark, d, "documents").select("doc_id", "lang", F.conv(F.hex(F.substring(raw, 1, 2)), 16, 10).cast("bigint").alias("partition"), F.substring(raw, 3, 14).alias("address"))
    base, probes = rows.where("lang = 'en'"), rows.withColumnRenamed("doc_id", "q")
    got = lookup.as_of(probes, base, how, ["doc_id"], prefix="got_", repeats=False)
    return got.select("q", F.col("got_doc_id").alias("doc_id"))


def _wide_sql(op: str) -> str:
    return f"SELECT p.doc_id AS q, b.doc_id AS doc_id FROM ({_WIDE}) p ASOF LEFT JOIN (SELECT doc_id, p || a AS k FROM ({_WIDE}) WHERE lang = 'en') b ON p.p || p.a {op} b.k"


@_query(_wide_sql(">="))
def floor_wide_md5(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "floor")


@_query(_wide_sql("<="))
def ceil_wide_md5(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "ceil")


@_query(_wide_sql("<"))
def upper_bound_wide_md5(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "upper_bound")


@_query("""SELECT p.event_id AS q, b.event_id AS start, b.value AS value FROM events p
ASOF JOIN (SELECT event_id, value, lead(event_id) OVER (ORDER BY event_id) AS stop FROM events WHERE event_type = 'purchase') b ON p.event_id >= b.event_id""")
def containment(spark: SparkSession, d: str) -> DataFrame:
    """The range that holds each probe: ranges begin at purchases and end before the next."""
    return _as_of_purchase(spark, d, "floor").where("k is not null").select("q", F.col("k").alias("start"), "value")


# Scans


@_query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS rank FROM events")
def scan_forward(spark: SparkSession, d: str) -> DataFrame:
    return lookup.ranked_scan(_events(spark, d)).select("event_id", "rank")


@_query("SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS rank FROM events")
def scan_reverse_rank(spark: SparkSession, d: str) -> DataFrame:
    return lookup.ranked_scan(_events(spark, d), reverse=True).select("event_id", "rank")


@_query("SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS prev, lead(event_id) OVER (ORDER BY event_id) AS next FROM events WHERE event_type = 'purchase'")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = lookup.neighbours(_purchases(spark, d))
    return rows.select("event_id", key_of(F.col("prev_partition"), F.col("prev_address"), BITS).alias("prev"), key_of(F.col("next_partition"), F.col("next_address"), BITS).alias("next"))


@_query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def turn_steps(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(order).alias("before"))


@_query("SELECT event_id, event_type FROM events WHERE event_id >= 300 AND event_id < 700")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return lookup.range_scan(table(spark, d, "events"), 300, 700, "event_id").select("event_id", "event_type")


@_query("SELECT min(event_id) AS first_key, max(event_id) AS last_key FROM events WHERE event_type = 'purchase'")
def key_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = lookup.bounds(_purchases(spark, d))
    return b.select(key_of(F.col("first_partition"), F.col("first_address"), BITS).alias("first_key"), key_of(F.col("last_partition"), F.col("last_address"), BITS).alias("last_key"))


# Keys


@_query("SELECT o_orderkey, o_orderkey >> 8 AS partition, o_orderkey & 255 AS address, ((o_orderkey >> 8) << 8) | (o_orderkey & 255) AS key FROM orders")
def split_join_key(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", "partition", "address", key_of(F.col("partition"), F.col("address"), BITS).alias("key"))


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return measure.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


# Measures

_WIDTH = "CASE WHEN {0} <= 255 THEN 1 WHEN {0} <= 65535 THEN 2 WHEN {0} <= 4294967295 THEN 4 ELSE 8 END"


def _stats_sql(name: str, value: str, source: str) -> str:
    w = _WIDTH.format("(max(x) - min(x))")
    return f"SELECT '{name}' AS field, min(x)::BIGINT AS lo, max(x)::BIGINT AS hi, {w} AS width FROM (SELECT {value} AS x FROM {source})"


@_query(" UNION ALL ".join(_stats_sql(n, n, s) for n, s in (("o_orderkey", "orders"), ("o_custkey", "orders"))))
def field_stats(spark: SparkSession, d: str) -> DataFrame:
    return measure.field_ranges(table(spark, d, "orders"), Schema.of(o_orderkey="uint", o_custkey="uint"))


@_query(_stats_sql("cents", "CAST(round(c_acctbal * 100) AS BIGINT)", "customer"))
def sint_stats(spark: SparkSession, d: str) -> DataFrame:
    cents = table(spark, d, "customer").select(F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"))
    return measure.field_ranges(cents, Schema.of(cents="sint"))


@_query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS entries, sum(strlen(t))::BIGINT AS bytes, {_WIDTH.format('(count(*) - 1)')} AS width FROM (SELECT DISTINCT {c} AS t FROM {s})" for c, s in (("event_type", "events"), ("o_orderpriority", "orders"), ("c_name", "customer"))))
def text_dictionary(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for name, source in (("event_type", "events"), ("o_orderpriority", "orders"), ("c_name", "customer")):
        texts = table(spark, d, source).select(F.col(name).alias("t")).distinct()
        rows.append(texts.agg(F.count("*").alias("entries"), F.sum(F.octet_length("t")).alias("bytes")).select(F.lit(name).alias("field"), "entries", "bytes", width_column(F.col("entries") - 1).alias("width")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@_query("SELECT text, row_number() OVER (ORDER BY text) - 1 AS dict_id FROM (SELECT DISTINCT p_brand AS text FROM part)")
def dictionary_ids(spark: SparkSession, d: str) -> DataFrame:
    return measure.text_dictionary(table(spark, d, "part"), "p_brand")


_BLOCK = "SELECT event_id, event_id >> 8 AS p, event_id & 255 AS a, event_id // 100 AS block, event_type FROM events"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("partition", "address", "event_id", F.floor(F.col("event_id") / 100).alias("block"), "event_type")


_BLOCK_SCHEMA = Schema.of(block="uint", event_type="text")


@_query(f"SELECT count(*) AS distinct_values, {_WIDTH.format('(count(*) - 1)')} AS ref_width FROM (SELECT DISTINCT block, event_type FROM ({_BLOCK}))")
def distinct_tuples(spark: SparkSession, d: str) -> DataFrame:
    n = measure.distinct_tuples(_blocks(spark, d), _BLOCK_SCHEMA).agg(F.count("*").alias("distinct_values"))
    return n.select("distinct_values", width_column(F.col("distinct_values") - 1).alias("ref_width"))


@_query(f"SELECT block, event_type, row_number() OVER (ORDER BY block, event_type) - 1 AS value_id FROM (SELECT DISTINCT block, event_type FROM ({_BLOCK}))")
def dictionary_values(spark: SparkSession, d: str) -> DataFrame:
    return measure.dense_ids(measure.distinct_tuples(_blocks(spark, d), _BLOCK_SCHEMA), ["block", "event_type"], "value_id")


@_query("SELECT o_orderkey >> 8 AS partition, count(*) AS count FROM orders GROUP BY ALL")
def directory(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).groupBy("partition").agg(F.count("*").alias("count"))


@_query(f"SELECT p AS partition, count(*) AS count, count(DISTINCT (block, event_type)) AS \"distinct\" FROM ({_BLOCK}) GROUP BY ALL")
def partition_distinct(spark: SparkSession, d: str) -> DataFrame:
    return measure.directory(_blocks(spark, d), _BLOCK_SCHEMA).select("partition", "count", "distinct")


_REMAP = f"""WITH r AS ({_BLOCK}), u AS (SELECT {_WIDTH.format('(count(*) - 1)')} AS ref FROM (SELECT DISTINCT block, event_type FROM r)),
s AS (SELECT p AS partition, count(*) AS count, count(DISTINCT (block, event_type)) AS n FROM r GROUP BY ALL),
t AS (SELECT s.*, ref, {_WIDTH.format('(n - 1)')} AS w FROM s, u),
v AS (SELECT *, w < ref AND w <= 2 AND count * (ref - w) > 4 * n AS ok FROM t)"""


@_query(f"{_REMAP} SELECT partition, count, n AS \"distinct\", CASE WHEN ok THEN w ELSE 0 END AS remap_width, CASE WHEN ok THEN count * (ref - w) - 4 * n ELSE 0 END AS remap_savings FROM v")
def remap_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = _blocks(spark, d)
    n = measure.distinct_tuples(rows, _BLOCK_SCHEMA).count()
    slots = measure.with_remap(measure.directory(rows, _BLOCK_SCHEMA), measure.ref_width(n))
    return slots.select("partition", "count", "distinct", "remap_width", "remap_savings")


@_query(f"""{_REMAP}, m AS (SELECT count(*) AS n, {_WIDTH.format('max(block)')} AS bw FROM r), x AS (SELECT count(*) AS u FROM (SELECT DISTINCT block, event_type FROM r)),
a AS (SELECT sum(CASE WHEN b = 0 THEN 0 ELSE 1 END * c)::BIGINT AS bytes FROM (SELECT bit_or(a) AS b, count(*) AS c FROM r GROUP BY p)),
e AS (SELECT bytes, n, u, bw + 1 AS stride, ref, (SELECT coalesce(sum(count * (v.ref - w) - 4 * n), 0)::BIGINT FROM v WHERE ok) AS saved FROM m, x, a, u)
SELECT n AS records, u AS distinct_values, stride AS value_stride, ref AS ref_width, bytes + n * stride AS inline_estimate, greatest(bytes + n * ref + 16 + u * stride - saved, 0) AS interned_estimate,
greatest(bytes + n * ref + 16 + u * stride - saved, 0) < bytes + n * stride AS interned FROM e""")
def interning_cost(spark: SparkSession, d: str) -> DataFrame:
    from .layout import decide
    from .model import Options

    report, _ = decide(_BLOCK_SCHEMA, measure.measure(_blocks(spark, d).drop("event_id"), _BLOCK_SCHEMA, Options()), Options())
    names = ["records", "distinct_values", "value_stride", "ref_width", "inline_estimate", "interned_estimate", "interned"]
    return spark.createDataFrame([tuple(getattr(report, n) for n in names)], "records bigint, distinct_values bigint, value_stride int, ref_width int, inline_estimate bigint, interned_estimate bigint, interned boolean")


_TRIM = "SELECT o_orderkey >> 8 AS p, CASE WHEN (o_orderkey >> 8) % 2 = 0 THEN (o_orderkey & 255) << 16 ELSE o_orderkey & 255 END AS a FROM orders"


@_query(f"""SELECT p AS partition, count(*) AS count,
CASE WHEN bit_or(a) = 0 THEN 0 WHEN bit_or(a) & 255 <> 0 THEN 0 WHEN bit_or(a) & 65280 <> 0 THEN 1 ELSE 2 END AS skip,
CASE WHEN bit_or(a) = 0 THEN 0 ELSE (CASE WHEN bit_or(a) > 65535 THEN 3 WHEN bit_or(a) > 255 THEN 2 ELSE 1 END) - (CASE WHEN bit_or(a) & 255 <> 0 THEN 0 WHEN bit_or(a) & 65280 <> 0 THEN 1 ELSE 2 END) END AS width
FROM ({_TRIM}) GROUP BY p""")
def address_trim(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("partition") % 2 == 0, F.shiftleft("address", 16)).otherwise(F.col("address"))
    rows = _orders(spark, d).select("partition", a.alias("address"), F.col("o_orderstatus").alias("s"))
    return measure.directory(rows, Schema.of(s="text")).select("partition", "count", "skip", "width")


@_query(f"SELECT {', '.join(f'bool_or((a >> {8 * i}) & 255 <> 0) AS byte{i}' for i in range(4))} FROM ({_TRIM})")
def bytes_used(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("partition") % 2 == 0, F.shiftleft("address", 16)).otherwise(F.col("address"))
    return _orders(spark, d).select(a.alias("address")).agg(*(F.bool_or(byte_used(F.col("address"), i)).alias(f"byte{i}") for i in range(4)))


@_query("SELECT n AS partitions, m + 1 AS span, (m + 1 <= 1048576 AND m + 1 <= 4 * n + 16) AS dense, CASE WHEN m + 1 <= 1048576 AND m + 1 <= 4 * n + 16 THEN m + 1 ELSE n END AS slots FROM (SELECT count(DISTINCT o_orderkey >> 8) AS n, max(o_orderkey >> 8) AS m FROM orders)")
def directory_density(spark: SparkSession, d: str) -> DataFrame:
    one = _orders(spark, d).select("partition").distinct().agg(F.count("*").alias("partitions"), (F.max("partition") + 1).alias("span"))
    dense = (F.col("span") <= 1 << 20) & (F.col("span") <= 4 * F.col("partitions") + 16)
    return one.select("partitions", "span", dense.alias("dense"), F.when(dense, F.col("span")).otherwise(F.col("partitions")).alias("slots"))


# References to values


def _numbered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _blocks(spark, d)
    values = measure.dense_ids(measure.distinct_tuples(rows, _BLOCK_SCHEMA), ["block", "event_type"], "value_id")
    return rows.join(values, ["block", "event_type"]).select("partition", "address", "event_id", "value_id"), values


@_query(f"SELECT event_id, block, event_type FROM ({_BLOCK})")
def find_intern_join(spark: SparkSession, d: str) -> DataFrame:
    records, values = _numbered(spark, d)
    return records.join(values, "value_id", "left").select("event_id", "block", "event_type")


@_query(f"SELECT event_id, block, event_type FROM ({_BLOCK})")
def remap_resolve(spark: SparkSession, d: str) -> DataFrame:
    records, values = _numbered(spark, d)
    remap = measure.remap_table(records)
    local = records.join(remap, ["partition", "value_id"]).select("partition", "event_id", "local_id")
    return local.join(remap, ["partition", "local_id"], "left").join(values, "value_id", "left").select("event_id", "block", "event_type")


@_query("""WITH s AS (SELECT o_orderkey >> 8 AS p, count(*) AS c FROM orders GROUP BY 1), t AS (SELECT p, c, lag(p) OVER (ORDER BY p) AS before FROM s)
SELECT count(*) AS partitions, sum(c)::BIGINT AS records, coalesce(bool_and(before IS NULL OR before < p), true) AS increasing FROM t""")
def validate_counts(spark: SparkSession, d: str) -> DataFrame:
    slots = _orders(spark, d).groupBy("partition").agg(F.count("*").alias("c")).withColumn("address", F.lit(0))
    rows = lookup.neighbours(slots)
    before = F.col("prev_partition")
    return rows.agg(F.count("*").alias("partitions"), F.sum("c").alias("records"), F.coalesce(F.bool_and(before.isNull() | (before < F.col("partition"))), F.lit(True)).alias("increasing"))

