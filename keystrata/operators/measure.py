"""Aggregates that the layout is decided from; one row per partition at most goes on, one row comes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.widths import byte_used, exact_width_for, negative_zero, width_column
from ..plans.layout import FieldLayout, field_layouts, ref_width
from ..plans.model import SPARK_TYPES, BuildError, Measures, Options, Schema
from ..sources.storage import ensure_checkpoints


FLOATS = ("f32", "f64")


def tuple_key(schema: Schema) -> Column:
    """The whole value tuple; -0.0 and 0.0 differ, as their bits do, and all NaNs are alike."""
    each = lambda f: F.struct(F.col(f.name).alias("v"), negative_zero(F.col(f.name)).alias("z")).alias(f.name) if f.kind in FLOATS else F.col(f.name)
    return F.struct(*map(each, schema.fields))


def duplicate_keys(records: DataFrame, partition: str = "partition", address: str = "address") -> DataFrame:
    """Keys that occur more than once, and how often."""
    return records.groupBy(partition, address).agg(F.count("*").alias("n")).where("n > 1")


def field_ranges(records: DataFrame, schema: Schema) -> DataFrame:
    """One row per uint or sint field: least and most value, width and bias."""
    names = [f.name for f in schema.fields if f.kind in ("uint", "sint")]
    one = records.agg(*(f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))))
    rows = F.array(*(F.struct(F.lit(n).alias("field"), F.coalesce(F.col(f"lo_{n}"), F.lit(0)).cast("bigint").alias("lo"), F.coalesce(F.col(f"hi_{n}"), F.lit(0)).cast("bigint").alias("hi")) for n in names))
    return one.select(F.explode(rows).alias("r")).select("r.field", "r.lo", "r.hi", width_column(F.col("r.hi") - F.col("r.lo")).alias("width"))


def text_dictionary(records: DataFrame, name: str) -> DataFrame:
    """Distinct texts with dense ids in the texts' order.

    Ids count up from how many distinct texts come before, summed over ranges, so no task orders all of them.
    """
    return dense_ids(records.select(F.col(name).alias("text")).distinct(), ["text"], "dict_id")


def dense_ids(distinct: DataFrame, by: list[str], name: str) -> DataFrame:
    """Ids 0, 1, 2, ... in the order of ``by``: the place within a range partition plus the rows in those before it.

    The range partitions are frozen by a checkpoint, so both parts count the same rows.
    """
    ensure_checkpoints(distinct.sparkSession)
    ranged = distinct.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*by)))
    rows = inside.join(counts.withColumn("__before", before).drop("__n"), "__part")
    return rows.withColumn(name, (F.col("__k") - 1 + F.col("__before")).cast("bigint")).drop("__part", "__k", "__before")


def remap_table(records: DataFrame, value_id: str = "value_id") -> DataFrame:
    """``partition, local_id, value_id``: each partition's own numbers for the values it uses, by first address."""
    used = records.groupBy("partition", value_id).agg(F.min("address").alias("__first"))
    order = Window.partitionBy("partition").orderBy("__first")
    return used.withColumn("local_id", (F.row_number().over(order) - 1).cast("bigint")).drop("__first")


def distinct_tuples(records: DataFrame, schema: Schema) -> DataFrame:
    """One row for each value tuple, as ``tuple_key`` tells them apart; the zeros get their signs back, which grouping drops."""
    floats = [f for f in schema.fields if f.kind in FLOATS]
    rows = records.select(*schema.names, *(negative_zero(F.col(f.name)).alias(f"__z_{f.name}") for f in floats)).distinct()
    for f in floats:
        rows = rows.withColumn(f.name, F.when(F.col(f"__z_{f.name}"), F.lit(-0.0).cast(SPARK_TYPES[f.kind])).otherwise(F.col(f.name)))
    return rows.select(*schema.names)


def same_tuple(a: DataFrame, b: DataFrame, schema: Schema) -> Column:
    """Whether rows of two tables hold the same value tuple."""
    out = F.lit(True)
    for f in schema.fields:
        out = out & a[f.name].eqNullSafe(b[f.name])
        if f.kind in FLOATS:
            out = out & (negative_zero(a[f.name]) == negative_zero(b[f.name]))
    return out


def encoded(records: DataFrame, layout: list[FieldLayout], dictionaries: dict[str, DataFrame]) -> DataFrame:
    """``partition, address`` and the fields as a record holds them: numbers less their bias, texts as ids of their dictionary."""
    rows, out = records, []
    for i, f in enumerate(layout):
        if f.kind == "text":
            ids = dictionaries[f.name].select(F.col("text").alias(f"__t{i}"), F.col("dict_id").alias(f"__d{i}"))
            rows = rows.join(ids, F.col(f.name) == F.col(f"__t{i}"), "left")
            out.append(F.col(f"__d{i}").alias(f.name))
        else:
            out.append((F.col(f.name) - F.lit(f.bias)).alias(f.name) if f.kind in ("uint", "sint") else F.col(f.name))
    return rows.select("partition", "address", *out)


def directory(records: DataFrame, schema: Schema, width: int = 8, value: Column | None = None) -> DataFrame:
    """One row per partition: count, distinct value tuples, skip and width of the address bytes it uses."""
    kind = dict(records.dtypes)["address"]
    used = [F.max(byte_used(F.col("address"), i, kind).cast("int")) for i in range(width)]
    value = tuple_key(schema) if value is None else value
    # Distinct tuples by two plain aggregations: no partition's tuples meet in one buffer.
    tuples = records.select("partition", value.alias("v")).groupBy("partition", "v").agg(F.count("*").alias("c")).groupBy("partition").agg(F.count("*").alias("distinct"))
    flags = records.groupBy("partition").agg(F.count("*").alias("count"), F.array(*used).alias("used"), F.max("address").alias("most_address"))
    first = F.array_position("used", 1) - 1
    last = F.lit(width) - F.array_position(F.reverse("used"), 1)
    skip = F.when(F.array_contains("used", 1), first).otherwise(0).cast("int")
    wide = F.when(F.array_contains("used", 1), last - first + 1).otherwise(0).cast("int")
    return flags.join(tuples, "partition").select("partition", "count", "distinct", skip.alias("skip"), wide.alias("width"), "most_address")


def with_remap(directory: DataFrame, ref: int, enabled: bool = True) -> DataFrame:
    """Adds each partition's local reference width (0: none) and what it saves."""
    local = width_column(F.col("distinct") - 1)
    saved = F.col("count") * (F.lit(ref) - local) - 4 * F.col("distinct")
    ok = F.lit(enabled) & (local < ref) & (local <= 2) & (saved > 0)
    return directory.withColumn("remap_width", F.when(ok, local).otherwise(0)).withColumn("remap_savings", F.when(ok, saved).otherwise(F.lit(0)).cast("bigint"))


def measure(records: DataFrame, schema: Schema, options: Options, binary: bool = False) -> Measures:
    """``records``: partition, address and fields, without nulls."""
    m = Measures()
    whole = records.agg(F.count("*").alias("n"), F.max("address").alias("most"), F.max("partition").alias("most_p"), (F.max(F.octet_length("address")) if binary else F.lit(0)).alias("len")).first()
    m.records = whole.n
    if not whole.n:
        m.texts = {f.name: (0, 0) for f in schema.fields if f.kind == "text"}
        return m
    m.address_width = whole.len if binary else exact_width_for(int(whole.most))
    m.most_partition = int(whole.most_p)
    numbers = [f.name for f in schema.fields if f.kind in ("uint", "sint")]
    if numbers:
        row = records.agg(*(f(n) for n in numbers for f in (F.min, F.max))).first()
        m.ranges = {n: (int(row[2 * i]), int(row[2 * i + 1])) for i, n in enumerate(numbers)}
    for f in schema.fields:
        if f.kind == "text":
            row = records.select(f.name).distinct().agg(F.count("*"), F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0))).first()
            if row[1] >= 2**32:
                raise BuildError(f"{f.name}: the dictionary's texts take 4 GiB or more")
            m.texts[f.name] = (row[0], row[1])
    value = tuple_key(schema)
    m.distinct = records.select(value.alias("v")).distinct().count()
    if options.emulate_give_up and m.records >= options.dedup_sample and m.distinct > options.dedup_ratio * m.records:
        m.dedup_abandoned, m.distinct = True, m.records
    ref = ref_width(m.distinct)
    slots = with_remap(directory(records, schema, m.address_width if binary else 8), ref, options.remap)
    width, skip = (F.col("width"), F.col("skip")) if options.trim else (F.lit(m.address_width), F.lit(0))
    local = F.when(F.col("remap_width") > 0, F.col("remap_width")).otherwise(F.lit(ref))
    entries = F.when(F.col("remap_width") > 0, F.col("distinct")).otherwise(F.lit(0))
    block = F.col("count") * (width + local) + 4 * entries
    row = slots.agg(
        F.count("*").alias("partitions"), F.max("count").alias("most_count"), F.sum(F.col("count") * F.col("width")).alias("address_bytes"),
        F.sum(((F.col("width") != m.address_width) | (F.col("skip") != 0)).cast("int")).alias("narrowed"), F.max("skip").alias("most_skip"), F.max((F.col("width") != m.address_width).cast("int")).alias("any_trimmed"),
        F.sum((F.col("remap_width") > 0).cast("int")).alias("remapped"), F.sum("remap_savings").alias("remap_savings"), F.sum(entries).alias("remap_entries"), F.max(entries).alias("most_remap"),
        F.sum(F.col("count") * local).alias("remap_reference_bytes"), F.max_by(block, F.col("partition")).alias("last_partition_bytes"), F.max_by(F.struct(F.col("count"), (F.col("count") * width).alias("a")), F.col("partition")).alias("last"),
    ).first()
    for name in ("partitions", "most_count", "address_bytes", "narrowed", "most_skip", "remapped", "remap_savings", "remap_entries", "most_remap", "remap_reference_bytes", "last_partition_bytes"):
        setattr(m, name, int(row[name]))
    m.any_trimmed = bool(row.any_trimmed)
    stride = max((f.offset + f.width for f in field_layouts(schema, m, options.align)), default=0)
    m.last_inline_bytes = int(row["last"]["a"] + row["last"]["count"] * stride)
    return m
