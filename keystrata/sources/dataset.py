"""Building, writing, opening and validating ordered key-to-record datasets.

A dataset is a folder: ``records`` sorted by range of (partition, address),
``values`` where value tuples are interned, ``directory`` with one row per
partition, ``dictionary`` with the texts of each text field and their ids, and
``manifest`` with schema, key, options and report.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.widths import address_of, decimal_address_of, decimal_key_of, decimal_partition_of, key_of, le_bytes_to_long, partition_of, trimmed
from ..operators import lookup, measure
from ..plans.layout import FieldLayout, Report, decide
from ..plans.model import NO_KEY_SPACE, SPARK_TYPES, BuildError, FormatError, Key, Options, Schema, Status
from .storage import ensure_checkpoints, read_json, write_json

MAGIC, VERSION = "keystrata", 1


@dataclass
class Built:
    """Measured records, not yet written."""

    records: DataFrame
    schema: Schema
    key: Key
    options: Options
    report: Report
    layout: list[FieldLayout]

    def values(self) -> DataFrame:
        """Distinct value tuples with dense ids in the tuples' order."""
        return measure.dense_ids(measure.distinct_tuples(self.records, self.schema), self.schema.names, "value_id")

    def view(self, name: str) -> DataFrame:
        """Keeps the records in memory, spilling to disk, under a name for SQL."""
        self.records.persist().createOrReplaceTempView(name)
        return self.records

    def write(self, path: str, dry_run: bool = False, most_bytes: int | None = None) -> Report:
        """Writes the dataset; with ``dry_run`` only the report is made, with ``most_bytes`` a larger image is refused."""
        if most_bytes is not None and self.report.image_bytes > most_bytes:
            raise BuildError(f"the image takes {self.report.image_bytes} bytes, {most_bytes} are allowed")
        if dry_run:
            return self.report
        spark = self.records.sparkSession
        binary = self.key.mode == "wide"
        rows = self.records
        if self.report.interned:
            self.values().write.mode("overwrite").parquet(f"{path}/values")
            values = spark.read.parquet(f"{path}/values")
            rows = rows.join(values, measure.same_tuple(rows, values, self.schema)).select("partition", "address", "value_id")
        rows.repartitionByRange("partition", "address").sortWithinPartitions("partition", "address").write.mode("overwrite").parquet(f"{path}/records")
        for name in _texts(self.schema):
            measure.text_dictionary(self.records, name).write.mode("overwrite").parquet(f"{path}/dictionary/{name}")
        slots = measure.directory(self.records, self.schema, self.report.address_width if binary else 8)
        measure.with_remap(slots, self.report.ref_width, self.options.remap).write.mode("overwrite").parquet(f"{path}/directory")
        write_json(spark, f"{path}/manifest", {
            "format": MAGIC, "version": VERSION, "schema": self.schema.to_dict(), "key": asdict(self.key), "address_bits": self.key.bits if self.key.has_mapping else NO_KEY_SPACE,
            "options": asdict(self.options), "report": self.report.to_dict(), "layout": [asdict(x) for x in self.layout],
        })
        return self.report


def _texts(schema: Schema) -> list[str]:
    return [f.name for f in schema.fields if f.kind == "text"]


def _default(kind: str, width: int) -> Column:
    return {"text": F.lit(""), "bytes": F.lit(b"\0" * width)}.get(kind, F.lit(0))


def _split_key(df: DataFrame, column: str, bits: int) -> tuple[Column, Column]:
    """Partition and address of a key: BIGINT, or DECIMAL(20,0) for unsigned keys of 2^63 and above."""
    whole = F.col(column)
    if dict(df.dtypes)[column] == "decimal(20,0)":
        return decimal_partition_of(whole, bits), decimal_address_of(whole, bits)
    return partition_of(whole, bits).cast("bigint"), address_of(whole, bits).cast("bigint")


def place(df: DataFrame, key: Key) -> tuple[Column, Column]:
    """The partition and address columns of a key."""
    if key.mode == "keyed":
        return _split_key(df, key.columns[0], key.bits)
    return F.col(key.columns[0]), F.col(key.columns[1])


def build(df: DataFrame, key: Key, schema: Schema, options: Options = Options()) -> Built:  # noqa: B008
    """Checks and measures ``df``; fields that are null count as zero or empty, before they are measured.

    Raises BuildError for an empty schema, columns that are missing or of another kind, null or repeated keys,
    byte addresses of different or impossible widths, and rows out of order where they were said to be sorted.
    """
    if not schema.fields:
        raise BuildError("a schema needs a field")
    kinds = dict(df.dtypes)
    for name in [*key.columns, *schema.names, *([options.sequence] if options.sequence else [])]:
        if name not in kinds:
            raise BuildError(f"no column {name!r}")
    for f in schema.fields:
        ok = {"uint": ("tinyint", "smallint", "int", "bigint"), "sint": ("tinyint", "smallint", "int", "bigint"), "f32": ("float",), "f64": ("double", "float"), "bytes": ("binary",), "text": ("string", "binary")}[f.kind]
        if kinds[f.name] not in ok and not (f.kind == "uint" and kinds[f.name].startswith("decimal")):
            raise BuildError(f"{f.name}: {kinds[f.name]} does not hold {f.kind}")
    binary = key.mode == "wide"
    if binary != (kinds[key.columns[-1]] == "binary"):
        raise BuildError("byte addresses and number addresses do not mix")
    p, a = place(df, key)
    fields = [F.coalesce(F.col(f.name), _default(f.kind, f.width)).cast(kinds[f.name] if f.kind in ("uint", "text") else SPARK_TYPES[f.kind]).alias(f.name) for f in schema.fields]
    rows = df.select(p.alias("partition"), a.alias("address"), *fields, *([F.col(options.sequence).alias("__seq")] if options.sequence else []))
    bad = [F.sum((F.col("partition").isNull() | F.col("address").isNull()).cast("int")).alias("nulls")]
    bad += [F.sum((F.octet_length(f.name) != f.width).cast("int")).alias(f"w_{f.name}") for f in schema.fields if f.kind == "bytes"]
    bad += [F.sum((F.col(f.name) < 0).cast("int")).alias(f"s_{f.name}") for f in schema.fields if f.kind == "uint"]
    bad += [F.min(F.octet_length("address")).alias("short"), F.max(F.octet_length("address")).alias("long")] if binary else [F.sum((F.col("address") < 0).cast("int")).alias("s_address")]
    found = rows.agg(*bad).first().asDict()
    if found["nulls"]:
        raise BuildError(f"{found['nulls']} records have no key")
    for name, n in found.items():
        if name[:2] in ("w_", "s_") and n:
            raise BuildError(f"{name[2:]}: {n} values are {'of another width' if name[0] == 'w' else 'below zero'}")
    if binary and found["long"] is not None:
        if found["short"] != found["long"]:
            raise BuildError("byte addresses differ in width")
        if not 1 <= found["long"] <= 255:
            raise BuildError("byte addresses are 1 to 255 wide")
    resorted = options.order == "sort"
    if options.order == "assume_sorted":
        if not options.sequence:
            raise BuildError("assume_sorted needs the column that holds the order of arrival")
        worst = _out_of_order(rows)
        if worst is not None:
            raise BuildError(f"the record at {worst} is out of order or repeats a key")
    twice = measure.duplicate_keys(rows).limit(1).collect()
    if twice:
        raise BuildError(f"the key {tuple(twice[0])[:2]} occurs {twice[0].n} times")
    rows = rows.drop("__seq")
    report, layout = decide(schema, measure.measure(rows, schema, options, binary), options, key.has_mapping, resorted)
    return Built(rows, schema, key, options, report, layout)


def _out_of_order(rows: DataFrame) -> tuple | None:
    """The first key, in key order, that arrived before one that it should follow; checked within ranges and between them."""
    ensure_checkpoints(rows.sparkSession)
    ranged = rows.select("partition", "address", "__seq").repartitionByRange("partition", "address").withColumn("__part", F.spark_partition_id()).checkpoint()
    order = Window.partitionBy("__part").orderBy("partition", "address", "__seq")
    last = F.lag(F.struct("__seq", "partition", "address")).over(order)
    inside = ranged.withColumn("last", last).where((F.col("last.__seq") >= F.col("__seq")) | ((F.col("last.partition") == F.col("partition")) & (F.col("last.address") == F.col("address"))))
    hit = inside.select("partition", "address").limit(1).collect()
    if hit:
        return tuple(hit[0])
    ends = ranged.groupBy("__part").agg(F.min(F.struct("__seq", "partition", "address")).alias("lo"), F.max("__seq").alias("hi"))
    across = ends.withColumn("before", F.max("hi").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).where(F.col("before") >= F.col("lo.__seq"))
    hit = across.select("lo.partition", "lo.address").limit(1).collect()
    return tuple(hit[0]) if hit else None


class Dataset:
    """An opened dataset."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest
        self.schema = Schema.from_dict(manifest["schema"])
        k = manifest["key"]
        self.key = Key(k["mode"], tuple(k["columns"]), k["bits"])
        self.report = Report(**manifest["report"])
        self.layout = [FieldLayout(**x) for x in manifest["layout"]]

    # What it is

    size = property(lambda self: self.report.records)
    empty = property(lambda self: self.report.records == 0)
    image_size = property(lambda self: self.report.image_bytes)
    interned = property(lambda self: self.report.interned)
    has_key_mapping = property(lambda self: self.report.has_key_mapping)
    narrow_address = property(lambda self: self.key.mode != "wide")
    address_width = property(lambda self: self.report.address_width)
    trims_addresses = property(lambda self: self.report.narrowed_partitions > 0)
    partition_count = property(lambda self: self.report.partitions)

    def directory(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/directory")

    def field(self, name: str):
        return self.schema.find(name)

    # Dictionaries

    def dictionary(self, name: str) -> DataFrame:
        """``text, dict_id`` of a text field, ids in the texts' order."""
        return self.spark.read.parquet(f"{self.path}/dictionary/{name}")

    def text_ids(self, rows: DataFrame, name: str, column: str, to: str = "dict_id") -> DataFrame:
        """``rows`` with the id of the text in ``column``; null if the field has no such text."""
        ids = self.dictionary(name).select(F.col("text").alias(column), F.col("dict_id").alias(to))
        return rows.join(ids, column, "left")

    def texts(self, rows: DataFrame, name: str, column: str, to: str = "text") -> DataFrame:
        """``rows`` with the text whose id is in ``column``; null if there is none."""
        ids = self.dictionary(name).select(F.col("dict_id").alias(column), F.col("text").alias(to))
        return rows.join(ids, column, "left")

    def encoded(self) -> DataFrame:
        """The records as their layout holds them."""
        return measure.encoded(self.records(), self.layout, {n: self.dictionary(n) for n in _texts(self.schema)})

    # Reading

    def records(self) -> DataFrame:
        """Partition, address and fields; a reference without a value gives null fields."""
        rows = self.spark.read.parquet(f"{self.path}/records")
        if self.interned:
            rows = rows.join(self.spark.read.parquet(f"{self.path}/values"), "value_id", "left").drop("value_id")
        return rows.select("partition", "address", *self.schema.names)

    def read(self, name: str, kind: str) -> Column:
        """A field as ``kind``; null if there is no such field or it is of another kind."""
        f = self.schema.find(name)
        return F.col(name) if f is not None and f.kind == kind else F.lit(None).cast(SPARK_TYPES[kind]).alias(name)

    @property
    def address_type(self) -> str:
        return dict(self.spark.read.parquet(f"{self.path}/records").dtypes)["address"]

    def key_column(self) -> Column:
        """The whole key; null where there is no key space."""
        if not self.has_key_mapping:
            return F.lit(None).cast("bigint")
        join = decimal_key_of if self.address_type.startswith("decimal") else key_of
        return join(F.col("partition"), F.col("address"), self.key.bits)

    def stored(self) -> DataFrame:
        """Records with ``skip`` and ``stored``, the stretch of the address that their partition keeps."""
        slots = self.directory().select("partition", "skip", "width")
        rows = self.records().join(slots, "partition")
        return rows.withColumn("stored", trimmed(F.col("address"), F.col("skip"), F.col("width"), not self.narrow_address)).drop("width")

    def scan(self, reverse: bool = False) -> DataFrame:
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in ("partition", "address")]
        return self.records().orderBy(*order)

    def _probes(self, probes: DataFrame, key: str | None) -> DataFrame:
        """``probes`` with a partition and an address of the dataset's types; null where the probe can be no address of it.

        A key column asks nothing of a dataset without key space, a number nothing of byte addresses, a byte string
        of another length nothing at all; bytes asked of numbers are little-endian.
        """
        mine = self.address_type
        if key is not None:
            if not self.has_key_mapping:
                return probes.withColumns({"partition": F.lit(None).cast("bigint"), "address": F.lit(None).cast(mine)})
            p, a = _split_key(probes, key, self.key.bits)
            probes = probes.withColumns({"partition": p, "address": a})
        given = dict(probes.dtypes)["address"]
        if given == "binary" and mine == "binary":
            return probes.withColumn("address", F.when(F.octet_length("address") == self.address_width, F.col("address")))
        if given == "binary":
            return probes.withColumn("address", le_bytes_to_long(F.col("address"), self.address_width).cast(mine))
        return probes.withColumn("address", F.lit(None).cast("binary")) if mine == "binary" else probes.withColumn("address", F.col("address").cast(mine))

    def find(self, probes: DataFrame, key: str | None = None) -> DataFrame:
        """Exact match of a key column, or of partition and address columns; misses give null fields."""
        return lookup.find(self._probes(probes, key), self.records(), ["partition", "address"])

    def contains(self, probes: DataFrame, key: str | None = None) -> DataFrame:
        return lookup.contains(self._probes(probes, key), self.records(), ["partition", "address"])

    def missing(self, probes: DataFrame, key: str | None = None) -> DataFrame:
        return lookup.missing(self._probes(probes, key), self.records(), ["partition", "address"])

    def as_of(self, probes: DataFrame, how: str, key: str | None = None, prefix: str = "got_", **more) -> DataFrame:
        return lookup.as_of(self._probes(probes, key), self.records(), how, self.schema.names, prefix=prefix, **more)

    def floor(self, probes: DataFrame, key: str | None = None, **more) -> DataFrame:
        return self.as_of(probes, "floor", key, **more)

    def ceil(self, probes: DataFrame, key: str | None = None, **more) -> DataFrame:
        return self.as_of(probes, "ceil", key, **more)

    lower_bound = ceil

    def upper_bound(self, probes: DataFrame, key: str | None = None, **more) -> DataFrame:
        return self.as_of(probes, "upper_bound", key, **more)


def _status(spark: SparkSession, path: str, verify: bool) -> tuple[Status, dict | None]:
    try:
        manifest = read_json(spark, f"{path}/manifest")
    except (PySparkException, ValueError):
        return Status.TOO_SMALL, None
    if not manifest:
        return Status.TOO_SMALL, None
    if manifest.get("format") != MAGIC:
        return Status.BAD_MAGIC, None
    if manifest.get("version") != VERSION:
        return Status.BAD_VERSION, None
    try:
        schema = Schema.from_dict(manifest["schema"])
        k = manifest["key"]
        key, report = Key(k["mode"], tuple(k["columns"]), k["bits"]), Report(**manifest["report"])
    except (KeyError, TypeError, ValueError):
        return Status.BAD_SCHEMA, None
    bits = manifest.get("address_bits")
    if not schema.fields or not isinstance(bits, int) or not (0 <= bits <= 64 or bits == NO_KEY_SPACE) or (bits == NO_KEY_SPACE) == key.has_mapping:
        return Status.BAD_SCHEMA, None
    try:
        rows, slots = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/directory")
        want = ["partition", "address", *(["value_id"] if report.interned else schema.names)]
        if set(rows.columns) != set(want):
            return Status.BAD_SCHEMA, None
        n = rows.count()
    except AnalysisException:
        return Status.BAD_SIZE, None
    if n != report.records:
        return Status.BAD_SIZE, None
    here = slots.agg(F.count("*").alias("n"), F.countDistinct("partition").alias("d"), F.coalesce(F.sum("count"), F.lit(0)).alias("c"), F.coalesce(F.max((F.col("skip") + F.col("width") > report.address_width).cast("int")), F.lit(0)).alias("wide")).first()
    # A slot count that no density explains, or a stride that its columns don't add up to, is not this directory's.
    if report.directory_stride < 1 or report.record_stride != report.address_width + (report.ref_width if report.interned else report.value_stride):
        return Status.BAD_DIRECTORY, None
    if here.n != here.d or here.n != report.partitions or here.c != n or here.wide:
        return Status.BAD_DIRECTORY, None
    counts = rows.groupBy("partition").agg(F.count("*").alias("k"))
    if not counts.join(slots, "partition", "full").where(~F.col("k").eqNullSafe(F.col("count"))).isEmpty():
        return Status.BAD_DIRECTORY, None
    for name in _texts(schema):
        try:
            held = spark.read.parquet(f"{path}/dictionary/{name}")
        except AnalysisException:
            return Status.BAD_DICTIONARY, None
        v = held.agg(F.count("*").alias("n"), F.countDistinct("dict_id").alias("d"), F.max("dict_id").alias("m")).first()
        if set(held.columns) != {"text", "dict_id"} or v.n != v.d or (v.n and v.m != v.n - 1) or (n and not v.n):
            return Status.BAD_DICTIONARY, None
    if report.interned:
        try:
            values = spark.read.parquet(f"{path}/values")
        except AnalysisException:
            return Status.BAD_DICTIONARY, None
        v = values.agg(F.count("*").alias("n"), F.countDistinct("value_id").alias("d"), F.max("value_id").alias("m")).first()
        if set(values.columns) != {"value_id", *schema.names} or v.n != v.d or (v.n and v.m != v.n - 1):
            return Status.BAD_DICTIONARY, None
        if verify and not rows.join(values, "value_id", "left_anti").isEmpty():
            return Status.BAD_DICTIONARY, None
    if verify and not measure.duplicate_keys(rows).isEmpty():
        return Status.BAD_DIRECTORY, None
    return Status.OK, manifest


def try_open(spark: SparkSession, path: str, verify: bool = False) -> tuple[Dataset | None, Status]:
    """The dataset, or None and the first check that failed.  ``verify`` also proves keys unique and references sound."""
    status, manifest = _status(spark, path, verify)
    return (Dataset(spark, path, manifest) if manifest is not None else None), status


def open_dataset(spark: SparkSession, path: str, verify: bool = False) -> Dataset:
    found, status = try_open(spark, path, verify)
    if found is None:
        raise FormatError(status)
    return found


class TypedKey:
    """User functions from columns to (partition, address) and, if there is one, back."""

    def __init__(self, split, join=None):
        self.split, self.join = split, join

    def probes(self, df: DataFrame, *columns: str) -> DataFrame:
        p, a = self.split(*(F.col(c) for c in columns))
        return df.withColumns({"partition": p, "address": a})

    def build(self, df: DataFrame, columns: list[str], schema: Schema, options: Options = Options()) -> Built:  # noqa: B008
        """Builds from user keys; the address's type says whether it is a number or bytes."""
        placed = self.probes(df, *columns)
        mode = "wide" if dict(placed.dtypes)["address"] == "binary" else "split"
        return build(placed, Key(mode, ("partition", "address")), schema, options)

    def key(self) -> Column:
        if self.join is None:
            raise BuildError("the key has no join")
        return self.join(F.col("partition"), F.col("address"))
