"""Secret scans: an incremental ledger of content-addressed blobs.

Every version of a text is addressed by its SHA-256.  The ledger remembers which
(blob, rule, rule version) pairs have been scanned and what was found, so a run
scans only pairs that it has not seen, once per blob however many paths carry
it, and joins the findings back to all paths.  DataFrame operations only.

Defined results: a null text counts as empty; equal texts share one blob; a row
that repeats, shares an id or has none is reported as often as it occurs; an
empty table gives an empty result; very long texts are scanned whole.  Spans are
code points, end exclusive; spans that start together go by their kind, then
their end.  Only ``doc_id`` and ``text`` are read, other columns go through
under any name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import HOT_ROWS, deal_of, fresh_path, materialize, split_join


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; one counts if group ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: The base kinds, in the order in which spans of one start are listed.  Two patterns end in the character class
#: that they repeat, so a minimum length inside the pattern selects the same maximal runs as one checked afterwards.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Formats with a fixed public prefix.
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + EXTRA_RULES
_GAP = r"(?:\s|\\[nr])"
#: A key's block: up to its END line if no other dashed line comes first, else the header lines and base64 lines that
#: follow.  Blanks and written-out line ends part lines too; a short last line fills its line or ends in padding.
#: Repeats of groups are possessive, so long texts take no stack.
PEM_BLOCK = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{_GAP}++[A-Z][A-Za-z-]{{2,20}}:[^\r\n\\]*+)*+(?:{_GAP}++[A-Za-z0-9+/]{{16,}}+={{0,2}})*+"
    rf"(?:{_GAP}++[A-Za-z0-9+/]{{1,15}}+(?:={{1,2}}|(?=[ \t]*(?:[\r\n]|\\[nr]|\z))))?)"
)
#: What is masked: as ``RULES``, but a private key goes with its body.
MASK_RULES = tuple(Rule("pem", PEM_BLOCK, version=2) if r.name == "pem" else r for r in RULES)

_SCANNED = "blob string, pairs array<string>, run string"
_FOUND = "blob string, rule string, version int, start long, end long, run string"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class Ledger:
    """Three tables under ``path``: ``scanned``, a row for each blob and run with its pairs, ``found`` spans, and ``runs``.

    A run writes its findings, then its pairs, then its name.  What a run without a name has written, because it died,
    is not believed, and its pairs are scanned again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "ledger")
        for name, schema in (("scanned", _SCANNED), ("found", _FOUND), ("runs", "run string")):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def _believed(self, name: str, schema: str) -> DataFrame:
        runs = self.spark.read.schema("run string").parquet(f"{self.path}/runs")  # a name for each call of scan()
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").join(F.broadcast(runs), "run", "left_semi")

    def scanned(self) -> DataFrame:
        """``blob, pairs``: pairs are written as rule@version."""
        return self._believed("scanned", _SCANNED).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))

    def found(self) -> DataFrame:
        return self._believed("found", _FOUND).drop("run").distinct()

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> int:
        """Scans the blobs of ``versions`` for the pairs the ledger lacks; gives the number of pairs scanned."""
        run = uuid.uuid4().hex
        todo = F.array(*(F.lit(f"{r.name}@{r.version}") for r in rules))
        bodies = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
        if self.spark.read.schema("run string").parquet(f"{self.path}/runs").isEmpty():
            blobs = bodies.groupBy("blob").agg(F.first("body").alias("body")).withColumn("due", todo)
        else:
            # Addresses meet the ledger first; only texts of blobs with a pair due go on, one of each.
            due = F.array_except(todo, F.coalesce(F.col("pairs"), F.array().cast("array<string>")))
            counted = bodies.groupBy("blob").agg(F.count("*").alias("rows"))
            pending = materialize(counted.join(self.scanned(), "blob", "left").select("blob", "rows", due.alias("due")).where(F.size("due") > 0), "pending")
            first = split_join(bodies, pending, ["blob"], "rows", F.xxhash64(F.monotonically_increasing_id()))
            blobs = first.groupBy("blob").agg(F.first("body").alias("body"), F.first("due").alias("due"))
        hits = F.filter(F.array(*(self._hits(r) for r in rules)), lambda x: F.size(x["hit"]) > 0)
        # One pass over each text: its matches become rows of lengths; the text stays behind.
        none = F.array().cast("array<struct<rule:string,version:int,hit:array<struct<gap:int,len:int,ok:boolean>>>>")
        done = materialize(blobs.select("blob", "due", F.coalesce(hits, none).alias("hits")), "scan")
        each = done.select("blob", F.explode("hits").alias("h")).select("blob", F.col("h.rule"), F.col("h.version"), F.posexplode("h.hit").alias("at", "m"))
        order = Window.partitionBy("blob", "rule", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum((F.col("m.gap") + F.col("m.len")).cast("long")).over(order)
        spans = each.withColumn("end", end).where("m.ok").select("blob", "rule", "version", (F.col("end") - F.col("m.len")).alias("start"), "end", F.lit(run).alias("run"))
        spans.write.mode("append").parquet(f"{self.path}/found")
        done.select("blob", F.col("due").alias("pairs"), F.lit(run).alias("run")).write.mode("append").parquet(f"{self.path}/scanned")
        self.spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
        return done.agg(F.coalesce(F.sum(F.size("due")), F.lit(0))).first()[0]

    @staticmethod
    def _hits(rule: Rule) -> Column:
        """The gaps before and the lengths of one rule's matches, where the pair is due."""
        body, pattern = F.col("body"), F.lit(rule.pattern)
        gaps = F.transform(F.split(body, rule.pattern, -1), lambda x: F.length(x))
        whole = F.transform(F.regexp_extract_all(body, pattern, F.lit(0)), lambda x: F.length(x))
        part = F.transform(F.regexp_extract_all(body, pattern, F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
        rows = F.zip_with(F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("len")), part, lambda x, ok: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), ok.alias("ok")))
        there = F.array_contains("due", f"{rule.name}@{rule.version}") & body.rlike(rule.pattern)
        empty = F.array().cast("array<struct<gap:int,len:int,ok:boolean>>")
        return F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), F.when(there, rows).otherwise(empty).alias("hit"))

    def paths(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
        """The rows of ``versions`` with ``blob`` and ``findings``, an array of (start, kind, rule, end) in span order.

        ``kind`` is the rule's place in ``rules``.  The paths of a blob that very many carry are dealt over several tasks.
        """
        current = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(i).alias("kind")) for i, r in enumerate(rules)))
        kinds = self.spark.range(1).select(F.explode(current).alias("r")).select("r.*")
        digest = self.found().join(F.broadcast(kinds), ["rule", "version"]).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "rule", "end"))).alias("findings"))
        marked = versions.withColumn("blob", blob_of(F.col(text)))
        many = marked.groupBy("blob").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_ROWS)
        digest = materialize(digest.join(many, "blob", "left").withColumn("rows", F.coalesce("rows", F.lit(1))), "findings")
        return split_join(marked, digest, ["blob"], "rows", deal_of(versions, (text,)), "left").select(*versions.columns, "blob", "findings")


def _joined(findings: Column) -> Column:
    return F.concat_ws(",", F.transform(findings, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))))


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, path: str | None = None) -> DataFrame:
    """One row per document: its id, its counts of base kinds, and its spans."""
    ledger = Ledger(docs.sparkSession, path)
    slim = docs.select("doc_id", "text")
    ledger.scan(slim, rules)
    rows = ledger.paths(slim, rules).drop("text")
    none = F.array().cast("array<struct<start:bigint,kind:int,rule:string,end:bigint>>")
    rows = rows.select("doc_id", F.coalesce("findings", none).alias("findings"))
    base = F.filter("findings", lambda x: x["kind"] < len(BASE_RULES))
    of = lambda kind: F.filter("findings", lambda x: x["kind"] == kind)
    counts = [F.size(of(i)).cast("long").alias(f"n_{r.name}") for i, r in enumerate(BASE_RULES)]
    return rows.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = MASK_RULES, mark: str = "[secret]", path: str | None = None) -> DataFrame:
    """``docs`` with every span found replaced by ``mark`` (overlapping spans by one); all rows and columns stay."""
    ledger = Ledger(docs.sparkSession, path)
    keyed = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), F.col("text"))
    ledger.scan(keyed, rules)
    rows = ledger.paths(keyed, rules)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("made"))

    def step(acc: Column, x: Column) -> Column:
        cut = F.col("text").substr((acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        made = F.when(x["start"] >= acc["at"], F.concat(acc["made"], cut, F.lit(mark))).otherwise(acc["made"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), made.alias("made"))

    def close(acc: Column) -> Column:
        return F.concat(acc["made"], F.col("text").substr((acc["at"] + 1).cast("int"), F.length("text")))

    clean = F.when(F.col("findings").isNull(), F.col("text")).otherwise(F.aggregate("findings", start, step, close))
    return rows.withColumn("text", clean).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
