"""The queries of this package: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunking, decontaminate, language, language_model, mixing, quality_classifier, quality_rules, secrets, simhash, toxicity
from .base import bounded


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _beside(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_docs(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_docs(spark, sf_dir))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_docs(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_docs(spark, sf_dir), _beside(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), _beside(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_docs(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(_docs(spark, sf_dir), _beside(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.repeated_documents(_docs(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_scans, op2_language_id, op3_lm_scoring, op4_decontamination, op5_simhash, op6_toxicity, op7_quality_rules, op8_quality_classifier, op9_substring_dedup, op10_mixing,
)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _secrets_sql() -> str:
    """Matches and the gaps before them give the spans; a match counts if its group is long enough."""
    parts = []
    for kind, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, {kind} AS kind, '{r.name}' AS name, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g, string_split_regex(t, '{pattern}') AS gaps, {r.least} AS least FROM d")
    base = len(secrets.BASE_RULES)
    line = "string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(parts)}),
y AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM x WHERE len(m) > 0),
z AS (SELECT doc_id, kind, name, length(g[i]) >= least AS ok, length(m[i]) AS n, list_sum(list_transform(gaps[1:i], lambda v: length(v)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda v: length(v))), 0)::BIGINT AS a FROM y),
w AS (SELECT doc_id, kind, name, a, a + n AS b FROM z WHERE ok),
s AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {line} FILTER (kind < {base}) AS base_line, {line} AS line FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_line, '')) AS base_sha256, coalesce(line, '') AS spans FROM d LEFT JOIN s USING (doc_id)"""


_WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op1_secret_scans": _secrets_sql(),
    "op4_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD_CLASS}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD_CLASS}') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, w[k:k+l-1] AS win, l FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS k FROM (SELECT *, least(len(w), 13) AS l FROM i WHERE len(w) > 0))),
p AS (SELECT doc_id, k, l, w[k:k+l-1] AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM v) WHERE len(w) >= l)),
h AS (SELECT doc_id, k, p.l, item_id FROM p JOIN v ON p.l = v.l AND p.win = v.win),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS place FROM (SELECT DISTINCT doc_id, k, l FROM h)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS line FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(line, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)""",
}
