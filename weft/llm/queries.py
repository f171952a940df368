"""The registered queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contamination
from .jaccard import jaccard_components
from .katz import katz_report
from .licenses import license_report
from .linededup import duplicate_lines
from .packing import pack
from .repetition import repetition_quality
from .sharding import shards
from .tokencount import token_counts
from .toxicity import toxicity_report


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(_read(spark, sf_dir, "documents"), words_an_edit=20).drop("row")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"), k=5, percent=75)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(_read(spark, sf_dir, "documents"), limit=16 << 20)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_report(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_repetition, op2_toxicity, op3_licenses, op4_line_dedup, op5_decontamination, op6_packing, op7_jaccard, op8_token_counts, op9_shards, op10_katz)}

#: SQL for the operators whose whole result it expresses. Words of a five-word shingle are joined by blanks, which no word holds.
ORACLE_SQL: dict[str, str] = {
    "op7_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM documents d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
