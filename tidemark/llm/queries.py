"""Queries p6 to p8: the operators on text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.garbled import find_garbled
from tidemark.llm.leaks import find_leaks
from tidemark.llm.tokens import encode_texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document's text by byte_bpe_50k."""
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with an item of which it contains at least 25 consecutive words."""
    return p7_near(spark, sf_dir).where("edits = 0").drop("edits")


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with an item of which it contains 25 consecutive words but for one edit, and the least edits found."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), max_edits=1)


P7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM eval_items),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 24], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 23)) AS p FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[p : p + 24], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 23)) AS p FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (k)
"""

def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a passage that was decoded with the wrong encoding."""
    return p8_restored(spark, sf_dir).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with the original text where it can be restored."""
    return find_garbled(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids, "p7_found": p7_found, "p7_near": p7_near, "p8_found": p8_found, "p8_restored": p8_restored}
SQL = {"p7_found": P7_SQL}
