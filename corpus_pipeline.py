"""The corpus pipeline: from documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of docs.  ``run`` writes each stage's result to the shared folder and reads it for the next.  No part of
``run``'s result can be said in SQL (SimHash, edit verification and tokens), so ORACLE_SQL is None and the tests hold
it against a brute-force version.

Cases, for tables with nulls, repeats and further columns of any name:

* quality rules: a null or empty text has no words and goes; further columns stay as they are;
* near-dedup: rows of null doc_id all stay; of rows equal in doc_id and text one stays; empty texts are duplicates of
  each other; rows of one doc_id with different texts are judged each by its text;
* decontamination: a null or empty text holds no item and stays; an empty benchmark removes nothing;
* secret scans: null texts stay null; n_chars, where there is such a column, becomes the redacted text's length;
* packing: a null or empty text is its end id alone; rows of null doc_id are packed like any others;
* an empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import common, decontam, packing, quality, secrets, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, common.vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"stage{k}")
    return docs
