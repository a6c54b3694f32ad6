"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last adds ``copy`` and
``mix_key``. Language identification learns from the folds of its own input that are not held out; rows that it rejects
have no letters or no language with at least half of their words. Near-duplicate removal keeps the document with the
smallest id of each group (five-word shingles, similarity 0.8 or more) and one of repeated rows with the same id and
text. Decontamination drops documents with a benchmark window of ten words. Secrets are masked inside the text.

Null and empty texts have no language and go with the first stage; rows without an id stay in every stage and are drawn
by the last one alike; null languages are not learnt from and null sources are one source. An empty table stays empty
with its columns. Texts of any length are worked on whole. Columns beside those of documents are passed on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from colinear.llm import decontaminate, language, mixing, near, secrets
from colinear.llm.common import shared_folder, table

MAIN_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known(docs, language.learn(docs), MAIN_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near.groups(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns).dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("mix", mix)]
ORACLE_SQL = None  # no SQL for sketches and learnt models; tests/llm/test_pipeline.py holds all rows of every stage against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages the rows are a table in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/tables/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
