"""A training-data pipeline over `documents`: each stage is written as Parquet and read again as the next one's input.

All stages but the last return the columns of documents: texts of no language go, one document of each group of near copies (five-word Jaccard of 0.8 or more) stays, documents that
leak a benchmark item go, secrets are replaced by their kind, and the last stage adds the token ids to what is left.

Rows are decided one by one, whatever their doc_id: rows that repeat an id, or have none, are documents of their own. A null or empty text is no evidence against a language
and stays; of several texts without words one stays; it leaks nothing and has no secrets; a null text has null token_ids and n_tokens, an empty one none and 0. Texts are
read whole at any length. Of near copies the smallest doc_id stays, of equal ones the first row, a null id last. n_chars stays null where it is null. Columns that documents has beside its own are
kept, but token_ids and n_tokens of the last stage replace columns of those names. An empty table gives an empty one with the columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, decontaminate, language, near_copies, secrets
from tessella.llm.common import prepare, remove, shared_dir, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text without its secrets; n_chars follows it."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else clean


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = F.col("token_ids")
    return byte_bpe.encode(docs, "text", "token_ids").withColumn("n_tokens", F.when(ids.isNotNull(), F.size(ids).cast("long")))


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("tokens", token_stage),
]
#: Language models, XXH64 fingerprints and BPE have no SQL; tests/llm/test_pipeline.py holds run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole of documents, with what is between them in the shared folder; a stage's rows are removed when the next one's are written."""
    prepare(spark)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs
