"""A training corpus from raw documents in five stages, each an operator of quern.llm.

Every stage is written as Parquet in the shared folder and read again, so a lost executor costs at most a
stage. All but the last return the columns of documents. An empty table stays empty in each; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import materialise
from quern.llm.decontaminate import drop_contaminated
from quern.llm.linecrf import drop_low_quality
from quern.llm.packing import pack
from quern.llm.secrets import redact_secrets
from quern.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labelled ones, scores below 0.7 go. Rows are judged one by one, whatever their ids; a null text is empty."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with fingerprints up to two bits apart, or of near copies, the document of the smallest id stays; rows without an id stay, rows that repeat id and text count once."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, row by row; null texts hold none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all rows stay, null texts as they are."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of at most 1024 tokens; null texts are empty, repeated rows are packed each."""
    return pack(docs)


def bounded(stage):
    """The stage, in a session whose tasks hand Python at most 2,000 documents at once."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(2000, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(stage.__name__, bounded(stage)) for stage in (quality, near_dedup, decontaminate, secrets, packing)]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
