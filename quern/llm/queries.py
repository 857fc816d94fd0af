"""The registered queries of the corpus operators, with production parameters and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicate_report

    return near_duplicate_report(_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import repeats_report

    return repeats_report(_table(spark, sf_dir, "documents"))


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kdshard import shard_report

    return shard_report(_table(spark, sf_dir, "documents"))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brownlm import lm_report

    return lm_report(_table(spark, sf_dir, "documents"))


def op8_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linecrf import quality_report

    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiindex import neighbour_report

    return neighbour_report(_table(spark, sf_dir, "embeddings"))


def op10_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_report

    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chatformat import chat_records, chat_report

    said = "\\### Assistant: </turn> ok"
    pair = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.to_variant_object(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    return chat_report(chat_records(_table(spark, sf_dir, "conversations")).unionByName(pair))


def op13_ptolemaic_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ptolemaic import cluster_report

    return cluster_report(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_retrieval_packing": op5_retrieval_packing,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_brown_lm": op7_brown_lm,
    "op8_line_crf_quality": op8_line_crf_quality,
    "op9_inverted_multi_index": op9_inverted_multi_index,
    "op10_lexicon_toxicity": op10_lexicon_toxicity,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_ptolemaic_clustering": op13_ptolemaic_clustering,
}

#: SQL has neither XXH64, tokenizers nor the fitted models of the others; tests/llm holds those against brute force.
ORACLE_SQL = {
    "op3_benchmark_decontamination": oracles.CONTAMINATION,
    "op4_suffix_dedup": oracles.REPEATS,
    "op11_importance_resampling": oracles.RESAMPLING,
    "op12_chat_formatting": oracles.CHATS,
    "op13_ptolemaic_clustering": oracles.CLUSTERS,
}
