"""All registered queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import answer_jobs, case_jobs, catalog, index_jobs, other_jobs, rank_jobs, report_jobs, stream_jobs, telemetry_jobs, text_jobs  # noqa: F401


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLE_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.QUERIES["hybrid_search"](spark, sf_dir)
