"""The metrics text format as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame) -> DataFrame:
    """(name, labels map<string,string>, value) of rows (value string); comments and lines that aren't samples go."""
    sample = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)$'
    parts = lines.where(~F.col("value").startswith("#")).select(*[F.regexp_extract("value", sample, k).alias(n) for k, n in ((1, "name"), (2, "raw"), (3, "number"))]).where("name <> ''")
    keys, values = (F.regexp_extract_all("raw", F.lit(r'([a-zA-Z_]\w*)="((?:[^"\\]|\\.)*)"'), F.lit(k)) for k in (1, 2))
    return parts.select("name", F.map_from_arrays(keys, values).alias("labels"), F.col("number").try_cast("double").alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))
