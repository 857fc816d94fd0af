"""Stores as tables of files: replaced by document, upserted by key, restored with bad rows left out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..operators.telemetry import last_write


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir. Only a local master may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, for plans that use them more than once; it outlives lost executors."""
    path = shared_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def restore_json(spark: SparkSession, path: str, schema: StructType, required: tuple[str, ...]) -> DataFrame:
    """Rows of a JSON-lines store; rows that don't parse or lack a required field go."""
    rows = spark.read.schema(StructType([*schema.fields]).add("_bad", "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = F.col("_bad").isNull()
    for c in required:
        good = good & F.col(c).isNotNull()
    return rows.where(good).drop("_bad")


def current(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at a path, or an empty one if nothing is there; any other failure is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _store(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Complete versions of a folder's tables, the oldest first."""
    at, fs = _store(spark, f"{folder}/v*/_READY")
    return sorted(str(s.getPath().getParent().toString()) for s in fs.globStatus(at) or [])


def latest(spark: SparkSession, folder: str, name: str) -> str:
    """The path of a table in the last complete version of a folder; a path where nothing is before the first."""
    found = versions(spark, folder)
    return f"{found[-1] if found else folder + '/v0'}/{name}"


def _claimed(spark: SparkSession, at: str) -> bool:
    """Whether the version's folder is this writer's: its mark can be made once only."""
    mark, fs = _store(spark, f"{at}/_CLAIMED")
    try:
        fs.create(mark, False).close()
    except Py4JJavaError as e:
        if fs.exists(mark):
            return False
        raise e
    return True


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], keep: int = 2) -> str:
    """Write tables as a new version, which readers see when all of them are there; the last `keep` versions stay.

    A run that fails leaves the last version as it was, and two that start together get versions of their own. A table with
    a column `part` has a folder for each of its values. A table may be a function of those that are written before it, by name.
    """
    before = versions(spark, folder)
    number = int(before[-1].rsplit("/v", 1)[1]) + 1 if before else 1
    while not _claimed(spark, f"{folder}/v{number:08d}"):
        number += 1
    at = f"{folder}/v{number:08d}"
    made = {}
    for name, table in tables.items():
        table = table if isinstance(table, DataFrame) else table(made)
        table.write.mode("overwrite").parquet(f"{at}/{name}", partitionBy=["part"] if "part" in table.columns else None)
        made[name] = spark.read.schema(table.schema).parquet(f"{at}/{name}")
    ready, fs = _store(spark, f"{at}/_READY")
    fs.create(ready, True).close()
    for old in [*before, at][:-keep]:
        path, fs = _store(spark, old)
        fs.delete(path, True)
    return at


def replace_documents(old: DataFrame, new: DataFrame, key: str = "doc") -> DataFrame:
    """The rows of documents that are ingested again give way to the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the latest of both."""
    return last_write(old.unionByName(new), key, *order)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): fields with a quote, a comma or a line break are quoted, lists are joined by semicolons."""
    def field(c: str):
        kind = rows.schema[c].dataType.simpleString()
        v = F.array_join(c, ";") if kind.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return rows.select(F.concat_ws(",", *[field(c) for c in columns]).alias("line"))


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): table rows with bars escaped and line breaks as blanks."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("–")), r"\|", r"\\\|"), "\n", " ")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


def conversation_json(turns: DataFrame) -> DataFrame:
    """(session_id, document): a session's turns in order as one JSON document."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.groupBy("session_id").agg(F.to_json(F.struct(rows.alias("turns"))).alias("document"))
