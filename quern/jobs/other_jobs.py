"""Queries on exports, streams, raw pages and the plain relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import telemetry as T
from ..sources import tables
from ..streaming import rates
from .catalog import query, table
from .telemetry_jobs import SQL_LEDGER, SQL_RUNS, ledger_of, runs_of


@query("SELECT '' || item_id || ',' || CASE WHEN regexp_matches(text, '[\",\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END || ',' || (item_id % 3)::VARCHAR || ';' || (item_id % 2)::VARCHAR AS line FROM benchmark")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.array((F.col("item_id") % 3).cast("string"), (F.col("item_id") % 2).cast("string")).alias("docs"))
    return tables.csv_lines(rows, ["item_id", "text", "docs"])


@query(f"WITH {SQL_RUNS} SELECT '| ' || label || ' | ' || accuracy::VARCHAR || ' | ' || ablation::VARCHAR || ' |' AS line FROM runs")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.markdown_rows(runs_of(spark, sf_dir), ["label", "accuracy", "ablation"])


@query("SELECT conv_id AS session_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY conv_id")
def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as JSON documents and read back."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    back = tables.conversation_json(turns).select("session_id", F.explode(F.from_json("document", "turns array<struct<role:string,text:string>>")["turns"]).alias("t"))
    return back.groupBy("session_id").agg(F.count("*").alias("turns"), F.sum(F.length("t.text")).alias("characters"))


@query("SELECT source AS doc, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS characters FROM (SELECT source, CASE WHEN source IN ('src1', 'src2') THEN n_chars * 2 ELSE n_chars END AS n_chars FROM documents) GROUP BY source")
def replace_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources are ingested again: their old rows go, the others stay."""
    old = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "doc_id", "n_chars")
    new = old.where(F.col("doc").isin("src1", "src2")).withColumn("n_chars", F.col("n_chars") * 2)
    return tables.replace_documents(old, new).groupBy("doc").agg(F.count("*").alias("n"), F.sum("n_chars").alias("characters"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return tables.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "ts", "event_id").select("user_id", "value", "event_id")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, length(html) AS size, len(regexp_extract_all(html, '<a[ >]')) AS links FROM pages")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host"), F.length("html").alias("size"), F.size(F.regexp_extract_all("html", F.lit("<a[ >]"), F.lit(0))).alias("links"))


def _streamed(spark: SparkSession, result: DataFrame) -> DataFrame:
    """The rows of a stream's last batch, after it has run over all that is there."""
    folder = tables.shared_folder(spark, "stream")
    rates.drain(result, f"{folder}/out", f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out")
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).drop("batch")


@query("SELECT time_bucket(INTERVAL '5 minutes', ts)::TIMESTAMP AS start, event_type AS route, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rate_tumbling as a stream with a watermark, over all events that are there."""
    return _streamed(spark, rates.route_rates(rates.events_stream(spark, sf_dir))).withColumn("total", F.round("total", 4))


@query("SELECT event_type AS route, count(*) AS asks, count(*) FILTER (WHERE event_type = 'error') AS fallbacks FROM events GROUP BY 1")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, rates.route_totals(rates.events_stream(spark, sf_dir)))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, c_mktsegment, grouping(n_name) + grouping(c_mktsegment) AS level, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def customer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_name", "c_mktsegment").agg((F.grouping("n_name") + F.grouping("c_mktsegment")).alias("level"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def customers_without_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).alias("rank")).where("rank <= 3")


@query(f"WITH {SQL_LEDGER}, e AS (SELECT epoch_us(ts) AS t, request_id, session_id FROM ledger) SELECT request_id, (SELECT max(request_id) FROM resolutions r WHERE r.resolved_at <= l.ts AND r.resolved_at > l.ts - INTERVAL '1 hour') AS latest FROM ledger l")
def latest_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the last resolution within the hour before each ask. Both sides meet by hour, in one window pass an hour."""
    asks = ledger_of(spark, sf_dir).select("request_id", "ts")
    marks = table(spark, sf_dir, "events").where("event_id % 24 = 0").select("event_id", "ts")
    hour = F.date_trunc("hour", "ts")
    kept = asks.select(hour.alias("hour"), "ts", F.lit(1).alias("side"), "request_id", F.lit(None).cast("long").alias("mark"))
    spread = marks.select(F.explode(F.array(hour, hour + F.expr("INTERVAL 1 HOUR"))).alias("hour"), "ts", F.lit(0).alias("side"), F.lit(None).cast("long").alias("request_id"), F.col("event_id").alias("mark"))
    by = Window.partitionBy("hour").orderBy("ts", "side")
    rows = kept.unionByName(spread).withColumns({"latest": F.last("mark", ignorenulls=True).over(by), "at": F.last(F.when(F.col("side") == 0, F.col("ts")), ignorenulls=True).over(by)})
    near = T.micros(F.col("ts")) - T.micros(F.col("at")) < 3_600_000_000
    return rows.where("side = 1").select("request_id", F.when(near, F.col("latest")).alias("latest"))
