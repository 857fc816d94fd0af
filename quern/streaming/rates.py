"""Running counters and rates of asks as streams, with event time and watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events_stream(spark: SparkSession, folder: str, file: str = "events.parquet", files_a_batch: int = 1) -> DataFrame:
    """The event files of a folder as a stream; the schema is that of what is there, not inferred while it runs."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def route_rates(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, route, n, total) by event-time window; what is later than `late` behind the newest event is left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    by = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window, "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("event_type").alias("route"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events without a gap."""
    by = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def route_totals(events: DataFrame) -> DataFrame:
    """Counters that outlive a restart: their state is in the query's checkpoint."""
    return events.groupBy(F.col("event_type").alias("route")).agg(F.count("*").alias("asks"), F.count_if(F.col("event_type") == "error").alias("fallbacks"))


def drain(result: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run a stream over all that is there and stop; every batch's rows are a folder of `out`, written again if a batch is."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:06d}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return query
