"""Queries that run as streams with keyed state over all events that are there, each with the SQL of its final rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import telemetry as T
from ..sources import tables
from ..streaming import rates, sessions, steps
from .catalog import query, table


def _emitted(spark: SparkSession, result: DataFrame) -> DataFrame:
    """All rows that a stream has put out by its end."""
    folder = tables.shared_folder(spark, "stream")
    rates.drain(result, f"{folder}/out", f"{folder}/state", mode="append")
    return spark.read.schema(result.schema).parquet(f"{folder}/out/batch=*")


def steps_of(events: DataFrame) -> DataFrame:
    """Ten events in a row are the steps of a request: errors end it, purchases are parts of the answer, the tenth is the answer."""
    seq = (F.col("event_id") % 10).cast("int")
    kind = F.when(F.col("event_type") == "error", "error").when(seq == 9, "final").when(F.col("event_type") == "purchase", "answer_delta").otherwise("node")
    text = F.when(kind == "final", F.concat_ws(" ", F.lit("Event"), "event_id", F.lit("of user"), "user_id", F.lit("is the last of these."))).when(kind == "answer_delta", F.concat(F.lit("part "), F.col("event_id").cast("string"), F.lit(" "))).otherwise(F.col("event_type"))
    return events.select(F.floor(F.col("event_id") / 10).alias("request_id"), seq.alias("seq"), kind.alias("kind"), text.alias("text"))


SQL_STEPS = """s AS (SELECT event_id // 10 AS r, event_id % 10 AS seq, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 10 = 9 THEN 'final' WHEN event_type = 'purchase' THEN 'answer_delta' ELSE 'node' END AS kind,
    'Event ' || event_id || ' of user ' || user_id || ' is the last of these.' AS said, event_id, event_type FROM events),
    e AS (SELECT *, min(CASE WHEN kind IN ('final', 'error') THEN seq END) OVER (PARTITION BY r) AS ends, row_number() OVER (PARTITION BY r ORDER BY seq) - 1 AS place, count(*) FILTER (WHERE kind = 'answer_delta') OVER (PARTITION BY r ORDER BY seq) AS parts FROM s),
    g AS (SELECT * FROM e WHERE seq = place AND (ends IS NULL OR seq <= ends)),
    p AS (SELECT r, seq, 0 AS k, 'answer_delta' AS kind, '{"delta": "' || array_to_string(w[1 + 4 * i : 4 + 4 * i], ' ') || CASE WHEN 4 * i + 4 < len(w) THEN ' ' ELSE '' END || '"}' AS data, i FROM (SELECT r, seq, string_split(said, ' ') AS w, unnest(range(0, (len(string_split(said, ' ')) + 3) // 4)) AS i FROM g WHERE kind = 'final' AND parts = 0)
        UNION ALL SELECT r, seq, 1, kind, CASE kind WHEN 'node' THEN '{"step": "' || event_type || '"}' WHEN 'answer_delta' THEN '{"delta": "part ' || event_id || ' "}' WHEN 'final' THEN '{"answer": "' || said || '"}' ELSE '{"error": "' || event_type || '"}' END, 0 FROM g)"""


@query(f"WITH {SQL_STEPS} SELECT r AS request_id, CAST(row_number() OVER (PARTITION BY r ORDER BY seq, k, i) - 1 AS INTEGER) AS pos, 'event: ' || kind || chr(10) || 'data: ' || data || chr(10) || chr(10) AS frame FROM p")
def step_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emitted(spark, steps.answer_frames(steps_of(rates.events_stream(spark, sf_dir))))


def changes_of(events: DataFrame) -> DataFrame:
    """Every fourth event rates an ask, every 24th resolves one."""
    vote = F.when(F.col("value") > 30, "up").otherwise("down")
    votes = events.where("event_id % 4 = 1").select((F.col("event_id") - F.col("event_id") % 8).alias("request_id"), "ts", vote.alias("kind"))
    return votes.unionByName(events.where("event_id % 24 = 0").select(F.col("event_id").alias("request_id"), "ts", F.lit("resolved").alias("kind")))


@query(
    """WITH c AS (SELECT event_id - event_id % 8 AS request_id, ts, CASE WHEN value > 30 THEN 'up' ELSE 'down' END AS kind FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, ts, 'resolved' FROM events WHERE event_id % 24 = 0),
    n AS (SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY request_id ORDER BY epoch_us(ts), kind) AS after FROM c),
    m AS (SELECT max(epoch_ms(ts)) * 1000 - 600000000 AS mark FROM c)
    SELECT request_id, epoch_us(ts) AS voted, CAST(h AS INTEGER) AS hours FROM n, m, (VALUES (6), (48)) v(h) WHERE kind = 'down' AND epoch_us(ts) + h * 3600000000 < greatest(coalesce(after, 0), CASE WHEN after IS NULL THEN mark ELSE 0 END)"""
)
def open_item_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emitted(spark, steps.open_item_alerts(changes_of(rates.events_stream(spark, sf_dir))))


@query("SELECT user_id::VARCHAR AS session_id, epoch_us(max(ts)) AS last FROM events GROUP BY user_id ORDER BY last DESC, session_id LIMIT 100")
def live_session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 sessions that are kept at the end of the stream; a user is a session."""
    turns = rates.events_stream(spark, sf_dir).select(F.col("user_id").alias("session_id"), "ts")
    return sessions.merged_sessions(_emitted(spark, sessions.live_sessions(turns, cap=100)), cap=100)


@query(
    """WITH c AS (SELECT event_type AS route, time_bucket(INTERVAL '6 hours', ts) AS life, date_trunc('minute', ts) AS ts, count(*) AS n FROM events GROUP BY ALL),
    s AS (SELECT route, epoch_us(ts) / 1e6 AS t, time_bucket(INTERVAL '3 hours', ts) AS start, CAST(sum(n) OVER (PARTITION BY route, life ORDER BY ts) AS DOUBLE) AS v FROM c),
    l AS (SELECT *, lag(v) OVER (PARTITION BY route, start ORDER BY t, v) AS before FROM s),
    w AS (SELECT route, start, count(*) AS n, arg_max(v, t) - arg_min(v, t) + sum(CASE WHEN v < before THEN before ELSE 0 END) AS grown, arg_min(v, t) AS least, max(t) - min(t) AS span, min(t) - epoch_us(start) / 1e6 AS head, epoch_us(start) / 1e6 + 10800 - max(t) AS tail FROM l GROUP BY route, start HAVING count(*) > 1),
    e AS (SELECT *, span / (n - 1) AS mean FROM w),
    x AS (SELECT *, least(CASE WHEN head >= mean * 1.1 THEN mean / 2 ELSE head END, CASE WHEN grown > 0 AND least >= 0 THEN span * least / grown ELSE 1e300 END) AS h, CASE WHEN tail >= mean * 1.1 THEN mean / 2 ELSE tail END AS e FROM e)
    SELECT route, start::TIMESTAMP AS start, round(grown * (span + h + e) / span, 4) AS increase, round(grown * (span + h + e) / span / 10800, 8) AS rate FROM x"""
)
def scraped_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of events by route, scraped each minute that has any and restarted every six hours; windows of three hours."""
    by = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("route"), F.window("ts", "6 hours")["start"].alias("life"), F.date_trunc("minute", "ts").alias("ts")).agg(F.count("*").alias("n"))
    samples = by.withColumn("value", F.sum("n").over(Window.partitionBy("route", "life").orderBy("ts")))
    return T.counter_rates(samples, "3 hours", None, "route").select("route", "start", F.round("increase", 4).alias("increase"), F.round("rate", 8).alias("rate"))
