"""Queries on what a service publishes of itself: counters of live traffic, load tests, metric families, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as R
from .catalog import query, table
from .telemetry_jobs import SQL_BUCKETS, SQL_LEDGER, SQL_RESULTS, SQL_RUNS, SQL_TRIAGE, feedback_of, http_counts, ledger_of, results_of, runs_of, triage_items

SERVICE = R.Service(version="1.0", mode="simulation", model='local "small"', embedding_dim=64, cache_capacity=256, rerank_pool=10)


def asks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with what else is known of an ask: every fiftieth user is a test run."""
    ledger = ledger_of(spark, sf_dir)
    return ledger.withColumns({"eval_run": F.col("session_id") % 50 == 0, "retries": F.col("request_id") % 4 - 1, "follow_up": F.col("request_id") % 7 == 0, "streamed": F.col("session_id") % 2 == 1})


SQL_ASKS = "asks AS (SELECT *, session_id % 50 = 0 AS eval_run, request_id % 4 - 1 AS retries, request_id % 7 = 0 AS follow_up, session_id % 2 = 1 AS streamed FROM ledger), live AS (SELECT * FROM asks WHERE NOT eval_run)"


@query(
    f"""WITH {SQL_LEDGER}, {SQL_ASKS} SELECT route, count(*) AS asks, count(*) FILTER (WHERE fallback) AS fallbacks, CAST(sum(greatest(0, retries)) AS BIGINT) AS rewrites, count(*) FILTER (WHERE follow_up) AS followups,
    count(*) FILTER (WHERE streamed) AS streamed, count(*) FILTER (WHERE cache_hit) AS cache_hits FROM live GROUP BY route"""
)
def ask_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ask_counters(asks_of(spark, sf_dir))


def requests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a request of a load test, its user's remainder the worker."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 8).alias("worker"), (F.col("event_type") != "error").alias("ok"), (F.col("value") / 4).alias("ttft_ms"), F.col("value").alias("latency_ms"), (F.col("event_id") % 97 + 1).alias("tokens"), "ts")


SQL_REQUESTS = "requests AS (SELECT user_id % 8 AS worker, event_type <> 'error' AS ok, value AS latency_ms, value / 4 AS ttft_ms, event_id % 97 + 1 AS tokens, ts FROM events)"
SQL_ROLLUP = """count(*) AS requests, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed, round(quantile_disc(ttft_ms, 0.5) FILTER (WHERE ok), 4) AS ttft_p50, round(quantile_disc(ttft_ms, 0.95) FILTER (WHERE ok), 4) AS ttft_p95,
    round(quantile_disc(latency_ms, 0.5) FILTER (WHERE ok), 4) AS latency_p50, round(quantile_disc(latency_ms, 0.95) FILTER (WHERE ok), 4) AS latency_p95, CAST(coalesce(sum(tokens) FILTER (WHERE ok), 0) AS BIGINT) AS total_tokens,
    round((max(epoch_us(ts) + latency_ms * 1000) - min(epoch_us(ts))) / 1e6, 4) AS duration_s"""


@query(f"WITH {SQL_REQUESTS}, b AS (SELECT worker, {SQL_ROLLUP} FROM requests GROUP BY worker) SELECT *, CASE WHEN duration_s > 0 THEN round(total_tokens / duration_s, 4) ELSE 0.0 END AS tokens_per_sec FROM b")
def bench_first_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bench_rollup(requests_of(spark, sf_dir), "worker")


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks, events, cases = asks_of(spark, sf_dir), table(spark, sf_dir, "events"), results_of(spark, sf_dir)
    return R.service_samples(
        spark,
        SERVICE,
        ledger=asks,
        feedback=feedback_of(spark, sf_dir),
        triage=triage_items(spark, sf_dir),
        http=http_counts(spark, sf_dir),
        chunks=table(spark, sf_dir, "documents").select(F.col("source").alias("doc")),
        turns=table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")),
        cache=asks.where("cache_hit"),
        rerank=events.where("event_type = 'view'").select((F.col("event_id") % 16).alias("candidates"), (F.col("event_id") % 5).alias("reorders"), F.col("value").alias("latency_ms")),
        golden=cases.select(F.when(F.col("doc_id") % 4 == 0, "user").otherwise("base").alias("source")),
        runs=runs_of(spark, sf_dir),
        cases=cases,
        bench=requests_of(spark, sf_dir),
    )


def _one(select: str, *made: tuple[str, str]) -> str:
    """SQL of unlabelled samples from one row."""
    return " UNION ALL ".join(f"SELECT '{name}' AS name, '' AS labels, CAST({value} AS DOUBLE) AS value FROM ({select})" for name, value in made)


SQL_SAMPLES = f"""WITH {SQL_TRIAGE.removeprefix("WITH ")}, {SQL_ASKS}, {SQL_RUNS}, {SQL_RESULTS}, {SQL_REQUESTS}, bench AS (SELECT {SQL_ROLLUP} FROM requests), s AS (
    SELECT 'rag_build_info' AS name, 'mode=simulation,model=local "small",version=1.0' AS labels, 1.0 AS value
    UNION ALL SELECT 'rag_rerank_info', 'mode=lexical,n=10', 1.0
    UNION ALL SELECT name, '', value FROM (VALUES ('rag_uptime_seconds', 0.0), ('rag_metrics_scrape_duration_ms', 0.0), ('rag_embedding_dim', 64.0), ('rag_cache_capacity', 256.0)) k(name, value)
    UNION ALL SELECT 'rag_ask_total', 'route=' || route, count(*) FROM live GROUP BY route
    UNION ALL {_one("SELECT count(*) AS n, count(*) FILTER (WHERE fallback) AS f, sum(greatest(0, retries)) AS r, count(*) FILTER (WHERE follow_up) AS u, count(*) FILTER (WHERE streamed) AS s, count(*) FILTER (WHERE cache_hit) AS h, sum(latency_ms) AS ms FROM live",
        ("rag_ask_fallback_total", "f"), ("rag_ask_rewrites_total", "r"), ("rag_ask_followup_total", "u"), ("rag_ask_streamed_total", "s"), ("rag_cache_hits_total", "h"), ("rag_cache_lookups_total", "n"), ("rag_cache_hit_ratio", "round(h / greatest(1, n), 4)"),
        ("rag_ask_latency_seconds_sum", "round(ms / 1000, 4)"), ("rag_ask_latency_seconds_count", "n"))}
    UNION ALL SELECT 'rag_ask_latency_seconds_bucket', 'le=' || le, count(*) FILTER (WHERE latency_ms / 1000 <= CAST(bound AS DOUBLE)) FROM live, {SQL_BUCKETS} GROUP BY le
    UNION ALL SELECT 'http_requests_total', 'method=' || CASE WHEN event_type = 'click' THEN 'POST' ELSE 'GET' END || ',path=' || CASE WHEN event_type = 'error' THEN 'unmatched' ELSE '/' || event_type END || ',status=' || CASE WHEN event_type = 'error' THEN '404' ELSE '200' END, count(*) FROM events GROUP BY event_type
    UNION ALL {_one("SELECT count(DISTINCT source) AS d, count(*) AS n FROM documents", ("rag_corpus_documents", "d"), ("rag_corpus_chunks", "n"))}
    UNION ALL {_one("SELECT count(DISTINCT conv_id) AS n FROM conversations", ("rag_sessions_total", "n"))}
    UNION ALL SELECT 'rag_feedback_total', 'rating=' || rating, count(*) FROM feedback GROUP BY rating
    UNION ALL {_one("SELECT count(*) AS n FROM asks WHERE cache_hit", ("rag_cache_entries", "n"))}
    UNION ALL {_one("SELECT sum(event_id % 16) AS n, sum(event_id % 5) AS m, round(avg(value), 4) AS ms FROM events WHERE event_type = 'view'", ("rag_rerank_candidates_total", "n"), ("rag_rerank_reorders_total", "m"), ("rag_rerank_latency_avg_ms", "ms"))}
    UNION ALL SELECT 'rag_golden_set_cases', 'source=' || CASE WHEN doc_id % 4 = 0 THEN 'user' ELSE 'base' END, count(*) FROM r GROUP BY 2
    UNION ALL {_one("SELECT count(*) AS n FROM asks", ("rag_answer_ledger_entries", "n"))}
    UNION ALL {_one("SELECT count(*) AS n, arg_max(accuracy, ts) AS a FROM runs", ("rag_eval_runs_total", "n"), ("rag_eval_last_run_accuracy", "a"))}
    UNION ALL {_one("SELECT count(*) FILTER (WHERE state = 'open') AS o, count(*) FILTER (WHERE state = 'resolved') AS d, max(age_hours) FILTER (WHERE state = 'open') AS h FROM t", ("rag_triage_open", "o"), ("rag_triage_resolved", "d"), ("rag_triage_oldest_open_hours", "h"))}
    UNION ALL {_one("SELECT round(avg(passed::INT), 4) AS a, round(avg(faithfulness), 4) AS f FROM r", ("rag_eval_accuracy", "a"), ("rag_eval_faithfulness", "f"))}
    UNION ALL {_one("SELECT * FROM bench", ("rag_benchmark_tokens_per_sec", "round(total_tokens / duration_s, 4)"), ("rag_benchmark_latency_p95_ms", "latency_p95"))})"""  # fmt: skip


@query(f"{SQL_SAMPLES} SELECT name, labels, CAST(value AS DOUBLE) AS value FROM s")
def service_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metric families, written as text and read back."""
    from ..sources.exposition import parse

    document = R.metrics_document(samples_of(spark, sf_dir))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), F.replace(e["value"], F.lit('\\"'), F.lit('"')))), ",")
    return parse(document.select(F.col("line").alias("value"))).select("name", shown.alias("labels"), "value")


SQL_CELL = lambda c: f"trim(replace(replace({c}, '|', '\\|'), chr(10), ' '), ' ')"
SQL_NUMBER = lambda c, places, unit="": f"coalesce(printf('%.{places}f', round({c}, {places})) || '{unit}', '—')"
SQL_REPORT = f"""WITH {SQL_TRIAGE.removeprefix("WITH ")}, {SQL_RUNS}, {SQL_RESULTS}, q AS (SELECT r.*, CASE WHEN doc_id % 4 = 0 THEN 'user' ELSE 'base' END AS source, left(text, 60) AS question FROM r JOIN documents USING (doc_id)),
    a AS (SELECT count(*) AS n, count(*) FILTER (WHERE passed) AS ok, avg(passed::INT) * 100 AS accuracy, avg(retrieval_hit::INT) * 100 AS hits, avg(faithfulness) * 100 AS faith, round(quantile_cont(CASE WHEN latency_ms > 0 THEN latency_ms END, 0.5), 4) AS p50, round(quantile_cont(CASE WHEN latency_ms > 0 THEN latency_ms END, 0.95), 4) AS p95 FROM q),
    w AS (SELECT count(*) FILTER (WHERE state = 'open') AS o, count(*) FILTER (WHERE state = 'resolved') AS d, count(*) FILTER (WHERE fallback) AS f, max(age_hours) FILTER (WHERE state = 'open') AS h FROM t)
    SELECT section::INT AS section, part::INT AS part, '' AS key, line FROM (VALUES (1, 0, '## Last run of the test set'), (1, 2, '| category | passed | total |'), (1, 3, '|---|---|---|'), (2, 0, '## Cases'), (2, 1, '| case | category | source | result | question |'), (2, 2, '|---|---|---|---|---|'),
        (3, 0, '## Run history'), (3, 1, '| run | accuracy | faithfulness | p50 ms |'), (3, 2, '|---|---|---|---|'), (4, 0, '## Open answers')) h(section, part, line)
    UNION ALL SELECT 1, 1, '0', '- cases: ' || n || ' · passed ' || ok || ' · failed ' || (n - ok) FROM a
    UNION ALL SELECT 1, 1, '1', '- accuracy: ' || {SQL_NUMBER("accuracy", 1, "%")} FROM a
    UNION ALL SELECT 1, 1, '2', '- retrieval hits: ' || {SQL_NUMBER("hits", 1, "%")} FROM a
    UNION ALL SELECT 1, 1, '3', '- faithfulness: ' || {SQL_NUMBER("faith", 1, "%")} FROM a
    UNION ALL SELECT 1, 1, '4', '- latency: p50 ' || {SQL_NUMBER("p50", 0, " ms")} || ' · p95 ' || {SQL_NUMBER("p95", 0, " ms")} FROM a
    UNION ALL SELECT 1, 4, category, '| ' || {SQL_CELL("category")} || ' | ' || count(*) FILTER (WHERE passed) || ' | ' || count(*) || ' |' FROM q GROUP BY category
    UNION ALL SELECT 2, 3, lpad(doc_id::VARCHAR, 20, '0'), '| ' || doc_id || ' | ' || {SQL_CELL("category")} || ' | ' || source || ' | ' || CASE WHEN passed THEN 'pass' ELSE 'fail' END || ' | ' || {SQL_CELL("question")} || ' |' FROM q
    UNION ALL SELECT 3, 3, lpad((4102444800 - epoch(ts)::BIGINT)::VARCHAR, 20, '0'), '| ' || label || ' | ' || {SQL_NUMBER("accuracy * 100", 0, "%")} || ' | ' || {SQL_NUMBER("faithfulness * 100", 0, "%")} || ' | ' || {SQL_NUMBER("p50", 0)} || ' |' FROM (SELECT * FROM runs ORDER BY ts DESC LIMIT 20)
    UNION ALL SELECT 4, 1, '0', '- open: ' || o || ' · resolved: ' || d FROM w
    UNION ALL SELECT 4, 1, '1', '- oldest open: ' || {SQL_NUMBER("h", 1, " h")} FROM w
    UNION ALL SELECT 4, 1, '2', '- fallback answers: ' || f FROM w"""


@query(SQL_REPORT)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(60)).alias("question"))
    cases = results_of(spark, sf_dir).join(titles, "doc_id").withColumn("source", F.when(F.col("doc_id") % 4 == 0, "user").otherwise("base")).withColumnRenamed("doc_id", "case_id")
    return R.quality_report(cases, runs_of(spark, sf_dir), triage_items(spark, sf_dir))


@query(
    """WITH p AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')
    SELECT conv_id AS session_id, turn, md5('## Q: ' || coalesce(question, '') || chr(10) || chr(10) || coalesce(answer, '') || CASE WHEN turn % 4 = 0 THEN chr(10) || chr(10) || '**Sources:**' || chr(10) || '1. doc ' || conv_id || chr(10) || '2. page ' || turn ELSE '' END
        || CASE WHEN answer IS NOT NULL THEN chr(10) || chr(10) || '*' || length(answer) || ' characters*' ELSE '' END) AS digest FROM p"""
)
def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = R.answered_turns(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id"))
    sources = F.when(F.col("turn") % 4 == 0, F.array(F.concat(F.lit("doc "), "session_id"), F.concat(F.lit("page "), "turn")))
    note = F.concat(F.length("answer").cast("string"), F.lit(" characters"))
    return R.turn_markdown(turns.withColumns({"sources": sources, "meta": note})).select("session_id", "turn", F.md5(F.col("markdown").cast("binary")).alias("digest"))
