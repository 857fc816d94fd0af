"""What a service publishes of itself: counters of its traffic, metric families, a quality report, conversations as Markdown."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import telemetry as T

# Names and kinds of the metric families, which dashboards refer to.
FAMILIES = {
    "rag_build_info": "gauge", "rag_uptime_seconds": "gauge",
    "rag_ask_total": "counter", "rag_ask_fallback_total": "counter", "rag_ask_rewrites_total": "counter", "rag_ask_followup_total": "counter", "rag_ask_streamed_total": "counter",
    "rag_cache_hits_total": "counter", "rag_cache_lookups_total": "counter", "rag_cache_hit_ratio": "gauge", "rag_ask_latency_seconds": "histogram",
    "http_requests_total": "counter", "rag_metrics_scrape_duration_ms": "gauge",
    "rag_corpus_documents": "gauge", "rag_corpus_chunks": "gauge", "rag_embedding_dim": "gauge", "rag_sessions_total": "gauge", "rag_feedback_total": "counter", "rag_cache_entries": "gauge", "rag_cache_capacity": "gauge",
    "rag_rerank_info": "gauge", "rag_rerank_candidates_total": "counter", "rag_rerank_reorders_total": "counter", "rag_rerank_latency_avg_ms": "gauge",
    "rag_golden_set_cases": "counter", "rag_answer_ledger_entries": "gauge", "rag_eval_runs_total": "counter", "rag_eval_last_run_accuracy": "gauge",
    "rag_triage_open": "gauge", "rag_triage_resolved": "gauge", "rag_triage_oldest_open_hours": "gauge",
    "rag_eval_accuracy": "gauge", "rag_eval_faithfulness": "gauge", "rag_benchmark_tokens_per_sec": "gauge", "rag_benchmark_latency_p95_ms": "gauge",
}


@dataclass(frozen=True)
class Service:
    """What no table knows of a running service."""

    version: str = "unknown"
    mode: str = "unknown"
    model: str = ""
    uptime_seconds: float = 0.0
    scrape_ms: float = 0.0
    embedding_dim: int = 0
    cache_capacity: int = 0
    rerank_mode: str = "lexical"
    rerank_pool: int = 0


def live_asks(ledger: DataFrame) -> DataFrame:
    """The ledger without the asks of test runs, which are no traffic; a null mark is none."""
    return ledger.where(~F.coalesce("eval_run", F.lit(False)))


def ask_counters(ledger: DataFrame) -> DataFrame:
    """(route, asks, fallbacks, rewrites, followups, streamed, cache_hits) of the live asks of a ledger (route, fallback, retries, follow_up, streamed, cache_hit, eval_run)."""
    return live_asks(ledger).groupBy("route").agg(
        F.count("*").alias("asks"),
        F.count_if("fallback").alias("fallbacks"),
        F.sum(F.greatest(F.lit(0), F.coalesce("retries", F.lit(0)))).alias("rewrites"),
        F.count_if("follow_up").alias("followups"),
        F.count_if("streamed").alias("streamed"),
        F.count_if("cache_hit").alias("cache_hits"),
    )


def bench_rollup(requests: DataFrame, *by: str) -> DataFrame:
    """Load-test requests (ok, ttft_ms, latency_ms, tokens, ts): counts, percentiles of those that succeeded by nearest rank, and tokens a second from the first start to the last end."""
    good = lambda c: F.when(F.col("ok"), F.col(c))
    rows = requests.select(*by, "ok", good("ttft_ms").alias("ttft"), good("latency_ms").alias("latency"), good("tokens").alias("tokens"), T.micros(F.col("ts")).alias("start"), (T.micros(F.col("ts")) + F.coalesce("latency_ms", F.lit(0)) * 1000).alias("stop"))
    ranks = [p.alias(f"{c}_p{q}") for c in ("ttft", "latency") for q, p in zip((50, 95), T.percentiles(c, nearest=True))]
    out = rows.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"), *ranks, F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.round((F.max("stop") - F.min("start")) / 1e6, 4).alias("duration_s"))
    return out.withColumn("tokens_per_sec", F.when(F.col("duration_s") > 0, F.round(F.col("total_tokens") / F.col("duration_s"), 4)).otherwise(0.0))


def _labels(**of: Column) -> Column:
    return F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v.cast("string"))]) if of else F.create_map().cast("map<string,string>")


def _samples(rows: DataFrame, *made: tuple[str, Column, dict[str, Column]]) -> DataFrame:
    """Several samples (name, value, labels) a row, of which those without a value go."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), _labels(**labels).alias("labels"), v.cast("double").alias("value")) for n, v, labels in made])
    return rows.select(F.inline(each)).where("value is not null")


def service_samples(
    spark, service: Service, *, ledger: DataFrame, feedback: DataFrame, triage: DataFrame, http: DataFrame, chunks: DataFrame, turns: DataFrame, cache: DataFrame, rerank: DataFrame, golden: DataFrame, runs: DataFrame, cases: DataFrame, bench: DataFrame
) -> DataFrame:
    """(name, labels, value) of all families; what an empty table can't tell has no sample.

    ledger as in ask_counters, with latency_ms; feedback (rating); triage (state, age_hours); http (method, path,
    status, n); chunks (doc); turns (session_id); rerank (candidates, reorders, latency_ms); golden (source); runs (ts,
    accuracy); cases (passed, faithfulness); bench as in bench_rollup. Each table is aggregated to a few rows before
    anything is put together; the buckets' route is summed away.
    """
    c, none = F.col, {}
    known = _samples(
        spark.range(1),
        ("rag_build_info", F.lit(1), {"version": F.lit(service.version), "mode": F.lit(service.mode), "model": F.lit(service.model)}),
        ("rag_uptime_seconds", F.lit(service.uptime_seconds), none),
        ("rag_metrics_scrape_duration_ms", F.lit(service.scrape_ms), none),
        ("rag_embedding_dim", F.lit(service.embedding_dim), none),
        ("rag_cache_capacity", F.lit(service.cache_capacity), none),
        ("rag_rerank_info", F.lit(1), {"mode": F.lit(service.rerank_mode), "n": F.lit(service.rerank_pool)}),
    )
    live = live_asks(ledger)
    by_route = ask_counters(ledger)
    whole = by_route.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("asks", "fallbacks", "rewrites", "followups", "streamed", "cache_hits")])
    timed = live.where("latency_ms is not null")
    buckets = T.latency_histogram(timed).groupBy("le").agg(F.sum("n").alias("n"))
    parts = [
        known,
        _samples(by_route, ("rag_ask_total", c("asks"), {"route": c("route")})),
        _samples(
            whole,
            ("rag_ask_fallback_total", c("fallbacks"), none),
            ("rag_ask_rewrites_total", c("rewrites"), none),
            ("rag_ask_followup_total", c("followups"), none),
            ("rag_ask_streamed_total", c("streamed"), none),
            ("rag_cache_hits_total", c("cache_hits"), none),
            ("rag_cache_lookups_total", c("asks"), none),
            ("rag_cache_hit_ratio", F.round(c("cache_hits") / F.greatest(F.lit(1), c("asks")), 4), none),
        ),
        _samples(buckets, ("rag_ask_latency_seconds_bucket", c("n"), {"le": c("le")})),
        _samples(timed.agg(F.round(F.sum("latency_ms") / 1000, 4).alias("s"), F.count("*").alias("n")), ("rag_ask_latency_seconds_sum", c("s"), none), ("rag_ask_latency_seconds_count", c("n"), none)),
        _samples(http, ("http_requests_total", c("n"), {"method": c("method"), "path": c("path"), "status": c("status")})),
        _samples(chunks.agg(F.count_distinct("doc").alias("docs"), F.count("*").alias("n")), ("rag_corpus_documents", c("docs"), none), ("rag_corpus_chunks", c("n"), none)),
        _samples(turns.agg(F.count_distinct("session_id").alias("n")), ("rag_sessions_total", c("n"), none)),
        _samples(feedback.agg(F.count_if(c("rating") == "up").alias("up"), F.count_if(c("rating") == "down").alias("down")), *[("rag_feedback_total", c(k), {"rating": F.lit(k)}) for k in ("up", "down")]),
        _samples(cache.agg(F.count("*").alias("n")), ("rag_cache_entries", c("n"), none)),
        _samples(
            rerank.agg(F.sum("candidates").alias("n"), F.sum("reorders").alias("moved"), F.round(F.avg("latency_ms"), 4).alias("ms")),
            ("rag_rerank_candidates_total", c("n"), none),
            ("rag_rerank_reorders_total", c("moved"), none),
            ("rag_rerank_latency_avg_ms", c("ms"), none),
        ),
        _samples(golden.agg(F.count_if(c("source") == "base").alias("base"), F.count_if(c("source") == "user").alias("user")), *[("rag_golden_set_cases", c(k), {"source": F.lit(k)}) for k in ("base", "user")]),
        _samples(ledger.agg(F.count("*").alias("n")), ("rag_answer_ledger_entries", c("n"), none)),
        _samples(runs.agg(F.count("*").alias("n"), F.max_by("accuracy", "ts").alias("last")), ("rag_eval_runs_total", c("n"), none), ("rag_eval_last_run_accuracy", c("last"), none)),
        _samples(
            triage.agg(F.count_if(c("state") == "open").alias("open"), F.count_if(c("state") == "resolved").alias("done"), F.max(F.when(c("state") == "open", c("age_hours"))).alias("oldest")),
            ("rag_triage_open", c("open"), none),
            ("rag_triage_resolved", c("done"), none),
            ("rag_triage_oldest_open_hours", c("oldest"), none),
        ),
        _samples(cases.agg(F.round(F.avg(c("passed").cast("double")), 4).alias("a"), F.round(F.avg("faithfulness"), 4).alias("f")), ("rag_eval_accuracy", c("a"), none), ("rag_eval_faithfulness", c("f"), none)),
        _samples(bench_rollup(bench).where("successful > 0"), ("rag_benchmark_tokens_per_sec", c("tokens_per_sec"), none), ("rag_benchmark_latency_p95_ms", c("latency_p95"), none)),
    ]
    return reduce(DataFrame.union, parts)


def family_of(name: Column) -> Column:
    """The family of a sample: that of a histogram for its buckets, sum and count."""
    histograms = "|".join(n for n, kind in FAMILIES.items() if kind == "histogram")
    return F.regexp_replace(name, f"^({histograms})_(bucket|sum|count)$", "$1")


def metrics_document(samples: DataFrame) -> DataFrame:
    """(family, part, line): the metrics text; ordered by these it has each family's kind before its samples."""
    kinds = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    lines = T.exposition(samples).select(family_of(F.col("name")).alias("family"), F.lit(1).alias("part"), "line")
    heads = lines.select("family").distinct().select("family", F.lit(0).alias("part"), F.concat(F.lit("# TYPE "), "family", F.lit(" "), F.coalesce(F.try_element_at(kinds, F.col("family")), F.lit("untyped"))).alias("line"))
    return heads.union(lines)


def _cell(c: Column) -> Column:
    """A table cell: bars escaped, one line."""
    return F.trim(F.replace(F.replace(F.coalesce(c, F.lit("—")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def _number(c: Column, places: int, unit: str = "") -> Column:
    return F.when(c.isNotNull(), F.concat(F.format_string(f"%.{places}f", F.round(c, places).cast("double")), F.lit(unit))).otherwise("—")


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def quality_report(cases: DataFrame, runs: DataFrame, triage: DataFrame, *, history: int = 20) -> DataFrame:
    """(section, part, key, line): a Markdown report, to be read ordered by the first three.

    cases (case_id, category, source, question, passed, retrieval_hit, faithfulness, latency_ms); runs (ts, label, accuracy,
    faithfulness, p50), of which the `history` newest are listed; triage (state, age_hours, fallback). An empty table
    gives its headings and no rows; a missing rate is a dash. No window spans the report: keys order its rows.
    """
    c, lit = F.col, F.lit
    at = lambda section, part, key, line: (lit(section).alias("section"), lit(part).alias("part"), key.cast("string").alias("key"), line.alias("line"))
    titles = ["1|0|## Last run of the test set", "1|2|| category | passed | total |", "1|3||---|---|---|", "2|0|## Cases", "2|1|| case | category | source | result | question |", "2|2||---|---|---|---|---|", "3|0|## Run history", "3|1|| run | accuracy | faithfulness | p50 ms |", "3|2||---|---|---|---|", "4|0|## Open answers"]
    split = [t.split("|", 2) for t in titles]
    head = cases.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*at(int(s), int(p), lit(""), lit(t))) for s, p, t in split])))
    rate = lambda x: F.avg(x.cast("double")) * 100
    timed = F.when(c("latency_ms") > 0, c("latency_ms"))
    summed = cases.withColumn("timed", timed).agg(F.count("*").alias("n"), F.count_if("passed").alias("ok"), rate(c("passed")).alias("accuracy"), rate(c("retrieval_hit")).alias("hits"), rate(c("faithfulness")).alias("faith"), *T.percentiles("timed"))
    bullets = [
        F.concat(lit("- cases: "), c("n"), lit(" · passed "), c("ok"), lit(" · failed "), c("n") - c("ok")),
        F.concat(lit("- accuracy: "), _number(c("accuracy"), 1, "%")),
        F.concat(lit("- retrieval hits: "), _number(c("hits"), 1, "%")),
        F.concat(lit("- faithfulness: "), _number(c("faith"), 1, "%")),
        F.concat(lit("- latency: p50 "), _number(c("p50"), 0, " ms"), lit(" · p95 "), _number(c("p95"), 0, " ms")),
    ]
    facts = summed.select(F.inline(F.array(*[F.struct(*at(1, 1, lit(i), b)) for i, b in enumerate(bullets)])))
    by = cases.groupBy("category").agg(F.count_if("passed").alias("ok"), F.count("*").alias("n"))
    groups = by.select(*at(1, 4, c("category"), _row(_cell(c("category")), c("ok"), c("n"))))
    result = F.when(c("passed"), "pass").when(~c("passed"), "fail").otherwise("—")
    listed = cases.select(*at(2, 3, F.lpad(c("case_id").cast("string"), 20, "0"), _row(c("case_id").cast("string"), _cell(c("category")), c("source"), result, _cell(c("question")))))
    latest = T.newest(runs, history, "ts").select(*at(3, 3, F.format_string("%020d", 4102444800 - F.unix_timestamp("ts")), _row(_cell(c("label")), _number(c("accuracy") * 100, 0, "%"), _number(c("faithfulness") * 100, 0, "%"), _number(c("p50"), 0))))
    waiting = triage.agg(F.count_if(c("state") == "open").alias("open"), F.count_if(c("state") == "resolved").alias("done"), F.count_if("fallback").alias("fallbacks"), F.max(F.when(c("state") == "open", c("age_hours"))).alias("oldest"))
    open_items = waiting.select(
        F.inline(F.array(*[F.struct(*at(4, 1, lit(i), b)) for i, b in enumerate([F.concat(lit("- open: "), c("open"), lit(" · resolved: "), c("done")), F.concat(lit("- oldest open: "), _number(c("oldest"), 1, " h")), F.concat(lit("- fallback answers: "), c("fallbacks"))])]))
    )
    return reduce(DataFrame.union, [head, facts, groups, listed, latest, open_items])


def turn_markdown(turns: DataFrame) -> DataFrame:
    """(session_id, turn, markdown) of turns (session_id, turn, question, answer, sources array<string>, meta): a heading, the answer, numbered sources, a note. Null or empty parts are left out."""
    listed = F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    sources = F.when(F.size(listed) > 0, F.concat(F.lit("\n\n**Sources:**\n"), F.array_join(listed, "\n")))
    note = F.when(F.col("meta") != "", F.concat(F.lit("\n\n*"), "meta", F.lit("*")))
    whole = F.concat(F.lit("## Q: "), F.coalesce("question", F.lit("")), F.lit("\n\n"), F.coalesce("answer", F.lit("")), F.coalesce(sources, F.lit("")), F.coalesce(note, F.lit("")))
    return turns.select("session_id", "turn", whole.alias("markdown"))


def answered_turns(messages: DataFrame) -> DataFrame:
    """(session_id, turn, question, answer) of messages (session_id, turn, role, text): each user message with the assistant's that follows at once, else without.

    A join on the place in the session, so that a long session isn't sorted in one task; a place that repeats gives all pairs of its rows.
    """
    asked = messages.where("role = 'user'").select("session_id", "turn", F.col("text").alias("question"))
    told = messages.where("role = 'assistant'").select("session_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(told, ["session_id", "turn"], "left")
