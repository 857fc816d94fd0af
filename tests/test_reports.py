"""Metric families, load-test figures, reports: missing values, empty tables, reading back."""

from datetime import datetime

from pyspark.sql import functions as F

from quern.jobs import report_jobs
from quern.operators import reports as R
from quern.sources.exposition import parse

FOLDER = "/root/testdata/sf0.001"
ASKS = "route string, fallback boolean, retries int, follow_up boolean, streamed boolean, cache_hit boolean, eval_run boolean, latency_ms double"


def test_test_runs_are_no_traffic(spark):
    rows = [("document", False, 2, True, False, True, None, 5.0), ("document", True, -3, None, True, False, False, 7.0), ("document", True, 9, True, True, True, True, 9.0), (None, False, None, False, False, False, False, None)]
    got = {r["route"]: r.asDict() for r in R.ask_counters(spark.createDataFrame(rows, ASKS)).collect()}
    assert got["document"] == {"route": "document", "asks": 2, "fallbacks": 1, "rewrites": 2, "followups": 1, "streamed": 1, "cache_hits": 1}
    assert got[None]["asks"] == 1 and got[None]["rewrites"] == 0


def test_first_tokens_of_what_succeeded(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [(True, 10.0, 100.0, 50, at(0)), (True, 30.0, 300.0, 50, at(1)), (False, 999.0, 2000.0, 7, at(2)), (True, None, None, None, at(3))]
    one = R.bench_rollup(spark.createDataFrame(rows, "ok boolean, ttft_ms double, latency_ms double, tokens long, ts timestamp")).first()
    assert (one["requests"], one["successful"], one["failed"], one["total_tokens"]) == (4, 3, 1, 100)
    assert (one["ttft_p50"], one["ttft_p95"], one["latency_p95"]) == (10.0, 30.0, 300.0)
    assert one["duration_s"] == 4.0 and one["tokens_per_sec"] == 25.0


def test_all_families_are_written_and_read_back(spark):
    samples = report_jobs.samples_of(spark, FOLDER)
    document = R.metrics_document(samples).orderBy("family", "part", "line").collect()
    assert {r["family"] for r in document} == set(R.FAMILIES) and len(R.FAMILIES) == 35
    seen = set()
    for r in document:  # each family's kind is written once, before its samples
        assert (r["part"] == 0) == (r["family"] not in seen)
        seen.add(r["family"])
    back = parse(spark.createDataFrame([(r["line"],) for r in document], "value string"))
    assert back.count() == samples.count()
    assert back.where("name = 'rag_build_info'").first()["labels"]["version"] == "1.0"


def test_empty_tables_leave_out_what_they_cannot_tell(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    got = R.service_samples(
        spark, R.Service(), ledger=none(ASKS), feedback=none("rating string"), triage=none("state string, age_hours double"), http=none("method string, path string, status int, n long"), chunks=none("doc string"), turns=none("session_id long"),
        cache=none("k int"), rerank=none("candidates int, reorders int, latency_ms double"), golden=none("source string"), runs=none("ts timestamp, accuracy double"), cases=none("passed boolean, faithfulness double"), bench=none("ok boolean, ttft_ms double, latency_ms double, tokens long, ts timestamp"),
    )
    values = {(r["name"], tuple(r["labels"].items())): r["value"] for r in got.collect()}
    assert values[("rag_ask_fallback_total", ())] == 0 and values[("rag_cache_hit_ratio", ())] == 0
    assert values[("rag_feedback_total", (("rating", "up"),))] == 0
    names = {n for n, _ in values}
    assert not names & {"rag_triage_oldest_open_hours", "rag_eval_accuracy", "rag_benchmark_tokens_per_sec", "rag_rerank_candidates_total"}


def test_report_of_odd_cells_and_empty_tables(spark):
    cases = spark.createDataFrame([(1, "a|b", "base", "two\nlines", None, None, None, -1.0)], "case_id long, category string, source string, question string, passed boolean, retrieval_hit boolean, faithfulness double, latency_ms double")
    runs = spark.createDataFrame([], "ts timestamp, label string, accuracy double, faithfulness double, p50 double")
    triage = spark.createDataFrame([], "state string, age_hours double, fallback boolean")
    lines = [r["line"] for r in R.quality_report(cases, runs, triage).orderBy("section", "part", "key").collect()]
    assert "| 1 | a\\|b | base | — | two lines |" in lines and "- faithfulness: —" in lines
    assert "- open: 0 · resolved: 0" in lines and "- oldest open: —" in lines
    assert [x for x in lines if x.startswith("## ")] == ["## Last run of the test set", "## Cases", "## Run history", "## Open answers"]


def test_turns_as_markdown(spark):
    rows = [(1, 0, "user", "q?"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "user", "again"), (2, 1, "assistant", "lone")]
    turns = R.answered_turns(spark.createDataFrame(rows, "session_id long, turn long, role string, text string"))
    turns = turns.withColumn("sources", F.when(F.col("turn") == 0, F.array(F.lit("x"), F.lit("y")))).withColumn("meta", F.when(F.col("turn") == 0, "5 ms"))
    got = {r["turn"]: r["markdown"] for r in R.turn_markdown(turns).collect()}
    assert got == {0: "## Q: q?\n\nyes\n\n**Sources:**\n1. x\n2. y\n\n*5 ms*", 2: "## Q: \n\n", 3: "## Q: again\n\n"}
