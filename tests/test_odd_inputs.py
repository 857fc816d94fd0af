"""Inputs on which a query once gave other rows than its SQL."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.jobs import registry
from quern.operators import answering as A

from .test_oracle import rows_of


def same_as_sql(spark, folder, name, **tables):
    """Whether a query gives its SQL's rows on tables (schema, rows); returns these rows."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = registry.queries()[name](spark, str(folder)), con.sql(registry.oracle_sql()[name])
    found = rows_of(got.collect(), got.columns)
    assert found == rows_of(want.fetchall(), want.columns)
    return found


DOCS = "doc_id long, text string"


def test_units_keep_digits_and_lose_blanks(spark, tmp_path):
    """The first sentences begin with their own number, which was taken for the characters to trim."""
    text = "Zero. 1 one 1. 22 two. 3, three"
    row = spark.createDataFrame([(text,)], "t string").select(X.units(F.col("t")).alias("u")).first()
    assert row["u"] == ["Zero.", "1 one 1.", "22 two.", "3, three"]
    assert len(same_as_sql(spark, tmp_path, "chunk_units", documents=(DOCS, [(1, text), (2, " a\n\n b "), (3, ""), (4, None)]))) == 6


def test_greedy_chunks_keep_the_digits_that_begin_a_sentence(spark, tmp_path):
    rows = [(k, " ".join(f"{i} is number {i} of {k}." for i in range(150))) for k in range(3)]
    assert len(same_as_sql(spark, tmp_path, "chunk_greedy", documents=(DOCS, rows))) > 6


def test_greedy_chunks_tell_blanks_of_any_kind_apart_as_the_sql_does(spark, tmp_path):
    blanks = ["\x0b", "\x0c", "\x01", "\x85", "\xa0", "\u2003", "\u3000", "\r\n", "\t"]
    rows = [(k, f"one.{b}two{b}three a{b}{b}b! x. {b} y") for k, b in enumerate(blanks)]
    assert len(same_as_sql(spark, tmp_path, "chunk_greedy", documents=(DOCS, rows))) == len(rows)
    same_as_sql(spark, tmp_path, "chunk_units", documents=(DOCS, rows))
    same_as_sql(spark, tmp_path, "approx_tokens", documents=(DOCS, rows))


def test_facts_match_in_any_case_of_any_letter(spark, tmp_path):
    texts = ["OSQUEÑ UND", "QUEÑ", "queÑ", "nation.", "xTIONx", "zzz", "e", None]
    found = same_as_sql(spark, tmp_path, "fact_match", documents=(DOCS, list(enumerate(texts))))
    assert [r[1] for r in sorted(found)[:3]] == ["queñ|quel"] * 3


def test_follow_ups_take_accented_letters_for_no_part_of_a_word(spark, tmp_path):
    turns = [(1, 0, "user", "xélesouvi and y"), (1, 1, "assistant", "Onè two three four five six seven"), (1, 2, "user", "\na b c d e f"), (1, 4, "user", "oné \x0bb c d e f g"), (2, 0, "user", "xlesouvi"), (2, 1, "user", "and what"), (1, 5, "user", "one b c d e f g")]
    found = same_as_sql(spark, tmp_path, "followup_resolve", conversations=("conv_id long, turn long, role string, text string", turns))
    assert sum(r[0] for r in found) == 3


def test_golden_stats_have_a_row_for_a_source_without_cases(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = lambda *rows: (schema, [(i, datetime(2024, 1, 1), 1, "view", 1.0, p) for i, p in rows])
    every = [(400, '{"k": 1}'), (401, '{"k": 1}'), (800, '{"k": 2}'), (802, '{"k": 2}')]
    assert same_as_sql(spark, tmp_path, "golden_stats", events=events(*every)) == [(0, "user"), (2, "base")]
    assert same_as_sql(spark, tmp_path, "golden_stats", events=events(*every, (803, '{"k": 3}'), (804, None))) == [(1, "user"), (2, "base")]
    assert same_as_sql(spark, tmp_path, "golden_stats", events=events(*every, (803, '{"k": 3}'), (1200, None))) == [(0, "user"), (3, "base")]


def test_units_of_answers_hold_no_whole_texts_and_are_not_broadcast(spark):
    text = " ".join(f"Sentence {k} is about the warranty of part {k}." for k in range(300))
    contexts = spark.createDataFrame([(1, 1, "a.md", "1", text), (1, 2, "b.md", "1", text + " more")], "query_id long, rank int, doc string, page string, text string")
    questions = spark.createDataFrame([(1, "warranty of part 17?")], "query_id long, question string")
    answers = A.extract_answers(contexts, questions, units=None)
    assert "part 17." in answers.first()["answer"]
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    cut = next(line for line in plan.split("\n") if "MapInArrow" in line)
    assert "unit#" in cut and "text#" not in cut.split("[", 1)[1].split("]", 1)[0]
    assert "rightHint=(strategy=merge)" in plan


def test_slices_bound_what_a_task_holds():
    import pyarrow as pa

    from quern.operators import ranking as R

    lists = pa.array([["a"] * n for n in (60_000, 50_000, 10, 250_000, 0, 7)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), lists], ["chunk_id", "t"]).slice(0, 6)
    parts = list(R._slices(iter([batch, batch.slice(0, 0)])))
    assert [p.column(0).to_pylist() for p in parts] == [[0], [1, 2], [3], [4, 5]]


def test_dense_top_in_small_slices_keeps_the_best_of_all(spark, monkeypatch):
    """One batch is cut into many slices, and a task hands on its k best only."""
    import numpy as np

    from quern.operators import ranking as R

    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_000, 6)).round(1)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>").coalesce(1)
    handed = []
    monkeypatch.setattr(R, "top_k", lambda out, k, top=R.top_k: handed.append(out) or top(out, k))
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in R.dense_top(vectors, vectors.where("id % 2 = 0"), 4).collect()}
    unit = x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-9)[:, None]
    near = np.argsort(-np.round(unit[::2] @ unit.T, 6), axis=1, kind="stable")[:, :4]
    assert got == {(2 * q, r + 1): near[q, r] for q in range(1_500) for r in range(4)}
    assert handed[0].count() == 1_500 * 4
