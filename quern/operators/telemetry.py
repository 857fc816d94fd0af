"""Plans over the tables of a question-answering service: ledger, feedback, resolutions, runs, turns.

All take DataFrames of the shapes given in their docstrings and know nothing of where they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as X

#: Upper bounds of the latency histogram, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)


def micros(ts: Column) -> Column:
    """Microseconds of an instant; an instant without a zone is in the session's."""
    return F.unix_micros(ts.cast("timestamp"))


def last_write(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the latest by the order columns."""
    newest = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.col(c) for c in order]))
    return rows.groupBy(key).agg(newest.alias("_row")).select("_row.*")


def newest(rows: DataFrame, cap: int, *order: str) -> DataFrame:
    """The `cap` latest rows, by a bounded sort on every task and one merge."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(cap)


def newest_of_each(rows: DataFrame, key: str, cap: int, *order: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= cap).drop("_n")


def percentiles(name: str, nearest: bool = False) -> list[Column]:
    """p50 and p95, by linear interpolation or by nearest rank."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {name})") if nearest else F.expr(f"percentile({name}, {p})")
    return [F.round(at(p), 4).alias(f"p{round(100 * p)}") for p in (0.5, 0.95)]


def route_counts(ledger: DataFrame) -> DataFrame:
    """(route, asks, fallbacks, cache_hits, mean_latency, fallback_rate) of a ledger (route, fallback, cache_hit, latency_ms)."""
    return ledger.groupBy("route").agg(
        F.count("*").alias("asks"),
        F.count_if("fallback").alias("fallbacks"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.round(F.avg("latency_ms"), 4).alias("mean_latency"),
        F.round(F.count_if("fallback") / F.count("*"), 4).alias("fallback_rate"),
    )


def latency_histogram(ledger: DataFrame) -> DataFrame:
    """(route, le, n): cumulative counts. Every ledger row is counted once, into one bucket; the sums run over the few buckets."""
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in BUCKETS]), lambda b: b < F.col("latency_ms") / 1000))
    counted = ledger.groupBy("route", bucket.alias("slot")).agg(F.count("*").alias("n"))
    slots = counted.groupBy("route").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("by_slot"))
    le = [f"{b:g}" for b in BUCKETS] + ["+Inf"]
    wide = slots.select("route", F.explode(F.array(*[F.struct(F.lit(le[i]).alias("le"), sum((F.coalesce(F.try_element_at("by_slot", F.lit(j)), F.lit(0)) for j in range(i + 1)), F.lit(0).cast("long")).alias("n")) for i in range(len(le))])).alias("b"))
    return wide.select("route", "b.le", "b.n")


def approval(feedback: DataFrame) -> DataFrame:
    """(ups, downs, approval) of feedback (request_id, rating)."""
    ups, downs = F.count_if(F.col("rating") == "up"), F.count_if(F.col("rating") == "down")
    return feedback.agg(ups.alias("ups"), downs.alias("downs"), F.round(ups / F.greatest(F.lit(1), ups + downs), 4).alias("approval"))


def leaderboard(ledger: DataFrame, feedback: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent questions with rates and ratings, by count and then by the latest ask."""
    rated = ledger.join(feedback.select("request_id", "rating"), "request_id", "left").withColumn("norm", X.normal_question(F.col("question")))
    grouped = rated.groupBy("norm").agg(
        F.min_by("question", F.struct("ts", "request_id")).alias("question"),
        F.count("*").alias("n"),
        F.max("ts").alias("last_ts"),
        F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"),
        F.round(F.avg(F.col("fallback").cast("double")), 4).alias("fallback_rate"),
        F.round(F.avg(F.col("cache_hit").cast("double")), 4).alias("cache_rate"),
        F.round(F.avg("latency_ms"), 4).alias("mean_latency"),
        F.count_if(F.col("rating") == "up").alias("ups"),
        F.count_if(F.col("rating") == "down").alias("downs"),
    )
    return grouped.orderBy(F.desc("n"), F.desc("last_ts"), "norm").limit(top)


def candidates(feedback: DataFrame, ledger: DataFrame, golden: DataFrame) -> DataFrame:
    """(reason, n): what becomes of upvoted answers on their way to the golden set (question)."""
    up = feedback.where("rating = 'up'").join(ledger, "request_id", "left")
    known = golden.select(X.question_key(F.col("question")).alias("norm")).distinct().withColumn("known", F.lit(True))
    up = up.withColumn("norm", X.question_key(F.col("question"))).join(known, "norm", "left")
    first = F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("ts"), "request_id"))
    fit = F.col("question").isNotNull() & (F.col("route") == "document") & ~F.col("fallback") & F.col("known").isNull()
    reason = F.when(F.col("question").isNull(), "unlinkable").when((F.col("route") != "document") | F.col("fallback"), "skipped_route").when(F.col("known"), "skipped_duplicate")
    ranked = up.where(fit).withColumn("_n", first).select(F.when(F.col("_n") == 1, "shown").otherwise("skipped_duplicate").alias("reason"))
    return up.where(~F.coalesce(fit, F.lit(False))).select(reason.alias("reason")).unionByName(ranked).groupBy("reason").agg(F.count("*").alias("n"))


def triage(feedback: DataFrame, ledger: DataFrame, resolutions: DataFrame, now: Column) -> DataFrame:
    """One row a downvote: (request_id, state, age_hours, tone, fallback, linked)."""
    down = feedback.where("rating = 'down'").select("request_id", F.col("ts").alias("voted"))
    rows = down.join(ledger.drop("ts"), "request_id", "left").join(resolutions, "request_id", "left")
    age = F.round((micros(now) - micros(F.col("voted"))) / 3.6e9, 1)
    tone = F.when(age >= 48, "rose").when(age >= 6, "amber").otherwise("slate")
    return rows.select("request_id", F.when(F.col("resolved_at").isNotNull(), "resolved").otherwise("open").alias("state"), age.alias("age_hours"), tone.alias("tone"), F.coalesce("fallback", F.lit(False)).alias("fallback"), F.col("route").isNotNull().alias("linked"))


def eval_report(results: DataFrame) -> DataFrame:
    """Per category and in all, in one pass: results (category, passed, retrieval_hit, faithfulness, latency_ms)."""
    return results.groupingSets([["category"], []], "category").agg(
        F.grouping("category").alias("is_total"),
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.round(F.avg(F.col("passed").cast("double")), 4).alias("accuracy"),
        F.round(F.avg(F.col("retrieval_hit").cast("double")), 4).alias("hit_rate"),
        F.round(F.avg("faithfulness"), 4).alias("faithfulness"),
        F.round(F.expr("percentile(if(latency_ms > 0, latency_ms, null), 0.5)"), 4).alias("p50"),
        F.round(F.expr("percentile(if(latency_ms > 0, latency_ms, null), 0.95)"), 4).alias("p95"),
    )


def ablation(results: DataFrame, baseline: str) -> DataFrame:
    """(config, accuracy, p50, delta, winner) of results (config, passed, latency_ms); the winner by accuracy, then speed, then name."""
    by = results.groupBy("config").agg(F.round(F.avg(F.col("passed").cast("double")), 4).alias("accuracy"), F.round(F.expr("percentile(latency_ms, 0.5)"), 4).alias("p50"))
    whole = by.agg(F.max(F.when(F.col("config") == baseline, F.col("accuracy"))).alias("base"), F.max_by("config", F.struct("accuracy", -F.col("p50"), "config")).alias("best")).first()  # one row
    return by.select("config", "accuracy", "p50", F.round(F.col("accuracy") - F.lit(whole["base"]), 4).alias("delta"), (F.col("config") == F.lit(whole["best"])).alias("winner"))


def run_trend(runs: DataFrame) -> DataFrame:
    """(runs, first_accuracy, last_accuracy, best_accuracy, best_label, delta, flat) of runs (ts, label, ablation, accuracy)."""
    own = runs.where(~F.col("ablation"))
    return own.agg(
        F.count("*").alias("runs"),
        F.min_by("accuracy", "ts").alias("first_accuracy"),
        F.max_by("accuracy", "ts").alias("last_accuracy"),
        F.max("accuracy").alias("best_accuracy"),
        F.max_by("label", F.struct("accuracy", "ts")).alias("best_label"),
        F.round(F.max_by("accuracy", "ts") - F.min_by("accuracy", "ts"), 4).alias("delta"),
        (F.max("accuracy") == F.min("accuracy")).alias("flat"),
    )


def entities(text: Column) -> Column:
    """Codes and versions of a text, distinct, in lower case."""
    found = [F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1)) for p in L.TURN_ENTITIES]
    return F.array_distinct(F.concat(*found))


def follow_ups(turns: DataFrame, own: Column, cue: Column) -> DataFrame:
    """Turns (session_id, turn, question, route) with the entities that an elliptical question takes over.

    own: the entities of a turn; cue: whether the question refers back. A turn without entities inherits
    the first two of the latest earlier document turn that has any.
    """
    carried = F.when((F.col("route") == "document") & (F.size("own") > 0), F.slice("own", 1, 2))
    earlier = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("own", own).withColumn("inherited", F.last(carried, ignorenulls=True).over(earlier))
    short = F.size(F.regexp_extract_all("question", F.lit("[^ \\n\\t\\r]+"), F.lit(0))) <= 6
    applied = (F.size("own") == 0) & F.col("inherited").isNotNull() & (short | cue)
    effective = F.when(applied, F.concat_ws(" ", F.trim("question"), F.array_join("inherited", " "))).otherwise(F.trim("question"))
    return rows.withColumn("applied", F.coalesce(applied, F.lit(False))).withColumn("effective_question", effective)


def session_list(turns: DataFrame) -> DataFrame:
    """(session_id, turns, last_turn, preview) of turns (session_id, turn, question)."""
    last = F.max_by("question", "turn")
    cut = F.when(F.length(last) > 48, F.concat(F.substring(last, 1, 45), F.lit("…"))).otherwise(last)
    return turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.concat(F.count("*").cast("string"), F.lit(" turns · "), cut).alias("preview"))


def stage_times(trace: DataFrame) -> DataFrame:
    """(step, visits, total_ms) of a trace (run, ts, step): a step lasts since the step before it in its run."""
    before = F.lag("ts").over(Window.partitionBy("run").orderBy("ts", "seq"))
    spent = trace.withColumn("ms", (micros(F.col("ts")) - micros(before)) / 1000)
    return spent.groupBy("step").agg(F.count("*").alias("visits"), F.round(F.sum("ms"), 3).alias("total_ms"))


def histogram_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """(route, value): the quantile interpolated in cumulative buckets (route, le, n), as a dashboard does."""
    bound = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    by = Window.partitionBy("route").orderBy("bound")
    rows = histogram.withColumn("bound", bound).withColumns({"low": F.coalesce(F.lag("bound").over(by), F.lit(0.0)), "under": F.coalesce(F.lag("n").over(by), F.lit(0)), "whole": F.max("n").over(Window.partitionBy("route"))})
    hit = rows.where((F.col("n") >= F.col("whole") * q) & (F.col("under") < F.col("whole") * q))
    inside = F.col("low") + (F.col("bound") - F.col("low")) * (F.col("whole") * q - F.col("under")) / (F.col("n") - F.col("under"))
    return hit.select("route", F.round(F.when(F.col("bound") == float("inf"), F.col("low")).otherwise(inside), 6).alias("value"))


def counter_rates(samples: DataFrame, width: str = "5 minutes", step: str | None = None, *by: str) -> DataFrame:
    """(by..., start, increase, rate) of counters scraped now and then: samples (by..., ts, value), by window [start, start + width).

    A value below the one before it is a restart: the counter went on from zero. The increase between a window's first and last sample is
    extended to its edges, as a dashboard's rate() does: up to the edge if that is within 1.1 mean intervals, else
    by half an interval; and back no further than to where the counter would be zero. Windows of one sample have no
    rate. Null values and times are passed over; samples of the same time count in order of their value.
    """
    window = F.window("ts", width, step) if step else F.window("ts", width)
    seen = samples.where("ts IS NOT NULL AND value IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    point = F.struct((micros(F.col("ts")) / 1e6).alias("t"), F.col("value").cast("double").alias("v"))
    rows = seen.groupBy(*by, window).agg(F.array_sort(F.collect_list(point)).alias("p")).where(F.size("p") > 1)
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    restarts = F.aggregate(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b")), F.lit(0.0), lambda s, x: s + F.when(x["b"]["v"] < x["a"]["v"], x["a"]["v"]).otherwise(0.0))
    rows = rows.select(*by, F.col("window.start").alias("start"), (last["v"] - first["v"] + restarts).alias("grown"), first["v"].alias("least"), (last["t"] - first["t"]).alias("span"), (first["t"] - micros(F.col("window.start")) / 1e6).alias("head"), (micros(F.col("window.end")) / 1e6 - last["t"]).alias("tail"), (micros(F.col("window.end")) / 1e6 - micros(F.col("window.start")) / 1e6).alias("width"), ((last["t"] - first["t"]) / (F.size("p") - 1)).alias("mean"))
    edge = lambda c: F.when(c >= F.col("mean") * 1.1, F.col("mean") / 2).otherwise(c)
    zero = F.when((F.col("grown") > 0) & (F.col("least") >= 0), F.col("span") * F.col("least") / F.col("grown"))
    head = F.least(edge(F.col("head")), F.coalesce(zero, F.lit(float("inf"))))
    increase = F.col("grown") * (F.col("span") + head + edge(F.col("tail"))) / F.col("span")
    return rows.where("span > 0").select(*by, "start", increase.alias("increase"), (increase / F.col("width")).alias("rate"))


def exposition(samples: DataFrame) -> DataFrame:
    """(name, line) in the metrics text format, of samples (name, labels map<string,string>, value)."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return samples.select("name", F.concat("name", labels, F.lit(" "), F.col("value").cast("string")).alias("line"))
