"""Growing the set of test cases from answers that were liked: an outcome for each request, and a merge that can be run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

CASE = "case_id string, request_id long, question string, expects string, category string, note string"


def outcomes(requests: DataFrame, ledger: DataFrame, golden: DataFrame) -> DataFrame:
    """(request_id, question, outcome) of each id of requests (request_id, place), once: added, duplicate, unlinkable or wrong_route.

    ledger: (request_id, question, route, fallback, ...); golden: cases with a question. A request is unlinkable without a ledger
    row, of the wrong route if its answer isn't grounded in documents, and a duplicate if the set or an earlier request has its
    question. Null ids are passed over.
    """
    asked = requests.where("request_id IS NOT NULL").groupBy("request_id").agg(F.min("place").alias("place"))
    rows = asked.join(ledger.select("request_id", "question", "route", "fallback"), "request_id", "left").withColumn("norm", X.question_key(F.col("question")))
    known = golden.select(X.question_key(F.col("question")).alias("norm")).distinct().withColumn("known", F.lit(True))
    bad = F.when(F.col("question").isNull(), "unlinkable").when((F.col("route") != "document") | F.col("fallback"), "wrong_route")
    rows = rows.withColumn("bad", bad)
    fit = rows.where("bad IS NULL")
    first = fit.groupBy("norm").agg(F.min(F.struct("place", "request_id"))["request_id"].alias("first"))  # one row a question, however often it is asked
    told = fit.join(first, "norm").join(known, "norm", "left").withColumn("outcome", F.when(F.col("known").isNotNull() | (F.col("request_id") != F.col("first")), "duplicate").otherwise("added"))
    return told.select("request_id", "question", "outcome").unionByName(rows.where("bad IS NOT NULL").select("request_id", "question", F.col("bad").alias("outcome")))


def promoted(requests: DataFrame, ledger: DataFrame, golden: DataFrame, note: str = "") -> DataFrame:
    """The cases CASE with those that are added. A case's id is that of its request, so a second run adds nothing."""
    new = outcomes(requests, ledger, golden).where("outcome = 'added'")
    case_id = F.concat(F.lit("usr-"), F.substring(F.sha2(F.col("request_id").cast("string"), 256), 1, 8))
    rows = new.select(case_id.alias("case_id"), "request_id", F.trim("question").alias("question"), F.lit("grounded").alias("expects"), F.lit("feedback").alias("category"), F.substring(F.trim(F.lit(note)), 1, 300).alias("note"))
    return golden.unionByName(rows.join(golden.select("case_id"), "case_id", "left_anti"))
