"""Test cases of a question-answering service: matching, passing, growth of the set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def first_match(text: Column, patterns: Column) -> Column:
    """The first of the patterns that a text matches, in any case of any script, as an expression or as it stands; null if none does."""
    return F.get(F.filter(patterns, lambda p: F.rlike(text, F.concat(F.lit("(?iu)"), p)) | F.contains(F.lower(text), F.lower(p))), F.lit(0))


def expected_document(docs: Column, expected: Column) -> Column:
    """Whether one of the documents is named as expected, by its beginning or a part of it."""
    return F.exists(docs, lambda d: F.exists(expected, lambda e: F.contains(d, e)))


def outcome(results: DataFrame) -> DataFrame:
    """Rows (expects, route, fact, hit, faithfulness) with route_ok and passed."""
    ok = F.when(F.col("expects") == "grounded", F.col("route") == "document").when(F.col("expects") == "fallback", F.col("route").isin("fallback", "out_of_scope")).otherwise(F.col("route") == F.col("expects"))
    grounded = F.col("expects") == "grounded"
    passed = ok & F.col("fact") & (~grounded | F.coalesce("hit", F.lit(True))) & (F.coalesce("faithfulness", F.lit(1.0)) >= 0.5)
    return results.withColumn("route_ok", ok).withColumn("passed", passed)


def grown_set(base: DataFrame, added: DataFrame) -> DataFrame:
    """(question, source) of the base cases and of added ones that are no question of the base, each once."""
    norm = X.question_key(F.col("question"))
    rows = base.select("question", F.lit("base").alias("source"), F.lit(0).alias("_o"), norm.alias("_n")).unionByName(added.where(F.length(F.trim("question")).between(3, 1000)).select("question", F.lit("user").alias("source"), F.lit(1).alias("_o"), norm.alias("_n")))
    return rows.groupBy("_n").agg(F.min(F.struct("_o", "question", "source")).alias("r")).select("r.question", "r.source")


def cacheable(answers: DataFrame) -> DataFrame:
    """Answers that may be served again: of the document route, no fallback, not empty, not an honest miss."""
    return answers.where((F.col("route") == "document") & ~F.col("fallback") & (F.trim("answer") != "") & ~F.contains(F.lower("answer"), F.lit("couldn't find")))


def cache_stats(lookups: DataFrame) -> DataFrame:
    """(entries, hits, misses, hit_rate) of rows (hit boolean); a miss is stored."""
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    return lookups.agg(misses.alias("entries"), hits.alias("hits"), misses.alias("misses"), F.round(hits / F.greatest(F.lit(1), hits + misses), 4).alias("hit_rate"))


def reorder_stats(reranked: DataFrame) -> DataFrame:
    """(query_id, moved, top) of rows (query_id, chunk_id, fusion_rank, rank): how many places changed, and the new first chunk."""
    return reranked.groupBy("query_id").agg(F.count_if(F.col("rank") != F.col("fusion_rank")).alias("moved"), F.min_by("chunk_id", "rank").alias("top"))
