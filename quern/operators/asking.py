"""The whole way from questions to answers, with a bounded number of rewrites of what found nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept
from . import answering as A
from . import indexed
from . import ranking as R


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 6, index: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): two lexical rankings fused with chunks of code-named documents, weighed and cut to k.

    index: the folder of a published index of the chunks, which is then read instead of their texts for BM25.
    """
    keyed = chunks.select("chunk_id", R.search_text(chunks).alias("text"))
    sparse = R.bm25_top(keyed, questions, 3 * k) if index is None else indexed.searched(chunks.sparkSession, index, questions, 3 * k)
    fused = kept(R.rrf([sparse, R.coverage_top(chunks, questions, 3 * k)]))
    named = R.code_named(fused, chunks, questions).select("query_id", "chunk_id", "fused", F.lit(0).cast("long").alias("lists"), F.lit(0).alias("rank_0"), F.lit(0).alias("rank_1"))
    return R.top_k(R.blend(kept(fused.unionByName(named)), chunks, questions), k, places=4).select("query_id", "chunk_id", "score", "rank")


def compare(questions: DataFrame, chunks: DataFrame, k: int = 6, index: str | None = None, units: int | None = 20) -> DataFrame:
    """(query_id, answer) of the comparing questions: each of their sub-queries searches, their chunks are merged and answer line by line. units: as in extract_answers()."""
    subs = kept(A.decompose(questions))
    key = F.concat_ws("#", F.col("query_id").cast("string"), F.col("sub_no").cast("string"))
    keys = subs.select(key.alias("key"), "query_id", "sub_no", "sub_query")
    per = max(3, k // 2 + 1)
    found = retrieve(chunks, keys.select(F.col("key").alias("query_id"), F.col("sub_query").alias("question")), 3 * per, index).withColumnRenamed("query_id", "key")
    hits = kept(found.join(keys, "key").join(chunks.select("chunk_id", "doc", "page", "text"), "chunk_id"))
    merged = R.merge_sub_queries(hits, k).join(hits.select("query_id", "sub_no", "chunk_id", "doc", "page", "text"), ["query_id", "sub_no", "chunk_id"])
    return A.compare_answers(merged.withColumnRenamed("pick", "rank"), subs, units=units)


def ask(questions: DataFrame, chunks: DataFrame, vocabulary: DataFrame, rewrites: int = 2, least: float = 0.35, units: int | None = 20, index: str | None = None) -> DataFrame:
    """(query_id, route, attempts, verdict, support, answer): one row a question.

    questions: (query_id, question); chunks: (chunk_id, doc, page, text). Each round takes only the questions that
    are still without a relevant chunk, under their rewritten form; there are rewrites + 1 rounds at most, and
    each is a table in the shared folder. What is never resolved, or isn't supported by its
    contexts, gets the honest fallback. A comparing question is answered by a line for each thing that it compares. index: as in retrieve(). units: as in extract_answers(), None where chunks are whole documents.
    """
    routed = kept(A.route(questions, vocabulary).join(questions, "query_id"))
    todo, found = routed.where("route = 'document'").select("query_id", "question"), None
    for attempt in range(rewrites + 1):
        pairs = retrieve(chunks, todo, index=index).join(chunks.select("chunk_id", "doc", "page", "text"), "chunk_id").join(todo, "query_id")
        graded = kept(A.best_first(A.grade(pairs), least).select("query_id", "chunk_id", "doc", "page", "text", "grade", F.col("pick").alias("rank"), F.lit(attempt + 1).alias("attempts")))
        found = graded if found is None else found.unionByName(graded)
        left = todo.join(graded.select("query_id").distinct(), "query_id", "left_anti")
        if attempt == rewrites or left.isEmpty():
            break
        todo = kept(A.rewrite(left).withColumnRenamed("rewritten", "question"))
    contexts = R.per_doc_quota(found).withColumn("rank", F.col("pick")).drop("pick")
    answered = questions.join(found.select("query_id", "attempts").distinct(), "query_id")
    drafts = kept(A.extract_answers(contexts, answered.select("query_id", "question"), units=units))
    lines = compare(routed.where("route = 'document'").select("query_id", "question"), chunks, index=index, units=units).select("query_id", F.col("answer").alias("compared"))
    drafts = kept(drafts.join(lines, "query_id", "left").withColumn("answer", F.coalesce("compared", "answer")).drop("compared"))
    checked = A.verify(drafts, contexts)
    rows = routed.select("query_id", "route", "question").join(answered.select("query_id", "attempts"), "query_id", "left").join(drafts, "query_id", "left").join(checked, "query_id", "left")
    good = F.col("verdict") == "supported"
    told = A.fallback_text(rows.select("query_id", "route", F.lit(0.0).alias("best"), "support", F.lit(rewrites).alias("retries"))).select("query_id", F.col("answer").alias("honest"))
    answer = F.when(F.col("route") == "chitchat", A.small_talk(F.col("question"))).when(good, F.col("answer")).otherwise(F.col("honest"))
    return rows.join(told, "query_id").select("query_id", F.when((F.col("route") == "document") & ~F.coalesce(good, F.lit(False)), "fallback").otherwise(F.col("route")).alias("route"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("verdict", F.lit("none")).alias("verdict"), F.coalesce("support", F.lit(0.0)).alias("support"), answer.alias("answer"))
