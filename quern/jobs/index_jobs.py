"""Queries on the published index, merged sub-queries, live cache entries and promoted cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import caching, indexed, promotion
from ..operators import ranking as R
from ..sources import tables
from .catalog import query, table
from .rank_jobs import SQL_BM25, SQL_COS, chunks_of, questions_of
from .telemetry_jobs import SQL_KEY, SQL_LEDGER, ledger_of


@query(f"WITH {SQL_BM25} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm25 WHERE rank <= 10")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of bm25_topk, from an index that is published first and read by its bounds."""
    folder = tables.shared_folder(spark, "index")
    tables.publish(spark, folder, indexed.index_tables(chunks_of(spark, sf_dir)))
    return indexed.searched(spark, folder, questions_of(spark, sf_dir), 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH {SQL_BM25}, h AS (SELECT query_id // 2 AS q, query_id % 2 AS sub_no, 'src' || (query_id % 12) AS code, chunk_id, source, text, round(score, 6) AS score, rank FROM bm25 JOIN documents ON doc_id = chunk_id WHERE rank <= 12),
    o AS (SELECT *, row_number() OVER (PARTITION BY q, sub_no ORDER BY contains(lower(source), code) DESC, contains(lower(text), code) DESC, rank) AS pos FROM h),
    b AS (SELECT *, max(score) OVER (PARTITION BY q, chunk_id ORDER BY sub_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM o WHERE pos <= 4),
    t AS (SELECT *, row_number() OVER (PARTITION BY q, sub_no ORDER BY pos) AS turn FROM b WHERE best IS NULL OR score > best),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, chunk_id ORDER BY turn, sub_no) AS d FROM t) WHERE d = 1),
    n AS (SELECT q, count(DISTINCT sub_no) AS subs FROM h GROUP BY q)
    SELECT q AS query_id, sub_no, chunk_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY turn, sub_no) AS pick FROM f) JOIN n USING (q) WHERE pick <= greatest(6, 3 * subs)"""
)
def sub_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two items each are the sub-queries of a question; their code is a source's name."""
    pair = F.floor(F.col("query_id") / 2)
    found = R.bm25_top(chunks_of(spark, sf_dir), questions_of(spark, sf_dir), 12).join(chunks_of(spark, sf_dir), "chunk_id")
    hits = found.select(pair.alias("query_id"), (F.col("query_id") % 2).alias("sub_no"), F.concat(F.lit("about src"), (F.col("query_id") % 12).cast("string")).alias("sub_query"), "chunk_id", "doc", "text", F.round("score", 6).alias("score"), "rank")
    return R.merge_sub_queries(hits, 6)


@query(
    f"""WITH a AS (SELECT vec_id AS id, vec_id * 60 AS ts, label || ':' || (vec_id % 97) AS norm, vec_id % 2 AS top_k, embedding FROM embeddings),
    x AS (SELECT q.id AS query_id, max(e.id) AS entry FROM a q JOIN a e ON e.norm = q.norm AND e.ts < q.ts AND q.ts - e.ts <= 18000 WHERE q.id % 20 = 0 GROUP BY q.id),
    s AS (SELECT a.id AS query_id, b.id AS entry, {SQL_COS} AS sim FROM a, a b WHERE a.id % 20 = 0 AND b.ts < a.ts AND a.ts - b.ts <= 18000 AND a.top_k = b.top_k),
    n AS (SELECT query_id, entry, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, entry) AS r FROM s WHERE round(sim, 6) >= 0.3) WHERE r = 1)
    SELECT q.id AS query_id, CASE WHEN x.entry IS NOT NULL THEN 'exact' WHEN n.entry IS NOT NULL THEN 'near' ELSE 'miss' END AS tier, coalesce(x.entry, n.entry) AS entry, round(CASE WHEN x.entry IS NOT NULL THEN 1.0 ELSE n.sim END, 6) AS similarity
    FROM a q LEFT JOIN x ON x.query_id = q.id LEFT JOIN n ON n.query_id = q.id WHERE q.id % 20 = 0"""
)
def cache_match_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector is an ask, a minute after the one before; entries live for five hours."""
    asks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 60).alias("ts"), F.concat_ws(":", F.col("label").cast("string"), (F.col("vec_id") % 97).cast("string")).alias("norm"), (F.col("vec_id") % 2).alias("top_k"), F.col("embedding").alias("vector"))
    return caching.live_matches(asks, asks.where("id % 20 = 0"), ttl=18_000, least=0.3).withColumn("similarity", F.round("similarity", 6))


_PROMOTED = f"""WITH {SQL_LEDGER}, r AS (SELECT CASE WHEN event_id % 9 = 0 THEN event_id + 10000000 ELSE event_id - event_id % 3 END AS request_id, event_id AS place FROM events WHERE event_id % 5 < 3),
    d AS (SELECT request_id, min(place) AS place FROM r GROUP BY request_id),
    g AS (SELECT DISTINCT {SQL_KEY} AS norm FROM ledger WHERE request_id % 400 = 0),
    j AS (SELECT d.request_id, place, question, {SQL_KEY} AS norm, CASE WHEN question IS NULL THEN 'unlinkable' WHEN route <> 'document' OR fallback THEN 'wrong_route' END AS bad FROM d LEFT JOIN ledger l ON l.request_id = d.request_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY norm, bad ORDER BY place, request_id) AS n FROM j)
    SELECT o.request_id, coalesce(bad, CASE WHEN g.norm IS NOT NULL OR n > 1 THEN 'duplicate' ELSE 'added' END) AS outcome FROM o LEFT JOIN g ON g.norm = o.norm"""


@query(_PROMOTED)
def promote_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to promote, some of them twice, of unknown ids, or answered outside of the documents."""
    ledger, events = ledger_of(spark, sf_dir), table(spark, sf_dir, "events")
    asked = events.where("event_id % 5 < 3").select(F.when(F.col("event_id") % 9 == 0, F.col("event_id") + 10_000_000).otherwise(F.col("event_id") - F.col("event_id") % 3).alias("request_id"), F.col("event_id").alias("place"))
    return promotion.outcomes(asked, ledger, ledger.where("request_id % 400 = 0").select("question")).select("request_id", "outcome")
