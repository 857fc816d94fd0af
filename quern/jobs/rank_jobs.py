"""Queries on retrieval: benchmark items are the questions, documents the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import ranking as R
from ..sources.tables import kept
from .catalog import query, table
from .text_jobs import SQL_TERMS, SQL_TOKENS, SQL_WORDS, sql_stem


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), "text")


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def ranked_bm25(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return R.bm25_top(chunks_of(spark, sf_dir), questions_of(spark, sf_dir), k)


SQL_BM25 = f"""d AS (SELECT doc_id AS chunk_id, {SQL_TOKENS} AS t FROM documents),
    st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    po AS (SELECT chunk_id, term, size, count(*) AS tf FROM (SELECT chunk_id, len(t) AS size, unnest(t) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({SQL_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
    bm AS (SELECT query_id, chunk_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score
        FROM q JOIN df USING (term) JOIN po USING (term), st GROUP BY ALL HAVING score > 1e-9),
    bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM bm)"""


@query(f"WITH {SQL_BM25} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm25 WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_bm25(spark, sf_dir, 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_BM25} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, st")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.idf_table(chunks_of(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


SQL_UNI = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@query(
    f"""WITH d AS (SELECT doc_id AS chunk_id, {SQL_UNI} AS t FROM documents),
    st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    po AS (SELECT chunk_id, term, size, count(*) AS tf FROM (SELECT chunk_id, len(t) AS size, unnest(t) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po, st GROUP BY term),
    fl AS (SELECT 0.25 * avg(raw) AS floor FROM df),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({SQL_UNI}) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT query_id, chunk_id, sum(qtf * CASE WHEN raw < 0 THEN floor ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score
        FROM q JOIN df USING (term) JOIN po USING (term), st, fl GROUP BY ALL HAVING score > 0)
    SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id DESC) AS rank FROM s) WHERE rank <= 10"""
)
def okapi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties the other way round: to the later chunk."""
    return R.okapi_top(chunks_of(spark, sf_dir), questions_of(spark, sf_dir), 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


SQL_COS = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
SQL_DENSE = f"dn AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {SQL_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM dn)"


@query(f"WITH {SQL_DENSE} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM dense WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vectors_of(spark, sf_dir)
    return R.dense_top(vectors, vectors.where("id % 20 = 0"), 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {SQL_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({SQL_COS}, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id < a.vec_id AND {SQL_COS} >= 0.4 - 1e-9) WHERE rank = 1")
def semantic_cache_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest earlier entry of each question, if it is near enough to be served again."""
    vectors = vectors_of(spark, sf_dir)
    return R.dense_top(vectors, vectors.where("id % 20 = 0"), 1, earlier=True, least=0.4).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH RECURSIVE {SQL_DENSE},
    pool AS MATERIALIZED (SELECT query_id AS q, chunk_id AS c, rank AS r, score AS s, embedding::DOUBLE[] AS v FROM dense JOIN embeddings ON vec_id = chunk_id WHERE rank <= 20),
    sims AS MATERIALIZED (SELECT x.q, x.r AS a, y.r AS b, list_inner_product(x.v, y.v) AS sim FROM pool x JOIN pool y USING (q)),
    pick AS (SELECT q, [r] AS sel, 1 AS n FROM pool WHERE r = 1
        UNION ALL
        SELECT q, list_append(sel, best), n + 1 FROM (
            SELECT k.q, k.sel, k.n, arg_max(p.r, struct_pack(w := round(0.7 * p.s - 0.3 * m.sim, 9), o := -p.r)) AS best
            FROM pick k JOIN pool p ON p.q = k.q AND NOT list_contains(k.sel, p.r)
            JOIN LATERAL (SELECT max(sim) AS sim FROM sims x WHERE x.q = p.q AND x.a = p.r AND list_contains(k.sel, x.b)) m ON true
            WHERE k.n < 5 GROUP BY k.q, k.sel, k.n))
    SELECT q AS query_id, c AS chunk_id, pick FROM (SELECT q, unnest(sel) AS r, generate_subscripts(sel, 1) AS pick FROM pick WHERE n = 5) JOIN pool USING (q, r)"""
)
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vectors_of(spark, sf_dir)
    pool = R.dense_top(vectors, vectors.where("id % 20 = 0"), 20).join(vectors.select(F.col("id").alias("chunk_id"), "vector"), "chunk_id")
    return R.mmr(pool, 5)


SQL_STEMS = f"list_distinct(list_transform({SQL_TERMS}, lambda t: {sql_stem('t')}))"
SQL_HELD = f"list_distinct(list_transform(list_filter({SQL_WORDS}, lambda t: length(t) > 2 OR regexp_full_match(t, '[0-9]+')), lambda t: {sql_stem('t')}))"
SQL_COVER = f"""qs AS (SELECT item_id AS query_id, unnest({SQL_STEMS}) AS stem FROM benchmark),
    qn AS (SELECT query_id, count(*) AS whole FROM qs GROUP BY 1),
    hs AS (SELECT doc_id AS chunk_id, unnest({SQL_HELD}) AS stem FROM (SELECT doc_id, text || ' ' || source AS text FROM documents)),
    cover AS (SELECT query_id, chunk_id, least(1.0, count(*) / any_value(whole)) AS coverage FROM qs JOIN hs USING (stem) JOIN qn USING (query_id) GROUP BY ALL),
    covered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(coverage, 6) DESC, chunk_id) AS rank FROM cover)"""


@query(f"WITH {SQL_COVER} SELECT query_id, chunk_id, rank, round(coverage, 6) AS coverage FROM covered WHERE rank <= 20")
def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coverage_top(chunks_of(spark, sf_dir), questions_of(spark, sf_dir), 20).select("query_id", "chunk_id", "rank", F.round("coverage", 6).alias("coverage"))


SQL_FUSED = f"""{SQL_BM25}, {SQL_COVER},
    ls AS (SELECT query_id, chunk_id, rank, 0 AS l FROM bm25 WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM covered WHERE rank <= 20),
    fused AS (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS fused, count(*) AS lists FROM ls GROUP BY ALL)"""


def lists_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and stems of every chunk: texts are split once for all that ranks them."""
    return kept(R.term_lists(chunks_of(spark, sf_dir), stems=True))


def fused_of(spark: SparkSession, sf_dir: str, lists: DataFrame | None = None) -> DataFrame:
    chunks, questions, lists = chunks_of(spark, sf_dir), questions_of(spark, sf_dir), lists_of(spark, sf_dir) if lists is None else lists
    return kept(R.rrf([R.bm25_top(chunks, questions, 20, lists=lists), R.coverage_top(chunks, questions, 20, lists)]))


def found_of(spark: SparkSession, sf_dir: str, fused: DataFrame) -> DataFrame:
    """The chunks of a pool, whose size its lists bound: what looks at their texts doesn't read the others again."""
    return kept(chunks_of(spark, sf_dir).join(fused.select("chunk_id").distinct(), "chunk_id", "left_semi"))


@query(f"WITH {SQL_FUSED} SELECT query_id, chunk_id, round(fused, 6) AS fused, lists, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 6) DESC, chunk_id) AS rank FROM fused) WHERE rank <= 40")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(fused_of(spark, sf_dir), 40, score="fused").select("query_id", "chunk_id", F.round("fused", 6).alias("fused"), "lists", "rank")


SQL_BLENDED = f"""b AS (SELECT query_id, chunk_id, round(least(1.0, 0.55 * fused / max(fused) OVER (PARTITION BY query_id) + 0.35 * coalesce(coverage, 0) + 0.10 * (CASE WHEN lists > 1 THEN 1 ELSE 0 END)), 4) AS score, round(coalesce(coverage, 0), 4) AS coverage
        FROM fused LEFT JOIN cover USING (query_id, chunk_id))"""


@query(
    f"""WITH {SQL_FUSED}, {SQL_BLENDED}
    SELECT query_id, chunk_id, score, coverage, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b) WHERE rank <= 10"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fused_of(spark, sf_dir)
    scored = R.blend(fused, found_of(spark, sf_dir, fused), questions_of(spark, sf_dir))
    return R.top_k(scored, 10, places=4).select("query_id", "chunk_id", "score", "coverage", "rank")


@query()
def hybrid_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As hybrid_search, with hashed vectors and diversity picks as the second retriever."""
    chunks, questions = chunks_of(spark, sf_dir), questions_of(spark, sf_dir)
    vectors = kept(R.hash_vectors(chunks, "chunk_id", "text"))
    pool = R.dense_top(vectors, R.hash_vectors(questions, "query_id", "question", query_side=True), 24)
    picks = R.mmr(pool.join(vectors.select(F.col("id").alias("chunk_id"), "vector"), "chunk_id"), 6)
    fused = kept(R.rrf([picks.withColumnRenamed("pick", "rank"), ranked_bm25(spark, sf_dir, 18)]))
    scored = R.blend(fused, chunks, questions)
    return R.top_k(scored, 6, places=4).select("query_id", "chunk_id", "score", "coverage", "rank_0", "rank_1", "rank")


SQL_SYNONYMS = ", ".join(f"('{term}', '{w}')" for term, others in L.SYNONYMS.items() for o in others for w in o.split())
SQL_PARTS = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda u: trim(u, ' ')), lambda u: length(u) >= 24)"
sql_codes = f"list_distinct(regexp_extract_all(lower(%s), '{L.ENTITY_CODE}'))".__mod__
SQL_RERANKED = f"""pool AS MATERIALIZED (SELECT query_id, chunk_id, rank AS fusion_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b) WHERE rank <= 10),
    said AS MATERIALIZED (SELECT doc_id AS chunk_id, text, source FROM documents WHERE doc_id IN (SELECT chunk_id FROM pool)),
    qt AS (SELECT item_id AS query_id, unnest({SQL_TERMS}) AS term FROM benchmark),
    sy AS (SELECT query_id, term, {sql_stem('w')} AS stem FROM qt JOIN (VALUES {SQL_SYNONYMS}) v(term, w) USING (term)),
    ask AS (SELECT DISTINCT query_id, stem, true AS own FROM qs UNION ALL SELECT query_id, stem, false FROM (SELECT query_id, stem FROM sy EXCEPT SELECT query_id, stem FROM qs)),
    worth AS MATERIALIZED (SELECT query_id, stem, own, CASE WHEN own THEN coalesce(ln((n - df + 0.5) / (df + 0.5) + 1), 1.5) ELSE 0.5 * coalesce(ln((n - df + 0.5) / (df + 0.5) + 1), 1.2) END AS w FROM ask LEFT JOIN df ON term = stem, st),
    focus AS (SELECT query_id, sum(w) AS total, arg_max(stem, struct_pack(w := w, s := stem)) AS stem FROM worth WHERE own GROUP BY 1),
    near AS (SELECT query_id, stem FROM focus UNION SELECT y.query_id, y.stem FROM sy y JOIN focus f ON f.query_id = y.query_id AND f.stem = {sql_stem('y.term')}),
    qw AS (SELECT item_id AS query_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), ' ') AS w, {sql_codes('text')} AS asked, regexp_matches(text, '(?i){L.QUANT_QUERY}') AS measurable FROM benchmark),
    qr AS (SELECT *, list_filter(list_concat(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))), lambda r: regexp_matches(r, '[^ ]{{4}}|(^| )[0-9]+( |$)')) AS runs,
        list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS twos FROM qw),
    un AS MATERIALIZED (SELECT chunk_id, unnest(s) AS text, generate_subscripts(s, 1) AS no FROM (SELECT chunk_id, CASE WHEN len({SQL_PARTS}) > 0 THEN {SQL_PARTS} ELSE [trim(text, ' ')] END AS s FROM said)),
    us AS (SELECT chunk_id, no, unnest({SQL_HELD}) AS stem FROM un),
    hit AS (SELECT query_id, chunk_id, no, sum(w) AS w FROM pool JOIN us USING (chunk_id) JOIN worth USING (query_id, stem) GROUP BY ALL HAVING bool_or((query_id, stem) IN (SELECT query_id, stem FROM near))),
    se AS (SELECT query_id, chunk_id, no, regexp_matches(un.text, '(?i){L.QUANT_EVIDENCE}') AS measured, round(least(1.0, hit.w / total + CASE WHEN list_has_any({sql_codes('un.text')}, asked) THEN 0.12 ELSE 0 END + CASE WHEN measurable AND measured THEN 0.10 ELSE 0 END), 9) AS v
        FROM hit JOIN un USING (chunk_id, no) JOIN focus USING (query_id) JOIN qr USING (query_id)),
    best AS (SELECT query_id, chunk_id, max(v) AS sentence, arg_max(measured, struct_pack(v := v, o := -no)) AS measured FROM se GROUP BY ALL),
    ps AS (SELECT chunk_id, unnest(s) AS stem, generate_subscripts(s, 1) AS pos FROM (SELECT chunk_id, list_transform({SQL_WORDS}, lambda t: {sql_stem('t')}) AS s FROM said)),
    px AS (SELECT query_id, chunk_id, CASE WHEN count(*) > 1 THEN count(*) / (max(pos) - min(pos) + 1) ELSE 0.35 END AS proximity FROM pool JOIN ps USING (chunk_id) JOIN worth USING (query_id, stem) GROUP BY ALL),
    cv AS (SELECT query_id, chunk_id, least(1.0, sum(w) / any_value(total)) AS idf_cov FROM pool JOIN hs USING (chunk_id) JOIN worth USING (query_id, stem) JOIN (SELECT query_id, total FROM focus) USING (query_id) GROUP BY ALL),
    pf AS (SELECT query_id, chunk_id, fusion_rank, lower(text || ' ' || source) AS body, ' ' || regexp_replace(body, '\\s+', ' ', 'g') || ' ' AS flat, list_concat({sql_codes('text')}, {sql_codes("replace(source, '_', ' ')")}) AS codes,
            CASE WHEN len(runs) > 0 THEN len(list_filter(runs, lambda r: contains(body, r))) / len(runs) ELSE 0 END AS phrase,
            CASE WHEN len(twos) > 0 THEN len(list_filter(twos, lambda t: contains(flat, ' ' || t || ' '))) / len(twos) ELSE 0 END AS bigram,
            CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, codes)) / len(asked) ELSE 0.5 END AS code, measurable FROM pool JOIN said USING (chunk_id) JOIN qr USING (query_id)),
    al AS (SELECT query_id, chunk_id, fusion_rank, phrase, bigram, code, coalesce(sentence, 0) AS sentence, coalesce(proximity, 0) AS proximity, coalesce(idf_cov, 0) AS idf_cov, CASE WHEN measurable AND measured THEN 0.06 ELSE 0 END AS more
        FROM pf LEFT JOIN best USING (query_id, chunk_id) LEFT JOIN px USING (query_id, chunk_id) LEFT JOIN cv USING (query_id, chunk_id)),
    rs AS (SELECT *, round_even(least(1.0, {' + '.join(f'{v} * {k}' for k, v in R.BLEND.items())} + more), 4) AS rerank_score FROM al),
    rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fusion_rank) AS rank FROM rs)"""


@query(
    f"""WITH {SQL_FUSED}, {SQL_BLENDED}, {SQL_RERANKED}
    SELECT query_id, chunk_id, fusion_rank, rank, {', '.join(f'round_even({k}, 4) AS {k}' for k in R.BLEND)}, rerank_score FROM rr"""
)
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, questions = chunks_of(spark, sf_dir), questions_of(spark, sf_dir)
    lists = lists_of(spark, sf_dir)
    fused = fused_of(spark, sf_dir, lists)
    found = found_of(spark, sf_dir, fused)
    pool = R.top_k(R.blend(fused, found, questions), 10, places=4).withColumnRenamed("rank", "fusion_rank")
    pairs = kept(pool.select("query_id", "chunk_id", "fusion_rank").join(found, "chunk_id").join(questions, "query_id"))
    idf = kept(R.idf_table(chunks, R.asked_stems(questions), lists))
    scored = R.reranked(R.rerank_features(pairs, questions, idf))
    return scored.select("query_id", "chunk_id", "fusion_rank", "rank", "phrase", "sentence", "proximity", "idf_cov", "bigram", "code", "rerank_score")


SQL_RANKED = f"{SQL_BM25}, r AS (SELECT query_id, chunk_id, rank, source AS doc, lang AS page, text FROM bm25 JOIN documents ON doc_id = chunk_id WHERE rank <= 20)"


def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), F.col("lang").alias("page"), "text")
    return ranked_bm25(spark, sf_dir).join(docs, "chunk_id")


@query(f"WITH {SQL_RANKED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY rank) AS d FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pick FROM k WHERE d <= 1) SELECT query_id, chunk_id, doc, rank, pick FROM p WHERE pick <= 6")
def context_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.per_doc_quota(ranked_pages(spark, sf_dir), 6, 1).select("query_id", "chunk_id", "doc", "rank", "pick")


@query(f"WITH {SQL_RANKED} SELECT query_id, chunk_id, doc, page, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc, page ORDER BY rank) AS d FROM r WHERE rank <= 4) WHERE d = 1")
def citations_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.citations(ranked_pages(spark, sf_dir)).select("query_id", "chunk_id", "doc", "page", "rank")


@query(f"WITH {SQL_RANKED} SELECT query_id, chunk_id, rank, length(left(text, 1500)) AS length FROM (SELECT *, row_number() OVER (PARTITION BY query_id, left(text, 120) ORDER BY rank) AS d FROM r) WHERE d = 1")
def context_prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_of_prefix(ranked_pages(spark, sf_dir)).select("query_id", "chunk_id", "rank", F.length("text").alias("length"))


@query(
    f"""WITH {SQL_BM25}, {SQL_COVER}, l AS (SELECT query_id, 0 AS sub_no, chunk_id, rank FROM bm25 WHERE rank <= 5 UNION ALL SELECT query_id, 1, chunk_id, rank FROM covered WHERE rank <= 5),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub_no ORDER BY rank) AS turn FROM l),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY turn, sub_no) AS d FROM t) WHERE d = 1)
    SELECT query_id, sub_no, chunk_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, sub_no) AS pick FROM f) WHERE pick <= 6"""
)
def round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, questions, held = chunks_of(spark, sf_dir), questions_of(spark, sf_dir), lists_of(spark, sf_dir)
    by_cover = R.coverage_top(chunks, questions, 5, held)
    lists = R.bm25_top(chunks, questions, 5, lists=held).select("query_id", F.lit(0).alias("sub_no"), "chunk_id", "rank").union(by_cover.select("query_id", F.lit(1).alias("sub_no"), "chunk_id", "rank"))
    return R.interleave(lists, 6).select("query_id", "sub_no", "chunk_id", "pick")


@query("SELECT doc_id, lag(doc_id) OVER w AS before, lead(doc_id) OVER w AS after FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def source_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.neighbours(table(spark, sf_dir, "documents").select("source", "doc_id")).select("doc_id", "before", "after")
