"""Queries on decisions and answers: benchmark items and conversation turns are the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import answering as A
from .catalog import query, table
from .rank_jobs import SQL_BM25, questions_of, ranked_bm25
from .text_jobs import SQL_STOPPED_STEMS, SQL_TERMS, SQL_TOKENS, corpus_vocabulary, sql_stem

SQL_SOCIAL = " OR ".join(f"regexp_matches(q, '{p.replace(chr(39), chr(39) * 2)}')" for p in L.CHITCHAT)
SQL_HINT = " OR ".join(f"contains(q, '{h}')" for h in L.WORLD_HINTS)


@query(
    f"""WITH vocab AS (SELECT DISTINCT unnest({SQL_TOKENS}) AS term FROM (SELECT text || ' ' || source AS text FROM documents)),
    q AS (SELECT conv_id * 1000 + turn AS query_id, lower(trim(text, ' ')) AS q, {SQL_TERMS} AS terms FROM conversations WHERE role = 'user'),
    k AS (SELECT query_id, count(*) AS known FROM (SELECT query_id, unnest(terms) AS term FROM q) JOIN vocab USING (term) GROUP BY query_id),
    s AS (SELECT q.*, coalesce(known, 0) / len(terms) AS share, ({SQL_SOCIAL}) AS social, ({SQL_HINT}) AS hint FROM q LEFT JOIN k USING (query_id))
    SELECT query_id, CASE WHEN social OR length(q) < 4 THEN 'chitchat' WHEN len(terms) = 0 THEN 'out_of_scope' WHEN (hint AND share < 0.34) OR (NOT hint AND share < 0.17) THEN 'out_of_scope' ELSE 'document' END AS route,
    CASE WHEN social THEN 0.95 WHEN length(q) < 4 THEN 0.8 WHEN len(terms) = 0 THEN 0.3 ELSE round(share, 2) END AS confidence FROM s"""
)
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    return A.route(turns, corpus_vocabulary(spark, sf_dir))


@query(
    """SELECT doc_id AS query_id, unnest([0, 1]) AS sub_no, lang || ' delivery ' || unnest(['x' || (100 + doc_id % 3)::VARCHAR, 'S' || (200 + doc_id % 2)::VARCHAR]) AS sub_query FROM documents WHERE doc_id % 4 > 0 AND length(lang) > 2
    UNION ALL SELECT doc_id, unnest([0, 1]), 'delivery ' || unnest(['x' || (100 + doc_id % 3)::VARCHAR, 'S' || (200 + doc_id % 2)::VARCHAR]) FROM documents WHERE doc_id % 4 > 0 AND length(lang) <= 2"""
)
def decompose_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparing questions made from the documents' ids; one in four asks about one code only."""
    code = lambda p, base, n: F.concat(F.lit(p), (F.lit(base) + F.col("doc_id") % n).cast("string"))
    two = F.concat(F.lit("Compare the "), "lang", F.lit(" delivery of the "), code("x", 100, 3), F.lit(" and the "), code("S", 200, 2), F.lit(" vs. the "), code("X", 100, 3))
    one = F.concat(F.lit("Compare delivery of the "), code("x", 100, 3))
    questions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 4 > 0, two).otherwise(one).alias("question"))
    return A.decompose(questions)


SQL_SYNONYMS = ", ".join("('" + k + "', [" + ", ".join(f"'{v}'" for v in vs) + "])" for k, vs in L.SYNONYMS.items())


@query(
    f"""WITH syn(term, words) AS (VALUES {SQL_SYNONYMS}), q AS (SELECT query_id, list_sort({SQL_TERMS}) AS terms FROM (SELECT event_id AS query_id, lower(event_type) || ' ' || ['error', 'warranty', 'long', 'plain', 'fix'][1 + event_id % 5] || ' the sensor' AS text FROM events)),
    e AS (SELECT query_id, terms, list_filter(list_concat(coalesce((SELECT words FROM syn WHERE term = terms[1]), []), coalesce((SELECT words FROM syn WHERE term = terms[2]), []), coalesce((SELECT words FROM syn WHERE term = terms[3]), [])), lambda w: NOT list_contains(terms, w)) AS more FROM q),
    d AS (SELECT query_id, terms, list_filter(more, lambda w, i: list_position(more, w) = i) AS more FROM e)
    SELECT query_id, trim(array_to_string(terms, ' ') || ' ' || array_to_string(more[1:6], ' ')) AS rewritten FROM d"""
)
def rewrite_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in ("error", "warranty", "long", "plain", "fix")]), (F.col("event_id") % 5 + 1).cast("int"))
    return A.rewrite(table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.concat_ws(" ", F.lower("event_type"), word, F.lit("the sensor")).alias("question")))


def contexts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), F.col("lang").alias("page"), "text")
    return ranked_bm25(spark, sf_dir, 6).select("query_id", "chunk_id", "rank").join(docs, "chunk_id")


SQL_OWN = f"own AS (SELECT item_id AS query_id, list_distinct(list_transform({SQL_TERMS}, lambda t: {sql_stem('t')})) AS own FROM benchmark)"
SQL_GRADED = f"""{SQL_BM25}, {SQL_OWN},
    graded AS (SELECT query_id, chunk_id, rank, CASE WHEN len(own) = 0 THEN 0 ELSE round(least(1.0, 0.6 * least(1.0, len(list_intersect(own, held)) / len(own)) + 0.4 * least(1.0, 1.0 / rank)), 4) END AS grade
        FROM bm25 JOIN own USING (query_id) JOIN (SELECT doc_id AS chunk_id, {SQL_STOPPED_STEMS} AS held FROM documents) USING (chunk_id) WHERE rank <= 6)"""


def graded_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contexts_of(spark, sf_dir).join(questions_of(spark, sf_dir), "query_id").withColumn("score", 1 / F.col("rank"))
    return A.grade(pairs).select("query_id", "chunk_id", "rank", "grade")


@query(f"WITH {SQL_GRADED} SELECT * FROM graded")
def grade_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded_of(spark, sf_dir)


@query(f"WITH {SQL_GRADED} SELECT query_id, count(*) FILTER (WHERE grade >= 0.35) AS relevant, max(grade) AS best, CASE WHEN count(*) FILTER (WHERE grade >= 0.35) > 0 THEN 'generator' ELSE 'rewriter' END AS step FROM graded GROUP BY query_id")
def grader_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.next_step(graded_of(spark, sf_dir), F.lit(0))


@query()
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.extract_answers(contexts_of(spark, sf_dir), questions_of(spark, sf_dir), units=None)


SQL_ANSWER = "a AS (SELECT item_id AS query_id, text || ' [Source: ' || (item_id % 7)::VARCHAR || '.md, page 2]' AS answer FROM benchmark)"


def said_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' own texts as answers, each with a citation."""
    mark = F.concat(F.lit(" [Source: "), (F.col("item_id") % 7).cast("string"), F.lit(".md, page 2]"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", mark).alias("answer"))


@query(
    f"""WITH {SQL_BM25}, {SQL_ANSWER}, t AS (SELECT query_id, unnest(list_filter({SQL_TERMS}, lambda t: length(t) > 2)) AS term FROM (SELECT query_id, regexp_replace(answer, '\\[Source:[^\\]]*\\]', '', 'g') AS text FROM a)),
    h AS (SELECT DISTINCT query_id, unnest({SQL_STOPPED_STEMS}) AS stem FROM bm25 JOIN documents ON doc_id = chunk_id WHERE rank <= 6),
    s AS (SELECT query_id, count(*) AS n, count(h.stem) AS hits FROM (SELECT query_id, {sql_stem('term')} AS stem FROM t) x LEFT JOIN h USING (query_id, stem) GROUP BY query_id)
    SELECT query_id, CASE WHEN coalesce(n, 0) > 0 AND hits / n >= 0.5 THEN 'supported' ELSE 'not_supported' END AS verdict, coalesce(round(hits / n, 4), 0) AS support FROM a LEFT JOIN s USING (query_id)"""
)
def verify_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.verify(said_of(spark, sf_dir), contexts_of(spark, sf_dir))


SQL_JUDGE = f"list_transform(regexp_extract_all(lower({{0}}), '[a-z][a-z''-]+|[0-9]+(?:[.][0-9]+)?'), lambda w: {sql_stem('w', L.JUDGE_SUFFIXES, 3)})"
SQL_SPOKEN = f"list_filter({SQL_JUDGE}, lambda w: w NOT IN ({', '.join(repr(w) for w in L.JUDGE_STOPWORDS)}))"
SQL_NUMBERS = "list_filter(regexp_extract_all({0}, '[A-Za-z0-9./-]+'), lambda x: regexp_full_match(x, '[0-9]+([.][0-9]+)?'))"


@query(
    f"""WITH {SQL_BM25}, o AS (SELECT query_id, list_distinct(flatten(list({SQL_JUDGE.format('text')}))) AS words, list_distinct(flatten(list({SQL_NUMBERS.format('text')}))) AS numbers FROM bm25 JOIN documents ON doc_id = chunk_id WHERE rank <= 4 GROUP BY query_id),
    a AS (SELECT item_id AS query_id, trim(text, ' ') AS answer FROM benchmark),
    p AS (SELECT query_id, answer, list_filter(list_transform(string_split(regexp_replace(regexp_replace(answer, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) >= 12) AS parts FROM a),
    c AS (SELECT query_id, answer, unnest(CASE WHEN len(parts) > 0 THEN parts ELSE [answer] END) AS s FROM p),
    m AS (SELECT query_id, answer, {SQL_SPOKEN.format('s')} AS ws, {SQL_NUMBERS.format('s')} AS ns, coalesce(words, []) AS words, coalesce(numbers, []) AS numbers FROM c LEFT JOIN o USING (query_id)),
    k AS (SELECT query_id, answer, len(ws) > 0 AS spoken, len(list_filter(ns, lambda n: NOT list_contains(numbers, n))) = 0 AS fits, len(list_filter(ws, lambda w: list_contains(words, w))) / len(ws) AS share FROM m),
    g AS (SELECT query_id, count(*) AS claims, count(*) FILTER (WHERE spoken AND fits AND share >= 0.62) AS supported, count(*) FILTER (WHERE spoken AND NOT fits) AS contradictions FROM k GROUP BY query_id),
    w AS (SELECT query_id, answer, {SQL_SPOKEN.format('answer')} AS ws, coalesce(words, []) AS words FROM a LEFT JOIN o USING (query_id))
    SELECT query_id, CASE WHEN answer = '' THEN 1.0 ELSE round(greatest(0, least(1, 0.65 * supported / claims + 0.35 * CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: list_contains(words, x))) / len(ws) ELSE 1 END - 0.12 * contradictions)), 3) END AS score, claims, supported, contradictions FROM g JOIN w USING (query_id)"""
)
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.faithfulness(said_of(spark, sf_dir), contexts_of(spark, sf_dir).where("rank <= 4").select("query_id", "text"))


@query("SELECT item_id AS query_id, generate_subscripts(p, 1) - 1 AS seq, array_to_string(unnest(p), ' ') || CASE WHEN generate_subscripts(p, 1) < len(p) THEN ' ' ELSE '' END AS delta FROM (SELECT item_id, [w[i * 4 + 1 : i * 4 + 4] for i in range(CAST(ceil(len(w) / 4) AS BIGINT))] AS p FROM (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM benchmark))")
def answer_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.deltas(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer")))


@query(f"WITH {SQL_ANSWER} SELECT query_id, 0 AS pos, regexp_extract(answer, '\\[Source: ([^,\\]]+), page ([^\\]]+)\\]', 1) AS doc, regexp_extract(answer, '\\[Source: ([^,\\]]+), page ([^\\]]+)\\]', 2) AS page FROM a")
def citation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cited(said_of(spark, sf_dir))


@query()
def suggest_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(A.keywords(F.col("text")), " | ").alias("found"))


@query()
def lcs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the turn after it, however long they are."""
    from pyspark.sql.window import Window

    turns = table(spark, sf_dir, "conversations")
    pairs = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("a"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    return A.word_diff(pairs, most=None).groupBy("pair_id", "side").agg(F.count("*").alias("runs"), F.sum(F.size(F.split("words", " "))).alias("words"))
