"""Queries on texts: cleaning, tokens, chunks, hashes, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import chunking, ranking
from .catalog import query, table

STOP = L.sql_list(L.STOPWORDS)
SQL_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
SQL_TOKENS = f"list_filter({SQL_WORDS}, lambda t: t NOT IN {STOP})"
SQL_SIZE = "greatest(1, CAST(round_even((CASE WHEN trim(regexp_replace({0}, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' ')) END) * 1.3, 0) AS INTEGER))"
SQL_UNITS = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n{2,}', chr(1), 'g'), chr(1)), lambda u: trim(u, ' ')), lambda u: length(u) > 0)"


def sql_stem(x: str, suffixes=L.SUFFIXES, least: int = 4) -> str:
    cases = " ".join(f"WHEN ends_with({x}, '{s.replace(chr(39), chr(39) * 2)}') AND length({x}) - {len(s)} >= {least} THEN left({x}, length({x}) - {len(s)})" for s in suffixes)
    return f"(CASE {cases} ELSE {x} END)"


SQL_STOPPED_STEMS = f"list_distinct(list_transform({SQL_TOKENS}, lambda t: {sql_stem('t')}))"


@query(f"SELECT doc_id, len({SQL_WORDS}) AS n_words, len({SQL_TOKENS}) AS n_tokens, len(list_distinct({SQL_TOKENS})) AS n_distinct FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("w"), X.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("w").alias("n_words"), F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"SELECT doc_id, {SQL_SIZE.format('text')} AS approx_tokens FROM documents")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.approx_tokens(F.col("text")).alias("approx_tokens"))


@query(f"SELECT DISTINCT unnest({SQL_TOKENS}) AS term FROM (SELECT text || ' ' || source AS text FROM documents)")
def corpus_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(X.tokens(F.concat_ws(" ", "text", "source"))).alias("term")).distinct()


@query("SELECT source AS doc, count(*) AS chunks, count(DISTINCT lang) AS pages, CAST(sum(CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_extract_all(text, '[^ \\n\\t\\r]+')) END) AS BIGINT) AS words, count(*) FILTER (WHERE text LIKE '%|%') AS tables FROM documents GROUP BY source")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", F.size(F.regexp_extract_all("text", F.lit("[^ \\n\\t\\r]+"), F.lit(0))).alias("w"), F.col("text").contains("|").alias("bar"))
    return docs.groupBy(F.col("source").alias("doc")).agg(F.count("*").alias("chunks"), F.count_distinct("lang").alias("pages"), F.sum("w").alias("words"), F.count_if("bar").alias("tables"))


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS docs, count(DISTINCT lang) AS langs, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("docs"), F.count_distinct("lang").alias("langs"), F.sum(F.length("text")).alias("characters"))


@query("SELECT doc_id, length(t) AS length, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents)")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.clean_page(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").alias("length"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, generate_subscripts(u, 1) - 1 AS pos, md5(unnest(u)) AS digest, length(unnest(u)) AS length FROM (SELECT doc_id, {SQL_UNITS} AS u FROM documents)")
def chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.units(F.col("text"))).alias("pos", "u"))
    return docs.select("doc_id", "pos", F.md5(F.col("u").cast("binary")).alias("digest"), F.length("u").alias("length"))


@query(
    f"""WITH RECURSIVE u AS (SELECT doc_id, {SQL_UNITS} AS us FROM documents),
    s AS (SELECT doc_id, us, list_transform(us, lambda x: {SQL_SIZE.format('x')}) AS ns FROM u),
    f AS (
        SELECT doc_id, us, ns, 0 AS i, 0 AS size, 0 AS fresh, 0 AS start, CAST(NULL AS INTEGER) AS out_size, CAST(NULL AS INTEGER) AS out_from, 0 AS done FROM s
        UNION ALL
        SELECT doc_id, us, ns, i + 1,
            CASE WHEN i >= len(us) THEN 0 WHEN size + ns[i + 1] >= 380 THEN ns[i + 1] ELSE size + ns[i + 1] END,
            CASE WHEN i >= len(us) THEN 0 WHEN size + ns[i + 1] >= 380 THEN 0 ELSE fresh + 1 END,
            CASE WHEN i < len(us) AND size + ns[i + 1] >= 380 THEN i ELSE start END,
            CASE WHEN i >= len(us) THEN (CASE WHEN fresh > 0 THEN size END) WHEN size + ns[i + 1] >= 380 THEN size + ns[i + 1] END,
            start, CASE WHEN i >= len(us) THEN 1 ELSE 0 END
        FROM f WHERE done = 0)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, out_size AS token_count, md5(array_to_string(us[out_from + 1 : least(i, len(us))], chr(10))) AS digest FROM f WHERE out_size IS NOT NULL"""
)
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.chunk_documents(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "chunk_no", "token_count", F.md5(F.col("text").cast("binary")).alias("digest"))


SQL_PIECES = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y, ' ' || chr(9) || chr(10) || chr(13))), lambda y: y <> '')"
SQL_CUT = f"CASE WHEN length({{0}}) < 90 THEN [{{0}}] ELSE {SQL_PIECES} END"


@query(
    f"""WITH RECURSIVE b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+|\\n{{2,}}', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y, ' ' || chr(9) || chr(10) || chr(13))), lambda y: y <> '') AS bs FROM documents),
    l AS (SELECT doc_id, flatten(list_transform(bs, lambda x: CASE WHEN contains(x, chr(10)) AND regexp_matches(x, '(^|\\n)\\s*[|]') THEN flatten(list_transform(list_filter(list_transform(string_split(x, chr(10)), lambda z: trim(z, ' ' || chr(9) || chr(13))), lambda z: z <> ''), lambda z: CASE WHEN starts_with(z, '|') THEN [z] ELSE {SQL_CUT.format('z')} END)) ELSE {SQL_CUT.format('x')} END)) AS us FROM b),
    s AS (SELECT doc_id, us, list_transform(us, lambda x: {SQL_SIZE.format('x')}) AS ns, list_transform(us, lambda x, i: starts_with(x, '|') AND starts_with(coalesce(us[i + 1], ''), '|')) AS tab FROM l),
    f AS (
        SELECT doc_id, us, ns, tab, 0 AS i, 0 AS size, 1 AS start, CAST(NULL AS INTEGER) AS upto, 1 AS since, false AS tail FROM s
        UNION ALL
        SELECT doc_id, us, ns, tab, i + 1, CASE WHEN ends THEN ns[i + 1] ELSE size + ns[i + 1] END, CASE WHEN ends THEN i + 1 ELSE start END, CASE WHEN ends OR i >= len(us) THEN least(i + 1, len(us)) END, start, i >= len(us)
        FROM (SELECT *, i < len(us) AND size + ns[i + 1] >= 380 AND (size + ns[i + 1] >= 760 OR NOT tab[i + 1]) AS ends FROM f WHERE NOT tail)),
    c AS (SELECT doc_id, i, tail, array_to_string(us[since : upto], chr(10)) AS body FROM f WHERE upto IS NOT NULL AND len(us) > 0),
    z AS (SELECT *, tail AND {SQL_SIZE.format('body')} < 60 AND count(*) OVER (PARTITION BY doc_id) > 1 AS joins FROM c),
    j AS (SELECT doc_id, i, joins, CASE WHEN lead(joins) OVER (PARTITION BY doc_id ORDER BY i, tail) THEN body || chr(10) || lead(body) OVER (PARTITION BY doc_id ORDER BY i, tail) ELSE body END AS body FROM z)
    SELECT doc_id AS doc, 1 AS page, '' AS section, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, CAST({SQL_SIZE.format('body')} AS INTEGER) AS token_count, md5(body) AS digest FROM j WHERE NOT joins"""
)
def chunk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.array("text").alias("pages"))
    return chunking.chunk_pages(pages).select("doc", "page", "section", "chunk_no", "token_count", F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk_no", F.length("text").alias("length"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 79) || '…' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text"), 80).alias("preview"))


SQL_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda x: ord(x)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query(f"SELECT term, {SQL_FNV.format('term')} AS hash, {SQL_FNV.format('term')} % 384 AS slot FROM (SELECT DISTINCT unnest({SQL_TOKENS}) AS term FROM documents)")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", X.fnv1a(F.col("term")).alias("hash")).withColumn("slot", F.col("hash") % 384)


@query(
    f"""WITH c AS (SELECT item_id, CASE WHEN len({SQL_TOKENS}) > 0 THEN {SQL_TOKENS} WHEN len({SQL_WORDS}) > 0 THEN {SQL_WORDS} ELSE ['<empty>'] END AS t FROM benchmark),
    j AS (SELECT item_id, t, array_to_string(t, ' ') AS s FROM c),
    f AS (SELECT item_id, unnest(t) AS feature, 1.25 AS w FROM j
        UNION ALL SELECT item_id, t[i] || '_' || t[i + 1], 0.6 FROM (SELECT item_id, t, unnest(range(1, len(t))) AS i FROM j)
        UNION ALL SELECT item_id, '#' || substr(s, i, 3), 0.35 FROM (SELECT item_id, s, unnest(range(1, length(s) - 1)) AS i FROM j)),
    h AS (SELECT item_id, {SQL_FNV.format('feature')} AS h, w FROM f),
    v AS (SELECT item_id, h % 384 AS slot, sum(CASE WHEN (h >> 31) & 1 = 0 THEN w ELSE -w END) AS v FROM h GROUP BY ALL)
    SELECT * FROM (SELECT item_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS value FROM v) WHERE value <> 0"""
)
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed feature hashing of benchmark questions, one row a slot that is hit."""
    vectors = ranking.hash_vectors(table(spark, sf_dir, "benchmark"), "item_id", "text", query_side=True)
    return vectors.select(F.col("id").alias("item_id"), F.posexplode("vector").alias("slot", "value")).select("item_id", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value")).where("value <> 0")


@query(f"SELECT {sql_stem('term')} AS stem, count(*) AS terms FROM (SELECT DISTINCT unnest({SQL_TOKENS}) AS term FROM documents) GROUP BY 1")
def stem_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    return terms.groupBy(X.stem(F.col("term")).alias("stem")).agg(F.count("*").alias("terms"))


@query(f"SELECT {sql_stem('term', L.JUDGE_SUFFIXES, 3)} AS stem, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]+|[0-9]+(?:\\.[0-9]+)?')) AS term FROM documents) GROUP BY 1")
def judge_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z'-]+|[0-9]+(?:\\.[0-9]+)?"), F.lit(0))).alias("term"))
    return found.groupBy(X.judge_stem(F.col("term")).alias("stem")).agg(F.count("*").alias("n"))


SQL_TERMS = f"list_distinct(list_filter({SQL_TOKENS}, lambda t: (length(t) > 2 OR regexp_full_match(t, '[0-9]+')) AND t NOT IN {L.sql_list(L.FILLER)}))"


@query(f"SELECT item_id, array_to_string(list_sort({SQL_TERMS}), ' ') AS terms, len({SQL_TERMS}) AS n FROM benchmark")
def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", X.content_terms(F.col("text")).alias("t"))
    return items.select("item_id", F.array_join(F.array_sort("t"), " ").alias("terms"), F.size("t").alias("n"))


@query(
    """WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda u: trim(u, ' ')), lambda u: length(u) >= 24) AS ws FROM documents),
    w AS (SELECT doc_id, CASE WHEN len(ws) > 0 THEN ws WHEN trim(text, ' ') <> '' THEN [trim(text, ' ')] ELSE [] END AS ws FROM p)
    SELECT doc_id, len(ws) AS n, coalesce(CAST(list_sum(list_transform(ws, lambda u: length(u))) AS BIGINT), 0) AS characters FROM w"""
)
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.sentence_windows(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").alias("n"), F.aggregate("w", F.lit(0).cast("long"), lambda s, u: s + F.length(u)).alias("characters"))


@query(f"SELECT doc_id, round(max(r), 6) AS top, round(avg(r), 6) AS mean FROM (SELECT doc_id, len(list_filter(ws, lambda t: regexp_full_match(t, '[-±+]*[0-9,.%]*[0-9][0-9,.%]*'))) / len(ws) AS r FROM (SELECT doc_id, regexp_extract_all(unnest({SQL_UNITS}), '[^ \\n\\t\\r]+') AS ws FROM documents) WHERE len(ws) > 0) GROUP BY doc_id")
def digit_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.units(F.col("text"))).alias("u")).select("doc_id", F.regexp_extract_all("u", F.lit("[^ \\n\\t\\r]+"), F.lit(0)).alias("ws")).where(F.size("ws") > 0)
    numeric = F.size(F.filter("ws", lambda t: t.rlike("^[-±+]*[0-9,.%]*[0-9][0-9,.%]*$")))
    return parts.groupBy("doc_id").agg(F.round(F.max(numeric / F.size("ws")), 6).alias("top"), F.round(F.avg(numeric / F.size("ws")), 6).alias("mean"))


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '[^ \\n\\t\\r]+|[ \\n\\t\\r]+')) AS tokens, len(regexp_extract_all(text, '[^ \\n\\t\\r]+')) AS words FROM conversations")
def spaced_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", count("[^ \\n\\t\\r]+|[ \\n\\t\\r]+").alias("tokens"), count("[^ \\n\\t\\r]+").alias("words"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 90")


@query("SELECT event_id, CAST(json_extract_string(regexp_extract(raw, '(?s)[{].*[}]'), '$.k') AS BIGINT) AS k FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' ELSE 'Sure: ' || props || ' as asked' END AS raw FROM events)")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects out of fenced or chatty answers: the text itself if it parses, or else its outermost braces."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Sure: "), "props", F.lit(" as asked")))
    answers = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    parsed = F.coalesce(F.try_parse_json("raw"), F.try_parse_json(F.regexp_extract("raw", "(?s)\\{.*\\}", 0)))
    return answers.select("event_id", F.try_variant_get(parsed, "$.k", "bigint").alias("k"))
