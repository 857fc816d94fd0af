"""Decisions and answers for a table of questions: routing, sub-questions, grading, extraction, checks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as X

#: Bits of masks of words that a word diff keeps.
_MASKS = 1 << 28


def route(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, route, confidence): chit-chat by pattern, else by the share of content terms that the corpus knows.

    vocabulary: (term). The terms of all questions meet it in one join.
    """
    q = questions.select("query_id", F.lower(F.trim("question")).alias("q"), X.content_terms(F.col("question")).alias("terms"))
    known = q.select("query_id", F.explode("terms").alias("term")).join(vocabulary.select("term").distinct(), "term").groupBy("query_id").agg(F.count("*").alias("known"))
    rows = q.join(known, "query_id", "left").withColumn("share", F.coalesce("known", F.lit(0)) / F.greatest(F.lit(1), F.size("terms")))
    social = F.lit(False)
    for p in L.CHITCHAT:
        social = social | F.col("q").rlike(p)
    hint = F.lit(False)
    for h in L.WORLD_HINTS:
        hint = hint | F.col("q").contains(h)
    chat, none = F.lit("chitchat"), F.lit("out_of_scope")
    away = (hint & (F.col("share") < 0.34)) | (~hint & (F.col("share") < 0.17))
    where = F.when(social | (F.length("q") < 4), chat).when(F.size("terms") == 0, none).when(away, none).otherwise("document")
    sure = F.when(social, 0.95).when(F.length("q") < 4, 0.8).when(F.size("terms") == 0, 0.3).otherwise(F.round("share", 2))
    return rows.select("query_id", where.alias("route"), sure.alias("confidence"))


def decompose(questions: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, sub_no, sub_query) of comparing questions about two to `most` codes: the topic with each code."""
    low = lambda p: "(?i)" + p
    codes = F.regexp_extract_all("question", F.lit(low(L.PRODUCT_CODE)), F.lit(0))
    first = F.filter(codes, lambda c, i: F.array_position(F.transform(codes, F.lower), F.lower(c)) == i + 1)
    cue = F.col("question").rlike(low(L.COMPARATIVE)) | F.col("question").rlike(low(L.BETWEEN))
    topic = F.col("question")
    for p in (L.BETWEEN, L.PRODUCT_CODE, L.COMPARATIVE, L.TOPIC_GLUE):
        topic = F.regexp_replace(topic, low(p), " ")
    words = F.filter(F.split(topic, "\\s+"), lambda w: F.length(w) > 2)
    words = F.filter(words, lambda w, i: F.array_position(F.transform(words, F.lower), F.lower(w)) == i + 1)
    phrase = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise("specifications")
    rows = questions.select("query_id", first.alias("codes"), phrase.alias("topic"), cue.alias("cue")).where(F.col("cue") & F.size("codes").between(2, most))
    return rows.select("query_id", "topic", F.posexplode("codes").alias("sub_no", "code")).select("query_id", "sub_no", F.concat_ws(" ", "topic", "code").alias("sub_query"))


def rewrite(questions: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, rewritten): sorted content terms and the first `most` synonyms that aren't among them."""
    q = questions.select("query_id", "question", F.array_sort(X.content_terms(F.col("question"))).alias("terms"))
    extra = F.slice(F.array_except(X.synonyms(F.col("terms")), "terms"), 1, most)
    base = F.when(F.size("terms") > 0, F.array_join("terms", " ")).otherwise(F.col("question"))
    return q.select("query_id", F.trim(F.concat_ws(" ", base, F.array_join(extra, " "))).alias("rewritten"))


def grade(pairs: DataFrame) -> DataFrame:
    """Rows (query_id, chunk_id, question, text, score) with a grade: covered stems, synonyms at 0.8, and the score."""
    terms = pairs.select("query_id", "question").distinct().select("query_id", X.content_terms(F.col("question")).alias("terms"))
    stems = terms.select("query_id", F.array_distinct(F.transform("terms", X.stem)).alias("own"), X.synonym_stems(F.col("terms")).alias("others"))
    stems = stems.select("query_id", "own", F.array_except("others", "own").alias("syn"))
    rows = pairs.withColumn("held", X.stems(F.col("text"))).join(stems, "query_id")
    cover = F.least(F.lit(1.0), (F.size(F.array_intersect("own", "held")) + 0.8 * F.size(F.array_intersect("syn", "held"))) / F.size("own"))
    graded = F.when(F.size("own") == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), 0.6 * cover + 0.4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))), 4))
    return rows.withColumn("grade", graded).drop("held", "own", "syn")


def next_step(graded: DataFrame, retries: Column, least: float = 0.35, most: int = 2) -> DataFrame:
    """(query_id, relevant, best, step): on to the generator, another rewrite, or the fallback."""
    by = graded.groupBy("query_id").agg(F.count_if(F.col("grade") >= least).alias("relevant"), F.max("grade").alias("best"))
    return by.withColumn("step", F.when(F.col("relevant") > 0, "generator").when(retries < most, "rewriter").otherwise("fallback"))


def units_of(text: str) -> list[str]:
    """What an answer can quote: sentences of more than 30 characters, and table rows as `cell (header)` lists."""
    out: list[str] = []
    header: list[str] | None = None
    lines = [x.strip() for x in text.split("\n")]
    cells = lambda line: [c.strip() for c in line.strip("|").split("|")]
    is_row = lambda line: line.startswith("|") and line.count("|") > 2
    is_rule = lambda line: is_row(line) and not re.sub(r"[|:\-\s]", "", line)
    for k, line in enumerate(lines):
        if is_row(line):
            if is_rule(line):
                continue
            begins = k == 0 or not is_row(lines[k - 1])
            if begins:
                header = cells(line) if k + 1 < len(lines) and is_rule(lines[k + 1]) else None
                if header is not None:
                    continue
            if header is None:
                shown = [c for c in cells(line) if c]
                out += [" — ".join(shown[:7])] if shown else []
            else:
                shown = [f"{c} ({h})" if h and not re.fullmatch(r"[:\-\s]*", h) else c for h, c in zip(header, cells(line)) if c]
                out += ["; ".join(shown[:7])] if shown else []
        elif line and "```" not in line and not re.fullmatch(r"!\[[^\]]*\]\([^)]*\)", line):
            out += [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", line)) if len(s) > 30 and s.count("|") < 3]
    return out


def answer_units(chunks: DataFrame, most: int | None = 20, with_text: bool = True) -> DataFrame:
    """Rows with a text, exploded into (pos, unit) by units_of(); `most` of each text, all of them where it is None.

    with_text: whether each unit's row holds the whole text again, which grows with the square of long ones.
    """
    columns, at = [c for c in chunks.columns if with_text or c != "text"], chunks.columns.index("text")
    schema = StructType([chunks.schema[c] for c in columns]).add("pos", "integer").add("unit", "string")
    places = [chunks.columns.index(c) for c in columns]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [units_of(t or "")[:most] for t in batch.column(at).to_pylist()]
            row = pa.array([i for i, u in enumerate(found) for _ in u], pa.int64())
            out = [batch.column(k).take(row) for k in places] + [pa.array([k for u in found for k in range(len(u))], pa.int32()), pa.array([x for u in found for x in u], pa.string())]
            yield pa.RecordBatch.from_arrays(out, [*columns, "pos", "unit"])

    return chunks.mapInArrow(cut, schema)


def affirmed_version(text: Column) -> Column:
    """The first version number of a text without a negation in the 70 characters before it or the 30 behind; null if there is none."""
    no = r"(?:must\s{1,3}not|or\s{1,3}earlier|prior\s{1,3}to|older\s{1,3}than|do\s{1,3}not\s{1,3}use|not\s{1,3}be\s{1,3}used|before\s{1,3}v?\d)"
    found = F.regexp_extract(text, rf"(?is)(?<!{no}.{{0,70}})(?<!before\s{{1,3}}){L.VERSION_EVIDENCE}(?!.{{0,30}}{no})", 0)
    return F.when(found != "", found)


def extract_answers(contexts: DataFrame, questions: DataFrame, most: int = 3, units: int | None = 20) -> DataFrame:
    """(query_id, answer) from ranked contexts (query_id, rank, doc, page, text): the best units, one a context, cited.

    units: that many of each context can be quoted, which covers a chunk; None where contexts are whole documents.
    """
    q = questions.select("query_id", "question", X.content_terms(F.col("question")).alias("terms"))
    heavy = F.filter("terms", lambda t: t.rlike("^([0-9]+|[a-z]+[0-9].*)$"))
    q = q.select("query_id", "question", F.array_distinct(F.transform("terms", X.stem)).alias("own"), X.synonym_stems(F.col("terms")).alias("others"), F.array_distinct(F.transform(heavy, X.stem)).alias("heavy"), (F.size("terms") + F.size(heavy)).alias("whole"))
    q = q.withColumns({"syn": F.array_except("others", "own"), "codes": F.regexp_extract_all(F.lower("question"), F.lit(L.ENTITY_CODE), F.lit(0)), "quant": F.col("question").rlike("(?i)" + L.QUANT_QUERY), "version": F.col("question").rlike("(?i)" + L.VERSION_QUERY)})
    used = contexts.where(F.col("rank") <= 6)
    told = used.join(q.select("query_id", "version"), "query_id").select("query_id", "rank", "doc", "page", "text", F.when(F.col("version"), affirmed_version(F.col("text"))).alias("affirmed"))
    # Spark takes the units for as small as their contexts and would broadcast them
    rows = answer_units(told, units, with_text=False).join(q.drop("others").hint("merge"), "query_id")
    rows = rows.withColumn("held", F.array_union(X.stems(F.col("unit")), X.stems(F.regexp_replace("doc", "_", " "))))
    hit = F.array_intersect("own", "held")
    got = F.size(hit) + F.size(F.array_intersect(hit, "heavy")) + 0.8 * F.size(F.array_intersect("syn", "held"))
    letters = F.length(F.regexp_replace("unit", "[^\\p{L}]", ""))
    capitals = F.length(F.regexp_replace("unit", "[^\\p{Lu}]", ""))
    items = F.filter(F.split("unit", "\\s+"), lambda w: w != "")
    digits = F.size(F.filter(items, lambda w: w.rlike("^[±+-]*[0-9.,%]*[0-9][0-9.,%]*$"))) / F.greatest(F.lit(1), F.size(items))
    penalty = (
        F.when(F.col("unit").endswith("?"), 0.7).otherwise(1.0)
        * F.when((letters > 0) & (capitals / letters > 0.6), 0.85).otherwise(1.0)
        * F.when(F.col("unit").startswith("#"), 0.5).otherwise(1.0)
        * F.when(F.col("unit").rlike("(?i)" + L.OCR_MARKER), 0.45).when(digits > 0.35, 0.7).otherwise(1.0)
    )
    rows = rows.withColumn("cover", F.least(F.lit(1.0), got / F.greatest(F.lit(1), F.col("whole")))).where("cover > 0")
    boost = (
        F.when(F.col("quant") & F.col("unit").rlike("(?i)" + L.QUANT_EVIDENCE), 1.35).otherwise(1.0)
        * F.when(F.arrays_overlap("codes", "held"), 1.5).otherwise(1.0)
        * F.when(F.col("version") & F.col("unit").rlike("(?i)" + L.VERSION_EVIDENCE) & ~F.col("unit").rlike("(?i)" + L.VERSION_NEGATION), 1.4).otherwise(1.0)
    )
    scored = rows.withColumn("score", (1.6 * F.col("cover") + 0.5 / F.col("rank") + 0.15 / (1 + F.col("pos"))) * penalty * boost)
    norm = F.substring(F.regexp_replace(F.lower("unit"), "\\W+", ""), 1, 80)
    version = F.when(F.col("version") & ~F.col("unit").rlike("(?i)" + L.VERSION_EVIDENCE), F.col("affirmed"))
    named = F.when(version.isNotNull(), F.concat(version, F.lit(" — "), "unit")).otherwise(F.col("unit"))
    item = F.struct((-F.round("score", 9)).alias("order"), "rank", "pos", norm.alias("norm"), F.concat(named, F.lit(" [Source: "), "doc", F.lit(", page "), F.col("page").cast("string"), F.lit("]")).alias("said"))
    listed = scored.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("score").alias("top"))  # of 6 contexts
    first = F.slice("items", 1, 0)
    pick = lambda s, x: F.when((F.size(s) < most) & ~F.exists(s, lambda y: (y["rank"] == x["rank"]) | (y["norm"] == x["norm"])), F.concat(s, F.array(x))).otherwise(s)
    chosen = listed.where("top >= 0.6").select("query_id", F.array_join(F.transform(F.aggregate("items", first, pick), lambda x: x["said"]), " ").alias("answer"))
    best = used.where("rank = 1").select("query_id", F.concat(F.trim(F.substring("text", 1, 280)), F.lit(" [Source: "), "doc", F.lit(", page "), F.col("page").cast("string"), F.lit("]")).alias("snippet"))
    none = F.lit("I couldn't find this in the provided documents. No passage in the indexed corpus appears relevant to this question.")
    return questions.select("query_id").join(best, "query_id", "left").join(chosen, "query_id", "left").select("query_id", F.coalesce("answer", "snippet", none).alias("answer"))


def compare_answers(contexts: DataFrame, subs: DataFrame, most: int = 2, least: int = 40, units: int | None = 20) -> DataFrame:
    """(query_id, answer): a block for each sub-query (query_id, sub_no, sub_query), of its own contexts (query_id, sub_no, rank, doc, page, text).

    A sub-query without a usable unit gets an honest line of its own. units: as in extract_answers(), None where contexts are whole documents.
    """
    key = F.concat_ws("#", F.col("query_id").cast("string"), F.col("sub_no").cast("string"))
    own = subs.select(key.alias("query_id"), F.col("sub_query").alias("question"))
    code = F.lower(F.element_at(F.split("sub_query", " "), -1))
    named = contexts.join(subs, ["query_id", "sub_no"]).withColumn("first", F.contains(F.lower("doc"), code).cast("int"))
    ordered = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "sub_no").orderBy(F.desc("first"), "rank")))
    parts = extract_answers(ordered.select(key.alias("query_id"), "rank", "doc", "page", "text"), own, most, units).withColumnRenamed("query_id", "key")
    rows = subs.withColumn("key", key).join(parts, "key", "left")
    good = F.length(F.regexp_replace("answer", L.SOURCE_TAG, "")) >= least
    line = F.concat("sub_query", F.lit(": "), F.when(good & ~F.col("answer").startswith("I couldn't find"), F.col("answer")).otherwise(F.lit("no passage of the documents covers this.")))
    lines = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("sub_no", line.alias("line")))).alias("lines"))
    return lines.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("answer"))


def small_talk(question: Column) -> Column:
    """A reply to chit-chat: to thanks, to a question about what the service does, or to a greeting."""
    low = F.lower(question)
    return (
        F.when(low.rlike("thank|cheers|great|awesome|nice"), "You're welcome. Is there anything else in the documents that I can look up?")
        .when(low.rlike("who are you|what can you do|introduce"), "I answer questions from the indexed documents and cite the passages that I use.")
        .otherwise("Hello! Ask me about the indexed documents.")
    )


def verify(answers: DataFrame, contexts: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, verdict, support): the share of an answer's content terms whose stems its contexts hold."""
    plain = F.regexp_replace("answer", "\\[Source:[^\\]]*\\]", "")
    terms = answers.select("query_id", F.explode_outer(F.filter(X.content_terms(plain), lambda t: F.length(t) > 2)).alias("term"))
    held = contexts.select("query_id", F.explode(X.stems(F.col("text"))).alias("stem")).distinct().withColumn("in", F.lit(1))
    rows = terms.withColumn("stem", X.stem(F.col("term"))).join(held, ["query_id", "stem"], "left")
    by = rows.groupBy("query_id").agg(F.count("term").alias("n"), F.sum(F.when(F.col("term").isNotNull(), F.coalesce("in", F.lit(0)))).alias("hits"))
    support = F.when(F.col("n") > 0, F.round(F.col("hits") / F.col("n"), 4)).otherwise(0.0)
    return by.select("query_id", F.when((F.col("n") > 0) & (F.col("hits") / F.col("n") >= least), "supported").otherwise("not_supported").alias("verdict"), support.alias("support"))


def _judge_words(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z'-]+|[0-9]+(?:\\.[0-9]+)?"), F.lit(0))
    return F.transform(found, X.judge_stem)


def faithfulness(answers: DataFrame, sources: DataFrame, least: float = 0.62) -> DataFrame:
    """(query_id, score, claims, supported, contradictions): sentences whose words and numbers the sources hold.

    answers: (query_id, answer); sources: (query_id, text), any number a query.
    """
    numbers = lambda c: F.regexp_extract_all(c, F.lit(L.NUMBER_ALONE), F.lit(0))
    own = sources.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array_distinct(_judge_words(F.col("text")))))).alias("words"), F.array_distinct(F.flatten(F.collect_list(numbers(F.col("text"))))).alias("numbers"))
    plain = F.trim(F.regexp_replace("answer", "(?i)" + L.SOURCE_TAG, " "))
    rows = answers.select("query_id", plain.alias("answer")).join(own, "query_id", "left")
    rows = rows.withColumns({"words": F.coalesce("words", F.array().cast("array<string>")), "numbers": F.coalesce("numbers", F.array().cast("array<string>"))})
    parts = F.filter(F.transform(F.split("answer", "(?<=[.!?;])\\s+|\\n+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 12)
    rows = rows.withColumn("parts", F.when(F.size(parts) > 0, parts).otherwise(F.array("answer")))
    content = lambda c: F.filter(_judge_words(c), lambda w: ~w.isin(L.JUDGE_STOPWORDS))
    known = lambda ws: F.size(F.filter(ws, lambda w: F.array_contains("words", w)))

    def check(s: Column) -> Column:
        ws = content(s)
        right = F.size(F.array_except(numbers(s), F.col("numbers"))) == 0
        spoken = F.size(ws) > 0
        return F.struct((spoken & right & (known(ws) / F.size(ws) >= least)).cast("int").alias("good"), (spoken & ~right).cast("int").alias("wrong"))

    rows = rows.withColumns({"checks": F.transform("parts", check), "all": content(F.col("answer"))})
    add = lambda name: F.aggregate("checks", F.lit(0), lambda a, x: a + x[name])
    rows = rows.select("query_id", "answer", F.size("parts").alias("claims"), add("good").alias("supported"), add("wrong").alias("contradictions"), F.when(F.size("all") > 0, known(F.col("all")) / F.size("all")).otherwise(1.0).alias("grounded"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.65 * F.col("supported") / F.col("claims") + 0.35 * F.col("grounded") - 0.12 * F.col("contradictions")))
    return rows.select("query_id", F.when(F.col("answer") == "", 1.0).otherwise(F.round(score, 3)).alias("score"), "claims", "supported", "contradictions")


def keywords(text: Column, most: int = 3) -> Column:
    """Patterns of facts to look for in an answer, as first_match() takes them: numbers with units, codes and versions, or else tokens with digits.

    Blanks between number and unit, a plural s and the degree sign may be there or not.
    """
    number = F.regexp_extract_all(text, F.lit("(?i)" + L.NUMBER_UNIT), F.lit(1))
    unit = F.regexp_extract_all(text, F.lit("(?i)" + L.NUMBER_UNIT), F.lit(2))
    dots = lambda c: F.replace(c, F.lit("."), F.lit("\\."))
    loose = lambda u: F.regexp_replace(F.regexp_replace(u, "(?i)^(month|year|day|hour|minute|second)s?$", r"$1s?"), "^°", r"°?\\s*")
    numbers = F.zip_with(number, unit, lambda n, u: F.concat(dots(n), F.lit("\\s*"), loose(u)))
    found = F.array_distinct(F.concat(numbers, F.transform(F.regexp_extract_all(text, F.lit(L.CODE_OR_VERSION), F.lit(1)), dots)))
    return F.slice(F.when(F.size(found) > 0, found).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(L.RARE_TOKEN), F.lit(0)))), 1, most)


def deltas(answers: DataFrame, words: int = 4) -> DataFrame:
    """(query_id, seq, delta): an answer in groups of words, as it is sent; all but the last end with a blank."""
    held = answers.select("query_id", F.filter(F.split("answer", " "), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    n = F.ceil(F.size("w") / F.lit(words)).cast("int")
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice("w", (i - 1) * words + 1, F.lit(words)), " "), F.when(i < n, " ").otherwise("")))
    return held.select("query_id", F.posexplode(parts).alias("seq", "delta"))


def cited(answers: DataFrame) -> DataFrame:
    """(query_id, pos, doc, page) of the citation marks in answers."""
    mark = r"\[Source: ([^,\]]+), page ([^\]]+)\]"
    docs, pages = (F.regexp_extract_all("answer", F.lit(mark), F.lit(k)) for k in (1, 2))
    return answers.select("query_id", F.posexplode(F.arrays_zip(docs.alias("doc"), pages.alias("page"))).alias("pos", "m")).select("query_id", "pos", F.col("m.doc").alias("doc"), F.col("m.page").alias("page"))


def _diff(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Runs (side, words) of a longest common subsequence; on ties words of the first text come first.

    length(i, j) is that of a[i:] and b[j:]. A row of it is one whole number, whose bits from the end of b on are 0 where a word of b adds to the
    length, so a word of a takes a few operations on such numbers. Every root(n)-th row is kept; those between are made again where they are read.
    """
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    runs: list[tuple[str, list[str]]] = [("both", a[:same])] if same else []
    a, b = a[same:], b[same:]
    n, m = len(a), len(b)
    places: dict[str, list[int]] = {}
    for j, word in enumerate(reversed(b)):
        places.setdefault(word, []).append(j)
    full, step = (1 << m) - 1, math.isqrt(n) + 1

    @lru_cache(max(64, _MASKS // (m + 1)))
    def mask(word: str) -> int:
        bits = bytearray(m // 8 + 1)
        for j in places.get(word, ()):
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    def above(row: int, word: str) -> int:
        met = row & mask(word)
        return ((row + met) | (row ^ met)) & full if met else row

    row, held = full, {n: full}
    for i in range(n - 1, -1, -1):
        row = above(row, a[i])
        if i % step == 0:
            held[i] = row
    rows: dict[int, int] = {}
    i = j = 0
    left = m - row.bit_count()  # length(i, j)
    while i < n or j < m:
        if i < n and i + 1 not in rows:
            top = min(n, (i // step + 1) * step)
            rows = {top: held[top]}
            for k in range(top - 1, i - 1, -1):
                rows[k] = above(rows[k + 1], a[k])
        if i < n and j < m and a[i] == b[j]:
            side, word, i, j, left = "both", a[i], i + 1, j + 1, left - 1
        elif j == m or (i < n and (not rows[i] >> (m - 1 - j) & 1 or m - j - (rows[i + 1] & ((1 << (m - j)) - 1)).bit_count() == left)):  # length(i + 1, j) >= length(i, j + 1)
            side, word, i = "a", a[i], i + 1
        else:
            side, word, j = "b", b[j], j + 1
        if runs and runs[-1][0] == side:
            runs[-1][1].append(word)
        else:
            runs.append((side, [word]))
    return [(s, " ".join(w)) for s, w in runs]


def word_diff(pairs: DataFrame, most: int | None = 400) -> DataFrame:
    """(pair_id, pos, side, words) of rows (pair_id, a, b): words that both or one of two texts hold.

    If one of the texts has over `most` words, the two are not compared: each is a run of its own, whole. None: all are compared.
    """

    def runs(a: str, b: str) -> list[tuple[str, str]]:
        left, right = a.split(), b.split()
        if most is not None and max(len(left), len(right)) > most:
            return [(side, " ".join(w)) for side, w in (("a", left), ("b", right)) if w]
        return _diff(left, right)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 100):  # runs of many pairs at once would be most of the worker's memory
                part = frame.iloc[at : at + 100]
                yield pd.DataFrame([(p, k, s, w) for p, a, b in zip(part["pair_id"], part["a"], part["b"]) for k, (s, w) in enumerate(runs(a or "", b or ""))], columns=["pair_id", "pos", "side", "words"])

    return pairs.select("pair_id", "a", "b").mapInPandas(compare, f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, pos int, side string, words string")


def context_blocks(prompts: DataFrame) -> DataFrame:
    """(query_id, rank, doc, page, text, score) of prompts that hold numbered [CTX n] (document) blocks."""
    blocks = prompts.select("query_id", F.posexplode(F.filter(F.split("block", r"\[CTX \d+\]"), lambda b: F.trim(b) != "")).alias("k", "b"))
    return blocks.select("query_id", (F.col("k") + 1).alias("rank"), F.regexp_extract("b", r"\(([^)]*)\)", 1).alias("doc"), F.lit(1).alias("page"), F.regexp_replace(F.regexp_replace("b", r"^\s*\([^)]*\)", ""), r"^\s+|\s+$", "").alias("text"), F.lit(1.0).alias("score"))


def fallback_text(rows: DataFrame) -> DataFrame:
    """Rows (query_id, route, best, support, retries) with the honest reply that is given instead of an answer."""
    why = F.when(F.col("route") == "out_of_scope", "the question seems to be outside the indexed documents").when(F.col("support").isNotNull(), F.format_string("the draft was supported to %.2f only", "support")).otherwise(F.format_string("the best passage was graded %.2f after %d rewrites", "best", "retries"))
    return rows.withColumn("answer", F.concat(F.lit("I couldn't find this in the provided documents ("), why, F.lit(").")))


def best_first(graded: DataFrame, least: float = 0.35) -> DataFrame:
    """Relevant chunks of each query, by grade and then by rank."""
    by = Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")
    return graded.where(F.col("grade") >= least).withColumn("pick", F.row_number().over(by))
