import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions import lexicon as L
from quern.functions import text as X
from quern.functions import vectors as V
from quern.operators import answering as A
from quern.operators import chunking as C
from quern.operators import ranking as R
from quern.operators import telemetry as T
from quern.operators.quantiles import exact_percentiles


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def plain_stem(word):
    return next((word[: -len(x)] for x in L.SUFFIXES if word.endswith(x) and len(word) - len(x) >= 4), word)


def test_tokens_and_stems(spark):
    assert one(spark, X.tokens, "What is the X200's Warranty, in München?") == ["x200", "warranty", "m", "nchen"]
    assert one(spark, X.approx_tokens, "a b c d e") == 6 and one(spark, X.approx_tokens, " ".join("a" * 15)) == 20 and one(spark, X.approx_tokens, "") == 1
    for word in ("inspection", "inspected", "batteries", "ions", "process", "rations", "utilities"):
        assert one(spark, X.stem, word) == plain_stem(word)
    text = "Inspections, inspected; UTILITIES rations ions-process é1ations x" + "y" * 100_000 + "ing 12 nationalities\nsses"
    assert one(spark, X.stemmed, text) == re.sub("[a-z0-9]+", lambda m: plain_stem(m[0]), text.lower())
    assert one(spark, X.stemmed, "") == "" and one(spark, X.stemmed, None) is None
    assert one(spark, X.judge_stem, "Devices") == "devic" and one(spark, X.judge_stem, "dog's") == "dog"
    assert one(spark, X.fnv1a, "warranty") == 1338345421
    assert one(spark, X.units, "## 1. Purpose and Scope\n\nThis is. Next! ok") == ["## 1.", "Purpose and Scope", "This is.", "Next!", "ok"]
    assert one(spark, X.clean_page, "a  \r\n\n\n\nb \n") == "a\n\nb"
    assert one(spark, lambda c: X.preview(c, 6), "abc  defghi") == "abc d…"
    assert one(spark, X.content_terms, "please tell me about 24 months of X2 warranty warranty") == ["24", "months", "warranty"]
    assert set(one(spark, lambda c: X.synonym_stems(X.tokens(c)), "processing time")) == {plain_stem(w) for k in ("processing", "time") for s in L.SYNONYMS[k] for w in s.split()}


def test_exact_percentiles_by_numpy(spark):
    """Skewed, repeated and single values, a null key, a key of nulls only; slots of few values, and far more values than slots."""
    draw = random.Random(3)
    rows = [("skew", float(draw.randrange(5)) if draw.random() < 0.7 else draw.random() * 10 ** draw.randrange(6)) for _ in range(3000)]
    rows += [("one", 7.5), ("pair", 1.0), ("pair", 2.0), ("void", None), (None, 3.0), (None, 4.0), (None, None), ("same", 2.0), ("same", 2.0), ("same", 2.0)]
    table = spark.createDataFrame(rows, "k string, v double")
    for nearest, method in ((False, "linear"), (True, "inverted_cdf")):
        got = {r["k"]: (r["p50"], r["p95"]) for r in exact_percentiles(table, "k", "v", nearest, slots=10).collect()}
        assert set(got) == {k for k, _ in rows} and got["void"] == (None, None)
        for k in set(got) - {"void"}:
            own = [v for n, v in rows if n == k and v is not None]
            assert got[k] == pytest.approx([np.quantile(own, p, method=method) for p in (0.5, 0.95)], abs=1e-4), k
    assert exact_percentiles(table.limit(0), "k", "v").count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0], [1.0])], "a array<double>, b array<double>, c array<double>")
    r = df.select(V.cosine(F.col("a"), F.col("b")).alias("x"), V.cosine(F.col("a"), F.col("c")).alias("y"), V.softmax(F.col("a")).alias("s")).first()
    assert r["x"] == pytest.approx(0.8) and r["y"] == 0 and sum(r["s"]) == pytest.approx(1)


def chunked(spark, pages, **options):
    return [(r["page"], r["section"], r["text"], r["token_count"]) for r in C.chunk_pages(spark.createDataFrame([("g.md", pages), ("none", None)], "doc string, pages array<string>"), **options).orderBy("chunk_no").collect()]


def test_page_chunks(spark):
    prose = " ".join(f"Sentence number {i} says little of note here." for i in range(12))
    pages = ["# Guide\n\n" + prose + "\n\n## Limits\n\n| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {i * i} |" for i in range(8)), "Tiny tail."]
    rows = chunked(spark, pages, target=40, least=12)
    assert {r[1] for r in rows} == {"Guide", "Limits"}
    assert rows[-1][2].endswith("Tiny tail.") and rows[-1][0] == 1
    whole = "\n".join(r[2] for r in rows)
    assert all(f"Sentence number {i} says" in whole for i in range(12)) and all(f"| {i} | {i * i} |" in whole for i in range(8))
    table = next(r for r in rows if "| 0 | 0 |" in r[2])
    assert "| 7 | 49 |" in table[2]


def test_page_chunk_rules(spark):
    """Golden rows: what headings, overlaps, tables and rests do, worked out by hand."""
    s = [f"Sentence {k} has just seven words here." for k in range(6)]  # 9 tokens each
    # a heading ends a chunk of `least` tokens and carries the overlap; the label is the chunk's own section or the heading's
    page = f"{s[0]} {s[1]}\n\n## Next\n\n{s[2]}"
    want = f"{s[1]}\n## Next\n{s[2]}"
    assert chunked(spark, [page], target=100, least=12) == [(1, "Next", f"{s[0]}\n{s[1]}", 18), (1, "Next", want, 21)]
    headed = f"# First\n\n{page}"
    assert [r[1] for r in chunked(spark, [headed], target=100, least=12)] == ["First", "Next"]
    assert [r[1] for r in chunked(spark, [headed], target=100, least=12, section_mode="reference")] == ["Next", "Next"]
    # a full chunk leaves its last unit; an overlap that is left alone joins the chunk before it once more, or stands alone if it has `least` tokens
    assert chunked(spark, [f"{s[0]} {s[1]}"], target=18, least=12) == [(1, "", f"{s[0]}\n{s[1]}\n{s[1]}", 27)]
    assert chunked(spark, [f"{s[0]} {s[1]}"], target=18, least=9) == [(1, "", f"{s[0]}\n{s[1]}", 18), (1, "", s[1], 9)]
    assert chunked(spark, [f"{s[0]} {s[1]}"], target=18, least=12, overlap=0) == [(1, "", f"{s[0]}\n{s[1]}", 18)]
    # a table is not cut while its next row follows, up to twice the target
    rows = [f"| row {k} | some cell |" for k in range(9)]  # 7 words, 9 tokens
    got = chunked(spark, ["\n".join(rows[:4])], target=18, least=5)
    assert [r[2] for r in got] == ["\n".join(rows[:4]), rows[3]]
    got = chunked(spark, ["\n".join(rows)], target=18, least=5)
    assert [r[2].count("\n") + 1 for r in got] == [4, 4, 3, 1] and got[1][2].startswith(rows[3])
    # long units are cut at colons and semicolons too, table rows are not
    long = "Here is a rather long sentence: it goes on; and on and on until it has over ninety characters in all."
    assert C.page_units(long) == ["Here is a rather long sentence:", "it goes on;", "and on and on until it has over ninety characters in all."]
    assert C.page_units(f"x\n| {long[:-1]} |") == ["x", f"| {long[:-1]} |"]
    # a small page joins the last chunk of the page before it
    assert chunked(spark, [s[0], "Tail."], target=100, least=5) == [(1, "", f"{s[0]}\nTail.", 10)]


def test_recursive_split_bounds():
    rng = random.Random(1)
    text = "\n\n".join(" ".join("w" * rng.randint(1, 12) for _ in range(rng.randint(1, 120))) for _ in range(20)) + "x" * 2500
    parts = C.split_recursively(text, 300, 40)
    assert all(len(p) <= 300 for p in parts) and C.split_recursively("  ") == []
    assert "".join(re.sub(r"\s", "", p) for p in parts).count("x") >= 2500


CHUNKS = [
    (1, "x200_manual.md", "The X200 warranty lasts 24 months from delivery. Keep the invoice for any claim you make."),
    (2, "x300_manual.md", "The X300 warranty lasts 36 months from delivery. Registration is required within thirty days."),
    (3, "rma_faq.txt", "How long does evaluation take? Evaluation of a returned unit takes 48 hours at the Rotterdam site."),
    (4, "firmware.md", "Firmware v3.2.0 or earlier must not be used. Install firmware v3.2.1 to fix the timeout fault of the bus."),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, doc string, text string").withColumn("page", F.lit(1))


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions, 1)), "query_id long, question string")


def test_bm25_by_hand(spark, chunks):
    q = asked(spark, "warranty warranty months x300")
    got = {r["chunk_id"]: r["score"] for r in R.bm25_top(chunks, q, 10).collect()}
    toks = {i: [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in L.STOPWORDS] for i, _, text in CHUNKS}
    mean = sum(map(len, toks.values())) / 4
    for i, own in toks.items():
        want = 0.0
        for t in ["warranty", "warranty", "months", "x300"]:
            df, tf = sum(t in o for o in toks.values()), own.count(t)
            want += math.log((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / mean))
        assert got.get(i, 0.0) == pytest.approx(want)


def test_hybrid_answers(spark, chunks):
    q = asked(spark, "How long is the warranty of the X300?", "RMA processing time", "Which firmware version fixes the timeout?")
    vectors = R.hash_vectors(chunks, "chunk_id", "text")
    pool = R.dense_top(vectors, R.hash_vectors(q, "query_id", "question", query_side=True), 4)
    picks = R.mmr(pool.join(vectors.withColumnRenamed("id", "chunk_id"), "chunk_id"), 3).withColumnRenamed("pick", "rank")
    fused = R.rrf([picks, R.bm25_top(chunks, q, 4)])
    named = R.code_named(fused, chunks, q)
    assert {(r["query_id"], r["chunk_id"]) for r in named.collect()} <= {(1, 2)}
    ranked = R.top_k(R.blend(fused, chunks, q), 4, places=4)
    best = {r["query_id"]: r["chunk_id"] for r in ranked.where("rank = 1").collect()}
    assert best == {1: 2, 2: 3, 3: 4}
    contexts = ranked.select("query_id", "chunk_id", "rank").join(chunks, "chunk_id")
    answers = A.extract_answers(contexts, q)
    said = {r["query_id"]: r["answer"] for r in answers.collect()}
    assert said[1].startswith("The X300 warranty lasts 36 months") and "[Source: x300_manual.md, page 1]" in said[1]
    assert "48 hours" in said[2] and said[3].startswith("Install firmware v3.2.1")
    assert {r["verdict"] for r in A.verify(answers, contexts).collect()} == {"supported"}
    judged = {r["query_id"]: r for r in A.faithfulness(answers, contexts.select("query_id", "text")).collect()}
    assert all(r["score"] > 0.6 and r["contradictions"] == 0 for r in judged.values())
    wrong = A.faithfulness(spark.createDataFrame([(1, "The X300 warranty lasts 99 months from delivery.")], "query_id long, answer string"), contexts.select("query_id", "text")).first()
    assert wrong["contradictions"] == 1 and wrong["supported"] == 0
    marks = {(r["query_id"], r["doc"]) for r in A.cited(answers).collect()}
    assert (1, "x300_manual.md") in marks


def test_rerank_prefers_the_answer(spark, chunks):
    q = asked(spark, "How long does evaluation take at the Rotterdam site?")
    pairs = chunks.select("chunk_id", "doc", "text").crossJoin(q).withColumn("fusion_rank", F.col("chunk_id").cast("int"))
    rows = {r["chunk_id"]: r for r in R.reranked(R.rerank_features(pairs, q, R.idf_table(chunks))).collect()}
    assert rows[3]["rank"] == 1 and rows[3]["phrase"] > 0 and rows[3]["sentence"] > 0 and "48 hours" in rows[3]["best_sentence"]


def test_rerank_features_by_hand(spark):
    """idf 1.5 for each stem of its own: weights, order of sentences, codes, empty questions and null texts."""
    rows = [(1, "s200_data.md", "The S200 accuracy is 0.5 V over its range. The S200 sensor is calibrated.\nAccuracy matters in each season here"), (2, "a", None), (3, None, "accuracy")]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc string, text string")
    q = spark.createDataFrame([(1, "What accuracy has the S200 range?"), (2, "")], "query_id long, question string")
    none = spark.createDataFrame([], "term string, idf double")
    got = {(r["query_id"], r["chunk_id"]): r for r in R.rerank_features(chunks.crossJoin(q), q, none).collect()}
    r = got[1, 1]
    assert len(got) == 6 and r["sentence"] == 1.0 and r["idf_cov"] == 1.0 and r["code"] == 1.0 and r["phrase"] == 0.0 and r["bigram"] == 0.2
    assert r["best_sentence"] == "The S200 accuracy is 0.5 V over its range." and r["proximity"] == round(5 / 15, 4)
    assert r["rerank_score"] == round(0.26 + 0.18 + 0.14 * 5 / 15 + 0.02 + 0.12 + 0.06, 4)
    lone = got[1, 3]
    assert lone["idf_cov"] == round(1 / 3, 4) and lone["proximity"] == 0.35 and lone["code"] == 0.0 and lone["best_sentence"] in ("", "accuracy")
    assert all(got[k]["sentence"] == got[k]["idf_cov"] == 0.0 and got[k]["best_sentence"] == "" for k in ((1, 2), (2, 1), (2, 2), (2, 3))) and got[2, 1]["code"] == 0.5


def test_routes(spark):
    vocabulary = spark.createDataFrame([(w,) for w in "warranty months x300 delivery".split()], "term string")
    q = asked(spark, "Hello there", "ok", "weather in paris", "warranty months delivery", "banana smoothie recipe", "what is it", "who discovered warranty months")
    got = {r["query_id"]: (r["route"], r["confidence"]) for r in A.route(q, vocabulary).collect()}
    assert got[1] == ("chitchat", 0.95) and got[2] == ("chitchat", 0.8) and got[3][0] == "out_of_scope"
    assert got[4] == ("document", 1.0) and got[5] == ("out_of_scope", 0.0) and got[6] == ("out_of_scope", 0.3) and got[7][0] == "document"


def test_decompose(spark):
    q = asked(spark, "Compare the standard warranty of the X200 and the x300", "warranty of the X200", "difference between x100, x200, x300 and s350 range", "Which is better, both x200 or x200?", "between the X100 and the S200")
    got = {}
    for r in A.decompose(q).collect():
        got.setdefault(r["query_id"], []).append(r["sub_query"])
    assert got == {1: ["standard warranty X200", "standard warranty x300"], 5: ["specifications X100", "specifications S200"]}


def test_rewrite_and_grade(spark):
    q = asked(spark, "how long is the warranty", "the of")
    assert [r["rewritten"] for r in A.rewrite(q).orderBy("query_id").collect()] == ["long warranty duration hours time guarantee coverage period warranty period", "the of"]
    pairs = spark.createDataFrame([(1, 1, "processing time", "evaluation takes 48 hours", 0.5), (1, 2, "processing time", "nothing here", 0.0), (2, 1, "it", "x", 1.0)], "query_id long, chunk_id long, question string, text string, score double")
    got = {(r["query_id"], r["chunk_id"]): r["grade"] for r in A.grade(pairs).collect()}
    assert got == {(1, 1): pytest.approx(0.6 * 0.8 + 0.2), (1, 2): 0.0, (2, 1): 0.0}
    steps = {r["query_id"]: r["step"] for r in A.next_step(A.grade(pairs), F.lit(2)).collect()}
    assert steps == {1: "generator", 2: "fallback"}


def test_units_of_tables():
    text = "| Model | Term |\n|---|---|\n| X200 | 24 months |\n| X300 | |\n\n| a | b |\n| c | d |\nThis sentence is long enough to be quoted here. Short one.\n```code of more than thirty characters```"
    assert A.units_of(text) == ["X200 (Model); 24 months (Term)", "X300 (Model)", "a — b", "c — d", "This sentence is long enough to be quoted here."]


def test_keywords_deltas_and_blocks(spark):
    assert one(spark, A.keywords, "It runs at 24 months, ±0.3 °C and code E103 with v3.2.1") == [r"24\s*months?", r"0\.3\s*°?\s*C", "E103"]
    assert one(spark, A.keywords, "plain abc12x and 4711") == ["abc12x", "4711"]
    assert one(spark, A.keywords, "v3.2.1 in 1 hour") == [r"1\s*hours?", r"v3\.2\.1"]
    from quern.operators.testing import first_match

    texts = spark.createDataFrame([("24 month", "x"), ("at 0.3C or so", "x"), ("0x3 C", "x")], "a string, b string")
    assert [r[0] for r in texts.select(first_match(F.col("a"), A.keywords(F.lit("24 months, 0.3 °C")))).collect()] == [r"24\s*months?", r"0\.3\s*°?\s*C", None]
    parts = [r["delta"] for r in A.deltas(spark.createDataFrame([(1, "a b c d e f")], "query_id long, answer string")).orderBy("seq").collect()]
    assert parts == ["a b c d ", "e f"]
    blocks = A.context_blocks(spark.createDataFrame([(1, "[CTX 1] (a.md) first text\n[CTX 2] (b.md) second")], "query_id long, block string")).collect()
    assert [(r["rank"], r["doc"], r["text"]) for r in blocks] == [(1, "a.md", "first text"), (2, "b.md", "second")]


def test_word_diff(spark):
    rows = A.word_diff(spark.createDataFrame([(1, "the cat sat down", "the dog sat"), (2, None, "x")], "pair_id long, a string, b string")).orderBy("pair_id", "pos").collect()
    assert [(r["side"], r["words"]) for r in rows if r["pair_id"] == 1] == [("both", "the"), ("a", "cat"), ("b", "dog"), ("both", "sat"), ("a", "down")]
    assert [(r["side"], r["words"]) for r in rows if r["pair_id"] == 2] == [("b", "x")]
    long = " ".join(f"w{i}" for i in range(501))
    rows = A.word_diff(spark.createDataFrame([(3, long, long + " end")], "pair_id long, a string, b string")).orderBy("pos").collect()
    assert [(r["side"], r["words"]) for r in rows] == [("a", long), ("b", long + " end")]


def test_word_diff_compares_texts_of_any_length(spark):
    """Against the table of lengths in full."""

    def plain(a, b):
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in np.ndindex(len(a), len(b)):
            i, j = len(a) - 1 - i, len(b) - 1 - j
            best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
        runs, i, j = [], 0, 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                side, word, i, j = "both", a[i], i + 1, j + 1
            elif j == len(b) or (i < len(a) and best[i + 1, j] >= best[i, j + 1]):
                side, word, i = "a", a[i], i + 1
            else:
                side, word, j = "b", b[j], j + 1
            runs += [] if runs and runs[-1][0] == side else [(side, [])]
            runs[-1][1].append(word)
        return [(s, " ".join(w)) for s, w in runs]

    rng = random.Random(8)
    pairs = []
    for k, (n, m, words) in enumerate([(500, 450, 3), (450, 520, 60), (401, 30, 5), (12, 430, 900), (420, 420, 1)]):
        pairs.append((k, *(" ".join(str(rng.randrange(words)) for _ in range(x)) for x in (n, m))))
    rows = A.word_diff(spark.createDataFrame(pairs, "pair_id long, a string, b string"), most=None).orderBy("pair_id", "pos").collect()
    for k, a, b in pairs:
        assert [(r["side"], r["words"]) for r in rows if r["pair_id"] == k] == plain(a.split(), b.split())


def test_lcs_diff_compares_turns_of_any_length(spark, tmp_path):
    from quern.jobs.answer_jobs import lcs_diff

    long = " ".join(f"w{i}" for i in range(501))
    turns = [(1, 0, "user", long), (1, 1, "assistant", long.replace("w7 ", "other ") + " end")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(tuple(r) for r in lcs_diff(spark, str(tmp_path)).collect()) == [(1000, "a", 1, 1), (1000, "b", 2, 2), (1000, "both", 2, 500)]


def test_word_diff_is_a_longest_common_subsequence(spark):
    """Against subsequences tried one by one, over all pairs of short texts of three words."""
    from itertools import combinations

    rng = random.Random(6)
    pairs = [(k, " ".join(rng.choices("abc", k=rng.randint(0, 8))), " ".join(rng.choices("abc", k=rng.randint(0, 8)))) for k in range(40)]
    rows = A.word_diff(spark.createDataFrame(pairs, "pair_id long, a string, b string")).orderBy("pair_id", "pos").collect()
    for k, a, b in pairs:
        own = [(r["side"], r["words"].split()) for r in rows if r["pair_id"] == k]
        for side, text in (("a", a), ("b", b)):
            assert [w for s, ws in own if s in (side, "both") for w in ws] == text.split()
        left, right = a.split(), b.split()
        inside = lambda sub: (lambda it: all(w in it for w in sub))(iter(right))
        longest = max(n for n in range(len(left) + 1) if any(inside(c) for c in combinations(left, n)))
        assert sum(len(ws) for s, ws in own if s == "both") == longest


def test_fusion_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "query_id long, chunk_id long, rank int")
    fused = [{r["chunk_id"]: round(r["fused"], 12) for r in R.rrf(x).collect()} for x in ([a, b], [b, a])]
    assert fused[0] == fused[1] and max(fused[0], key=fused[0].get) == 8


def test_diversity_of_one_is_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    pool = R.dense_top(vectors, vectors.where("id < 4"), 10).join(vectors.withColumnRenamed("id", "chunk_id"), "chunk_id")
    picked = {(r["query_id"], r["pick"]): r["chunk_id"] for r in R.mmr(pool, 5, weight=1.0).collect()}
    assert picked == {(r["query_id"], r["rank"]): r["chunk_id"] for r in pool.collect() if r["rank"] <= 5}
    assert R.dense_top(vectors, vectors, 3, block=16).count() == 120


def test_follow_ups(spark):
    turns = spark.createDataFrame([("s", 0, "Tell me about the X200 and S350", "document"), ("s", 1, "its warranty?", "document"), ("s", 2, "hello x999 now", "chitchat"), ("s", 3, "and the range", "document"), ("t", 0, "its warranty?", "document")], "session_id string, turn int, question string, route string")
    rows = {(r["session_id"], r["turn"]): r for r in T.follow_ups(turns, T.entities(F.col("question")), F.col("question").rlike("(?i)" + L.FOLLOW_UP_CUE)).collect()}
    assert rows["s", 1]["effective_question"] == "its warranty? x200 s350" and rows["s", 3]["effective_question"] == "and the range x200 s350"
    assert not rows["t", 0]["applied"] and not rows["s", 0]["applied"]


def test_exposition_round_trip(spark):
    from quern.sources.exposition import parse

    samples = spark.createDataFrame([("m", {"a": 'x"y\\z', "b": "1"}, 2.5), ("n", {}, 3.0)], "name string, labels map<string,string>, value double")
    lines = T.exposition(samples)
    assert {r["line"] for r in lines.collect()} == {'m{a="x\\"y\\\\z",b="1"} 2.5', "n 3.0"}
    back = {r["name"]: r for r in parse(lines.select(F.col("line").alias("value"))).collect()}
    assert back["m"]["value"] == 2.5 and back["m"]["labels"]["b"] == "1" and back["n"]["labels"] == {}


def test_sources(spark, tmp_path):
    from quern.sources import documents as D
    from quern.sources import tables as S

    (tmp_path / "assets").mkdir()
    (tmp_path / "a.md").write_text("héllo wörld", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("grüße".encode("latin-1"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "assets" / "d.md").write_text("no")
    files = D.corpus_files(spark, str(tmp_path))
    pages = {r["doc"]: (r["pages"], r["words"]) for r in D.text_pages(files).collect()}
    assert pages == {"a.md": (["héllo wörld"], 2), "b.txt": (["grüße"], 1)}
    assert [r["reason"] for r in D.unread(files).collect()] == ["no reader for .pdf"]

    (tmp_path / "store.json").write_text('{"id": "a", "n": 1}\nnot json\n{"n": 2}\n')
    schema = spark.createDataFrame([], "id string, n int").schema
    assert [r["id"] for r in S.restore_json(spark, str(tmp_path / "store.json"), schema, ("id",)).collect()] == ["a"]
    assert S.current(spark, str(tmp_path / "nowhere"), schema).count() == 0

    stream = spark.createDataFrame([('event: node\ndata: {"a": 1}\n\ndata: {"b":\ndata: 2}\n\nevent: x\n\ndata: oops',)], "value string")
    assert [(r["event"], r["data"]) for r in D.frames(stream).orderBy("pos").collect()] == [("node", '{"a": 1}'), ("message", '{"b":\n2}')]
    rows = spark.createDataFrame([('say "hi", all', ["a", "b"], "x|y\nz")], "q string, docs array<string>, m string")
    assert S.csv_lines(rows, ["q", "docs"]).first()["line"] == '"say ""hi"", all",a;b'
    assert S.markdown_rows(rows, ["m"]).first()["line"] == "| x\\|y z |"


def test_cache_steps():
    from quern.streaming.cache import cache_step

    v = lambda *x: list(map(float, x))
    rows = pd.DataFrame([(1, 0.0, "a", v(1, 0)), (2, 10.0, "a", v(0, 1)), (3, 20.0, "b", v(1, 0.01)), (4, 30.0, "c", v(0, 1)), (5, 2000.0, "a", v(1, 0))], columns=["query_id", "ts", "norm", "vector"])
    entries: list[dict] = []
    out = cache_step(rows, entries, ttl=900, capacity=2, least=0.93)
    assert [(q, h, e) for q, h, e, _ in out] == [(1, False, None), (2, True, 1), (3, True, 1), (4, False, None), (5, False, None)]
    assert [e["id"] for e in entries] == [5]


def test_cache_stream(spark, tmp_path):
    from quern.streaming.cache import cached

    schema = "tenant int, query_id long, ts double, norm string, vector array<double>"
    folder = str(tmp_path / "asks")
    for k, rows in enumerate([[(1, 1, 0.0, "a", [1.0, 0.0]), (2, 2, 1.0, "a", [1.0, 0.0])], [(1, 3, 2.0, "z", [1.0, 0.0])]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    got = []
    query = cached(stream, "tenant").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start()
    query.awaitTermination()
    assert sorted((r["query_id"], r["hit"], r["entry"]) for r in got) == [(1, False, None), (2, False, None), (3, True, 1)]


def test_late_events_are_left_out(spark, tmp_path):
    from quern.streaming import rates

    folder = tmp_path / "events"
    folder.mkdir()
    schema = "event_id long, ts timestamp, event_type string, value double"
    import datetime as dt

    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    for k, rows in enumerate([[(1, at(1, 0), "a", 1.0)], [(2, at(3, 0), "a", 1.0)], [(5, at(3, 1), "a", 1.0)], [(3, at(1, 1), "a", 1.0)], [(4, at(5, 0), "a", 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(folder / f"{k}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        import os
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    rates.drain(rates.route_rates(stream), str(tmp_path / "out"), str(tmp_path / "state"), "append")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["start"].hour, r["n"]) for r in rows) == [(1, 1), (3, 2)]


def test_plugins_degrade(spark):
    from quern.functions.plugins import batched

    def call(client, values):
        if any(v == "bad" for v in values):
            raise RuntimeError("down")
        return [client + v for v in values]

    good = spark.createDataFrame([("a",), ("b",)], "t string").select(batched(lambda: "x", call, "string")("t").alias("r"))
    assert sorted(r["r"] for r in good.collect()) == ["xa", "xb"]
    rule = spark.createDataFrame([("bad",)], "t string").select(F.coalesce(batched(lambda: "x", call, "string")("t"), F.lit("rule")).alias("r"))
    assert rule.first()["r"] == "rule"


def test_answers_from_the_end_of_a_whole_document(spark, tmp_path):
    from quern.jobs.answer_jobs import answer_extract

    text = " ".join(f"This sentence number {k} tells nothing of any use." for k in range(40)) + " The zorblat flange needs seventeen quivels."
    spark.createDataFrame([(1, text, "en", "manual")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zorblat flange quivels")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert "seventeen quivels. [Source: manual" in answer_extract(spark, str(tmp_path)).first()["answer"]


def test_comparing_answers_from_the_end_of_whole_documents(spark, tmp_path):
    from quern.jobs.case_jobs import ask_all

    text = lambda code, months: " ".join(f"This sentence number {k} tells nothing of any use." for k in range(40)) + f" The standard warranty of the {code} lasts {months} whole months."
    rows = [(1, text("X200", "seventeen"), "en", "x200_manual"), (2, text("X300", "thirtysix"), "en", "x300_manual")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Compare the standard warranty of the X200 and the X300")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first, second = ask_all(spark, str(tmp_path)).first()["answer"].split("\n")
    assert "X200 lasts seventeen whole months. [Source: x200_manual" in first and "X300 lasts thirtysix whole months. [Source: x300_manual" in second


def test_ask(spark, chunks):
    from quern.operators.asking import ask

    vocabulary = chunks.select(F.explode(X.tokens(F.concat_ws(" ", "text", F.regexp_replace("doc", "[_.]", " ")))).alias("term")).distinct()
    q = asked(spark, "How long is the warranty of the X300?", "hello", "banana smoothie recipe", "how long does a unit return take", "months thirty keep bananas smoothies recipes kitchens")
    got = {r["query_id"]: r for r in ask(q, chunks, vocabulary).collect()}
    assert len(got) == 5
    assert got[1]["route"] == "document" and "36 months" in got[1]["answer"] and got[1]["attempts"] == 1
    assert got[2]["route"] == "chitchat" and got[3]["route"] == "out_of_scope" and "outside" in got[3]["answer"]
    assert got[5]["route"] in ("fallback", "document")


def test_cases(spark):
    from quern.operators import testing as C

    rows = spark.createDataFrame([("24 Months", ["x", "24 ?months"]), ("a+b", ["a+b", "z"]), ("none", ["q"])], "t string, p array<string>")
    assert [r["m"] for r in rows.select(C.first_match(F.col("t"), F.col("p")).alias("m")).collect()] == ["24 ?months", "a+b", None]
    docs = spark.createDataFrame([(["x200_manual.md"], ["x200"]), (["a.md"], ["b"])], "d array<string>, e array<string>")
    assert [r["m"] for r in docs.select(C.expected_document(F.col("d"), F.col("e")).alias("m")).collect()] == [True, False]


def test_versions_and_comparisons(spark, chunks):
    assert one(spark, A.affirmed_version, "v3.2.0 or earlier must not be used. " + "x " * 40 + "Install v3.2.1 now.") == "v3.2.1"
    assert one(spark, A.affirmed_version, "units before v2.0 fail") is None
    subs = spark.createDataFrame([(1, 0, "warranty X200"), (1, 1, "warranty X300"), (1, 2, "warranty X999")], "query_id long, sub_no int, sub_query string")
    contexts = subs.where("sub_no < 2").select("query_id", "sub_no").crossJoin(chunks.where("chunk_id <= 2")).withColumn("rank", F.col("chunk_id").cast("int"))
    lines = A.compare_answers(contexts, subs).first()["answer"].split("\n")
    assert lines[0].startswith("warranty X200: The X200 warranty lasts 24") and lines[1].startswith("warranty X300: The X300 warranty lasts 36")
    assert lines[2] == "warranty X999: no passage of the documents covers this."


def test_ingest_and_stream_ingest(spark, tmp_path):
    from quern.jobs import ingest as I
    from quern.sources import tables as S
    from quern.streaming import sessions

    folder, out = tmp_path / "corpus", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.md").write_text("# One\n\nFirst text of the corpus. It has two sentences.")
    (folder / "b.txt").write_text("Second text, without any heading at all.")
    assert {r["doc"]: r["chunks"] for r in I.ingest(spark, str(folder), out).collect()} == {"a.md": 1, "b.txt": 1}
    (folder / "a.md").write_text("# One\n\nAnother text.")
    I.ingest(spark, str(folder), out)
    from quern.operators.indexed import opened

    read = lambda name: spark.read.parquet(S.latest(spark, out, name))
    texts = {r["doc"]: r["text"] for r in read("chunks").collect()}
    assert "Another text." in texts["a.md"] and len(texts) == 2
    assert read("blocks").where("term = 'second'").count() == 1 and read("vectors").count() == 2
    captions = spark.createDataFrame([("b.txt", 3, 1, "a chart")], "doc string, page int, figure_no int, caption string")
    assert {r["doc"]: (r["chunks"], r["figures"]) for r in I.ingest(spark, str(folder), out, figures=captions).collect()} == {"a.md": (1, 0), "b.txt": (2, 1)}
    figures = I.figure_chunks(spark.createDataFrame([("p.pdf", 3, 1, "a chart"), ("p.pdf", 3, 2, "a plot")], "doc string, page int, figure_no int, caption string"))
    assert figures.select("chunk_id").distinct().count() == 2 and I.numbered(figures).agg(F.max("ordinal")).first()[0] == 2
    before = S.versions(spark, out)
    with pytest.raises(Exception, match="no_such_column"):
        S.publish(spark, out, {"chunks": read("chunks"), "terms": read("terms").withColumn("x", F.raise_error(F.lit("no_such_column")))})
    assert S.versions(spark, out) == before and read("chunks").count() == 3
    I.reset(spark, out)
    assert all(read(name).count() == 0 for name in ("chunks", "vectors")) and all(opened(spark, out, name).count() == 0 for name in ("blocks", "forward", "levels", "terms"))
    (tmp_path / "odd").write_text("not a table")
    with pytest.raises(Exception):
        S.current(spark, str(tmp_path / "odd"), read("chunks").schema).count()

    from quern.sources.documents import corpus_files

    schema = spark.read.format("binaryFile").load(str(folder)).schema
    stream = spark.readStream.format("binaryFile").schema(schema).load(str(folder))
    files = stream.select("path", F.element_at(F.split("path", "/"), -1).alias("doc"), F.element_at(F.split("path", r"\."), -1).alias("kind"), "content")
    assert corpus_files(spark, str(folder)).count() == 2
    (folder / "scan.pdf").write_bytes(b"%PDF")
    (folder / "blank.txt").write_text(" \n\n ")
    states = lambda: {r["doc"]: (r["state"], r["error"], r["chunks"]) for r in sessions.job_states(spark.read.parquet(f"{out}/jobs")).collect()}
    sessions.ingest_jobs(files, f"{out}/stream", str(tmp_path / "state"), f"{out}/jobs").awaitTermination()
    assert spark.read.parquet(f"{out}/stream").select("doc").distinct().count() == 2
    assert states() == {"a.md": ("done", None, 1), "b.txt": ("done", None, 1), "scan.pdf": ("failed", "no reader for .pdf", None), "blank.txt": ("failed", "no extractable text", None)}
    (folder / "c.md").write_text("A third text comes later.")
    sessions.ingest_jobs(files, f"{out}/stream", str(tmp_path / "state"), f"{out}/jobs").awaitTermination()
    assert len(states()) == 5 and states()["c.md"] == ("done", None, 1)
    assert {(r["state"], r["step"]) for r in spark.read.parquet(f"{out}/jobs").collect()} == {("queued", 0), ("processing", 1), ("done", 2), ("failed", 2)}


def test_session_memory_stream(spark, tmp_path):
    from quern.streaming.sessions import remember

    schema = "session_id string, turn int, question string, route string, own array<string>, cue boolean"
    folder = str(tmp_path / "turns")
    for k, rows in enumerate([[("s", 0, "About the X200", "document", ["x200"], False)], [("s", 1, "its range?", "document", [], True), ("t", 0, "its range?", "document", [], True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    got = []
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    remember(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start().awaitTermination()
    assert sorted((r["session_id"], r["turn"], r["effective_question"]) for r in got) == [("s", 0, "About the X200"), ("s", 1, "its range? x200"), ("t", 0, "its range?")]


def test_hashes_of_word_pairs_go_on_from_those_of_words():
    import numpy as np
    from quern.operators import ranking

    def plain(text):
        h = 2166136261
        for b in text.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    words = ["a", "bcd", "", "z" * 300, "0_9"]
    data, size = np.frombuffer("".join(words).encode(), np.uint8).astype(np.uint64), np.array([len(w) for w in words])
    own = ranking._fnv_on(np.full(5, 2166136261, np.uint64), np.arange(5), data, np.cumsum(size) - size, size)
    assert own.tolist() == [plain(w) for w in words]
    assert ranking._fnv_on(own[[3, 0, 1]], np.array([1, 3, 2]), data, np.cumsum(size) - size, size).tolist() == [plain(words[i] + words[j]) for i, j in ((3, 1), (0, 3), (1, 2))]
