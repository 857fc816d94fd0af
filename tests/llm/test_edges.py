"""Very long texts, empty tables, null and repeated ids, clashing columns: all operators and all stages."""

import random

import corpus_pipeline
import pytest

from quern.llm import brownlm, decontaminate, kdshard, linecrf, multiindex, packing, secrets, simhash, suffixdedup, toxicity

from . import brute

LINES = 100_000
COLUMNS = "text string, bits long, doc_id long, spans string, component string, lang string, source string, n_chars long, label int, rank int, shard int, row long, fp long"


def make(spark, texts, ids):
    return spark.createDataFrame([(t, 1, i, "x", "y", "en", f"s{k % 2}", None if t is None else len(t), 1, 2, 3, 4, 5) for k, (i, t) in enumerate(zip(ids, texts))], COLUMNS)


@pytest.fixture(scope="module")
def long(spark):
    """A text of 100,000 lines, one without white space, and short ones; labels and a benchmark for them."""
    rng = random.Random(1)
    words = ["the", "of", "and", "rest", "idiot", "straße", "x9"]
    lines = "\n".join(rng.choice(words) for _ in range(LINES))
    run = "".join(rng.choice("ghjkmnpqrstvwxyz") for _ in range(LINES))
    texts = [lines, run, "one two three.", None, "", lines[:500]]
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(6)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, lines[1000:1100]), (2, "never seen anywhere in these few texts at all today")], "item_id long, text string")
    return texts, make(spark, texts, range(6)), labels, bench


def test_long_texts_are_treated_whole(spark, long):
    texts, docs, labels, bench = long
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}
    rows = by_id(secrets.secret_report(docs))
    assert [rows[k]["n_hex"] for k in range(6)] == [0] * 6 and rows[1]["spans"] == f"random:0:{LINES}"
    rows = by_id(simhash.near_duplicate_report(docs))
    assert all(rows[k]["fingerprint"] == f"{brute.simhash(t or ''):016x}" for k, t in enumerate(texts) if k)
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rows = by_id(decontaminate.contamination_report(docs, bench))
    assert all((rows[k]["n_words"], rows[k]["n_hit"]) == brute.contamination(t, items)[:2] for k, t in enumerate(texts))
    assert rows[0]["contaminated"]
    rows = by_id(suffixdedup.repeats_report(docs))
    assert [rows[k]["n_bytes"] for k in range(6)] == [len((t or "").encode()) for t in texts] and rows[5]["n_removed"] == len(lines := texts[5].encode()) and lines
    pieces = {}
    for r in packing.pack(docs).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for k in range(6):
        own = sorted(pieces[k])
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:])) and sum(n for _, n, _ in own) == own[0][2]
    assert sum(r["size"] for r in kdshard.shard_report(docs).collect()) == sum(len((t or "").encode()) + 1 for t in texts)
    rows = by_id(brownlm.lm_report(docs))
    assert rows[0]["n_tokens"] == LINES + 1 and rows[1]["n_tokens"] == 2 and rows[3]["n_tokens"] == 1
    assert by_id(linecrf.quality_report(docs, labels))[0]["n_lines"] == LINES
    assert by_id(toxicity.toxicity_report(docs, labels))[0]["n_hits"] == texts[0].split().count("idiot")
    vectors = spark.createDataFrame([(k, [float(k + j) for j in range(20_000)]) for k in range(3)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in multiindex.neighbour_report(vectors).orderBy("rank").collect()] == [1, 2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, long):
    at = str(tmp_path_factory.mktemp("tables"))
    long[2].write.parquet(f"{at}/labels.parquet")
    long[3].write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_long_texts(spark, long, folder, name, stage):
    out = stage(spark, long[1], folder)
    assert out.count() > (0 if name == "quality" else 3)
    if name == "secrets":
        assert {r["doc_id"]: r["text"] for r in out.collect()} == {k: "<SECRET>" if k == 1 else t for k, t in enumerate(long[0])}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_any_ids_and_columns(spark, folder, name, stage):
    texts = ["a b c d e f", "a b c d e f", "password=abcdefgh99", None, "", "k l m n o p", "k l m n o p q"]
    docs = make(spark, texts, [None, None, 4, 5, 5, 4, 4])
    out = stage(spark, docs, folder)
    assert stage(spark, docs.limit(0), folder).count() == 0
    if name == "packing":
        assert sum(r["length"] for r in out.collect()) == sum({(r["doc_id"], r["doc_tokens"], r["ids_crc32"], r["sequence_id"], r["offset"]): r["length"] for r in out.collect()}.values())
        return
    assert out.columns == docs.columns
    rows = sorted((str(r["doc_id"]), r["text"] if r["text"] is not None else "-") for r in out.collect())
    every = sorted((str(i), t if t is not None else "-") for i, t in zip([None, None, 4, 5, 5, 4, 4], texts))
    if name == "decontaminate":
        assert rows == every
    if name == "secrets":
        assert rows == sorted((i, "<SECRET>" if t.startswith("password") else t) for i, t in every)
    if name == "near_dedup":  # the empty text and the missing one are one group of one id
        assert [r for r in rows if r[0] != "5"] == [r for r in every if r[0] != "5"] and sum(r[0] == "5" for r in rows) == 1
    if name == "quality":  # labels of both kinds: each row is judged for itself
        assert set(rows) <= set(every)
