import random
import re

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from . import brute

WORDS = "the of erin hetion over and tion ouble rest with that anle thorst in by on for nd ing ered".split()


def tables(spark, folder):
    """Clean prose, junk, copies, passages of a benchmark item and secrets, told apart by their ids."""
    rng = random.Random(11)
    sentence = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "est", "ly"]) for _ in range(n)).capitalize() + "."
    prose = lambda: "\n".join(sentence(rng.randint(9, 16)) for _ in range(rng.randint(3, 8)))
    junk = lambda: "\n".join(" ".join(rng.choice(WORDS) + rng.choice(["%%%", "&&&", "$$$"]) for _ in range(14)) for _ in range(4))
    items = [(k, sentence(24)) for k in range(5)]
    texts = [junk() if k % 5 == 4 else prose() for k in range(200)]
    for k in range(0, 40, 4):
        texts[k + 100] = texts[k]  # the copy has the larger id
    for k in range(120, 160, 10):
        texts[k + 41] = texts[k] + " and more of it"  # a near copy, mostly beyond two bits of a fingerprint
    for k in range(1, 41, 10):
        texts[k] += "\n" + items[k % 5][1]
    for k in range(2, 60, 20):
        texts[k] += f"\npassword=abcdef{k:04d}12 and more"
    docs = [(k, t, "en", f"s{k % 7}", len(t)) for k, t in enumerate(texts)] + [(900, None, "en", None, None), (901, "", None, "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 < 4), 0) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {d[0]: d[1] for d in docs}, items


def test_pipeline_matches_brute_force(spark, tmp_path):
    folder = str(tmp_path / "data")
    texts, items = tables(spark, folder)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {k for k in range(200) if k % 5 < 4}
    assert clean <= set(kept["quality"]) and not set(kept["quality"]) & {k for k in range(200) if k % 5 == 4}
    assert all(kept["quality"][k] == texts[k] for k in kept["quality"])

    least = brute.near_groups(kept["quality"])
    assert kept["near_dedup"] == {k: t for k, t in kept["quality"].items() if least[k] == k}
    assert not any(k + 100 in kept["near_dedup"] for k in range(0, 40, 4) if k % 5 < 4)
    assert not any(k + 41 in kept["near_dedup"] for k in range(120, 160, 10) if k + 41 in kept["quality"])

    assert kept["decontaminate"] == {k: t for k, t in kept["near_dedup"].items() if not brute.contamination(t, items)[1]}
    assert set(kept["decontaminate"]) == set(kept["secrets"])
    for k, t in kept["secrets"].items():
        before, out, done = kept["decontaminate"][k], [], 0
        for start, _, stop in brute.secret_base(before or ""):
            out += [before[done:start], "<SECRET>"]
            done = stop
        assert t == ("".join([*out, before[done:]]) if before else before)
    assert sum("<SECRET>" in (t or "") for t in kept["secrets"].values()) == len([k for k in (2, 22, 42) if k in kept["secrets"]])

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in docs.collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(pieces) == set(kept["secrets"])
    for k, parts in pieces.items():
        n = len(own.encode(kept["secrets"][k] or "", add_special_tokens=False).ids) + 1
        assert sum(p[1] for p in parts) == n and {p[2] for p in parts} == {n}


def test_run_returns_the_last_stage(spark, tmp_path):
    folder = str(tmp_path / "data")
    tables(spark, folder)
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
    assert re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[0][0])
