"""Resampling, chat formatting and exact clustering against SQL, plain Python and hand-made cases."""

import hashlib
import json
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chatformat, ptolemaic, queries, resampling

from ..test_oracle import FOLDER, TABLES, rows_of

BENCH = ["alpha beta gamma delta epsilon", None, "Alpha-beta; straße 99"]


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_chat_formatting", "op13_ptolemaic_clustering"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)


# importance resampling


def plain_resample(docs, target, longest=1, buckets=50, min_words=3, percent=50):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t, made = [0] * buckets, [0] * buckets, [(i, *runs(x)) for i, x in docs]
    for b in (b for _, _, f in made for b in f):
        s[b] += 1
    for b in (b for x in target for b in runs(x)[1]):
        t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for i, words, f in made:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words >= min_words])
    order = sorted((k for k, r in enumerate(out) if r[4]), key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0))
    rank = {k: n + 1 for n, k in enumerate(order[: len(order) * percent // 100])}
    return sorted(((*r[:4], rank.get(k)) for k, r in enumerate(out)), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "straße", "99", "of", "the", "x", "ἀρχή", "delta"]
    rows = [(i, rng.choice([" ", "-", "\n", "\x00"]).join(rng.choices(words, k=rng.randrange(9)))) for i in range(60)]
    return [*rows, (None, "of the x"), (None, "of the x"), (70, None), (71, ""), (72, " .;"), *[(73, "alpha beta gamma")] * 5, (74, " ".join(rng.choices(words, k=150_000)))]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_by_plain_python(spark, corpus, longest):
    docs = spark.createDataFrame([(t, i, 1, 2, 3, 4) for i, t in corpus], "text string, doc_id long, score long, rank int, row long, bucket int").repartition(5)
    target = spark.createDataFrame([(x, 1) for x in BENCH], "text string, doc_id long")
    got = resampling.resample(docs, target, longest=longest, buckets=50, min_words=3, percent=50)
    own = sorted((tuple(r) for r in got.collect()), key=repr)
    want = plain_resample(corpus, BENCH, longest)
    assert [r[:4] for r in own] == [r[:4] for r in want]
    assert sorted(r[4] for r in own if r[4]) == list(range(1, sum(r[4] is not None for r in want) + 1))
    assert {(r[0], r[4]) for r in own if r[0] not in (None, 73)} == {(r[0], r[4]) for r in want if r[0] not in (None, 73)}
    drawn = resampling.draw(docs, target, longest=longest, buckets=50, min_words=3, percent=50)
    assert drawn.columns == docs.columns and {r["doc_id"] for r in drawn.collect()} == {r[0] for r in want if r[4] and r[0] is not None}


def test_resampling_of_empty_tables(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    target = spark.createDataFrame([(x,) for x in BENCH], "text string")
    assert resampling.resample(docs.limit(0), target).count() == 0
    none = resampling.resample(docs, target.limit(0), buckets=50, min_words=3, percent=50)
    assert sorted((tuple(r)[:4] for r in none.collect()), key=repr) == [r[:4] for r in plain_resample(corpus, [])]
    assert resampling.resample(docs, target, percent=0).where("rank IS NOT NULL").count() == 0


def test_resampling_finds_what_resembles_the_target(spark):
    """Of documents half of which are written in the target's words, nearly all that are drawn are of that half."""
    rng = random.Random(9)
    near, far = [f"near{k}" for k in range(200)], [f"far{k}" for k in range(200)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(near if i % 2 else far, k=40))) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(rng.choices(near, k=4000)),)], "text string")
    drawn = [r["doc_id"] for r in resampling.resample(docs, target).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 40 and sum(i % 2 for i in drawn) >= 32


# chat formatting

TEXTS = ["</turn>", "### user: ", "\\### Assistant: </turn> ok", "<\\/turn>", "#\\## ", "\\\\", "#### a", "x\\", "### ### </turn></turn>\n", "é\U0001f600", "", None, "a: b", "y" * 200_000]


def plain_report(rows):
    """rows: (conv_id, [(role, text)]) as they must be read back."""
    out = {}
    for c, turns in rows:
        learnt = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt))
    return out


def test_any_text_and_role_comes_back(spark):
    roles = ["user", "assistant", "system", None, "a: b", "### x: ", "</turn>", "\\", ""]
    rng = random.Random(3)
    chats = {c: [(rng.choice(roles), rng.choice(TEXTS)) for _ in range(rng.randrange(1, 9))] for c in [None, *range(40)]}
    rows = [(n, r, t, c, "m", 1) for c, turns in chats.items() for n, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "turn long, role string, text string, conv_id long, mask string, part int")
    records = chatformat.chat_records(table)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chatformat.chat_report(records).collect()}
    assert got == plain_report((c, [(r or "", t or "") for r, t in turns]) for c, turns in chats.items())
    assert chatformat.chat_report(records.limit(0)).count() == 0
    for r in chatformat.format_chats(chatformat.canonical_turns(records)).collect():
        text, mask, at, own = r["formatted"], r["mask"], 0, chats[r["conv_id"]]
        assert sum(m["before"] + m["inside"] + m["after"] for m in mask) == len(text) and text.count("</turn>\n") == len(own) == len(mask)
        for m, (role, _) in zip(mask, own):
            assert (m["inside"] == 0 or role == "assistant") and text[at : at + 4] == "### "
            at += m["before"] + m["inside"] + m["after"]


def test_ties_and_repeated_turns_have_an_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 1, "assistant", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    r = chatformat.format_chats(chatformat.canonical_turns(chatformat.chat_records(table))).first()
    assert r["formatted"] == "### system: s</turn>\n### user: a</turn>\n### user: a</turn>\n### user: b</turn>\n### assistant: z</turn>\n"
    assert [(m["before"], m["inside"], m["after"]) for m in r["mask"]][-1] == (15, 1, 8)


def test_layouts_are_told_by_their_paths(spark):
    records = [
        {"prompt": "p", "response": "r", "id": 7},
        {"prompt": "p", "completion": "c", "meta": {"score": 1, "tags": ["x"]}},
        {"system": "s", "prompt": "p", "response": None},
        {"instruction": "i", "output": "o"},
        {"instruction": "i", "input": "n", "output": "o"},
        {"instruction": "i", "input": "", "output": "o"},
        {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a", "weight": 1.5, "calls": [{"f": {"content": "no"}}]}], "role": {"deep": [{"text": 1}]}},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "tool", "value": "t"}], "source": "x"},
        {"role": "user", "content": "c"},
        {"question": "q", "answer": "a"},
        {"prompt": 5, "response": True},
    ]
    want = [
        [("user", "p"), ("assistant", "r")],
        [("user", "p"), ("assistant", "c")],
        [("system", "s"), ("user", "p"), ("assistant", "")],
        [("user", "i"), ("assistant", "o")],
        [("user", "i\n\nn"), ("assistant", "o")],
        [("user", "i"), ("assistant", "o")],
        [("user", "u"), ("assistant", "a")],
        [("user", "h"), ("assistant", "g"), ("tool", "t")],
        [("user", "c")],
        [("user", "q"), ("assistant", "a")],
        [("user", "5"), ("assistant", "true")],
    ]
    odd = [{"body": "x", "n": {"a": 1}}, {"prompt": "alone"}, [1, 2], 5]
    lines = [(k, 0, json.dumps(r)) for k, r in enumerate(records)] + [(100 + k, 0, json.dumps(r)) for k, r in enumerate(odd)] + [(200, 0, None), (201, 0, "{broken")]
    table = spark.createDataFrame(lines, "conv_id long, turn long, record string")
    got = {}
    for r in chatformat.canonical_turns(table).orderBy("conv_id", "turn", "part").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == dict(enumerate(want))
    unknown = {r["paths"]: r["n"] for r in chatformat.unknown_layouts(table).collect()}
    assert unknown == {"body, n.a": 1, "prompt": 1, "": 4}
    assert [r[0] for r in table.select(chatformat.field_paths(F.parse_json("record"))).where("conv_id IN (1, 7)").collect()] == [["completion", "meta.score", "meta.tags", "prompt"], ["conversations[].from", "conversations[].value", "source"]]
    assert table.select(chatformat.field_paths(F.parse_json("record"))).where("conv_id = 6").first()[0] == ["messages[].calls", "messages[].content", "messages[].role", "messages[].weight", "role.deep"]


# clustering


def plain_clusters(rows, k, rounds, scale=256, seed=2):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [x for _, x in first]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min(range(len(centres)), key=lambda c: (far(x, centres[c]), c))
    for _ in range(rounds):
        own = [near(x) for _, x in kept]
        for c in range(len(centres)):
            if mine := [x for (_, x), o in zip(kept, own) if o == c]:
                centres[c] = [sum(z) // len(mine) for z in zip(*mine)]
    return sorted(((i, c := near(x), far(x, centres[c])) for i, x in kept), key=repr), centres


@pytest.mark.parametrize("dims, spread", [(3, 0.01), (8, 1.0), (64, 1.0), (2, 30_000.0)])
def test_clusters_by_plain_python(spark, dims, spread):
    rng = np.random.default_rng(dims)
    good = [(int(i), [float(x) for x in rng.normal(size=dims).astype(np.float32) * np.float32(spread)]) for i in range(150)]
    good += [(200 + i, good[3][1]) for i in range(30)] + [(7, good[7][1]), (8, good[9][1]), (None, good[1][1])]
    odd = [(300, None), (301, []), (302, [1.0] * (dims + 1)), (303, [float("nan")] * dims), (304, [float("-inf")] * dims), (305, [None] * dims)]
    table = spark.createDataFrame([(v, 5, i, "x", 1) for i, v in good + odd], "embedding array<float>, cluster int, vec_id long, far string, n long").repartition(6)
    rows, centres, share = ptolemaic.clusters(table, k=12, rounds=4, dims=dims)
    want, centroids = plain_clusters(good, 12, 4)
    assert sorted((tuple(r) for r in rows.collect()), key=repr) == want and centres == centroids
    assert 0 < share < 1.2
    report = ptolemaic.cluster_report(table, k=12, rounds=4, dims=dims).collect()
    total = sum(d for _, _, d in want)
    assert all(r["inertia"] == total and r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) for r in report)


def test_clusters_of_few_or_no_vectors(spark):
    table = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    rows, centres, _ = ptolemaic.clusters(table, dims=2)
    assert {r["cluster"] for r in rows.collect()} == {0} and centres == [[128, 128]] * 2
    assert ptolemaic.cluster_report(table, dims=64).count() == 0
    assert ptolemaic.cluster_report(table.limit(0), dims=2).columns == ptolemaic.cluster_report(table, dims=2).columns
    with pytest.raises(Exception, match="63 bits"):
        ptolemaic.cluster_report(table.union(spark.createDataFrame([(3, [1e30, 0.0])], table.schema)), dims=2).count()


def test_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(0)
    for scale in (3, 300, 1 << 22):
        x, c, p = (rng.integers(-scale, scale + 1, (n, 5)) for n in (300, 40, 6))
        p = ptolemaic.far_apart(p, 6)
        exact = ptolemaic.squared(x, c)
        low = ptolemaic.lower_bounds(np.sqrt(ptolemaic.squared(x, p)), np.sqrt(ptolemaic.squared(c, p)), np.sqrt(ptolemaic.squared(p, p)))
        assert (low**2 * (1 - ptolemaic._SLACK) <= exact).all() and (low**2 > exact / 4).any()
        near, far, _ = ptolemaic.nearest_centroid(x, np.sqrt(ptolemaic.squared(x, p)), c, p)
        assert (near == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
