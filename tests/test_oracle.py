"""Every query with SQL against DuckDB, on the smallest tables."""

import math
from decimal import Decimal
from datetime import datetime

import duckdb
import pytest

from quern.jobs import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_keywords_of_whole_documents(spark, duck):
    """Against Python's own expressions over all documents."""
    import re

    from quern.functions import lexicon as L

    def plain(text):
        unit = lambda u: re.sub("^°", r"°?\\s*", re.sub("(?i)^(month|year|day|hour|minute|second)s?$", r"\1s?", u))
        dots = lambda x: x.replace(".", r"\.")
        found = [dots(n) + r"\s*" + unit(u) for n, u in re.findall(L.NUMBER_UNIT, text, re.I)] + [dots(m) for m in re.findall(L.CODE_OR_VERSION, text)]
        return list(dict.fromkeys(found or re.findall(L.RARE_TOKEN, text)))[:3]

    got = {r["doc_id"]: r["found"] for r in registry.queries()["suggest_keywords"](spark, FOLDER).collect()}
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    assert got == {i: " | ".join(plain(t)) for i, t in rows}
    assert sum(map(bool, got.values())) > 5


def test_chunks_of_whole_documents_by_recursion(spark, duck):
    """chunk_recursive: pieces are parts of their text, small enough, begin in order, and hold all of its words."""
    from quern.operators.chunking import recursive_chunks

    pieces = {}
    for r in recursive_chunks(spark.read.parquet(f"{FOLDER}/documents.parquet")).orderBy("doc_id", "chunk_no").collect():
        pieces.setdefault(r["doc_id"], []).append(r["text"])
    for i, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        own, at = pieces.get(i, []), 0
        for p in own:
            at = text.find(p, at)
            assert len(p) <= 1000 and at >= 0
        assert {w for p in own for w in p.split()} >= {w for w in text.split() if w.isalpha()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).take(1)) == 1
