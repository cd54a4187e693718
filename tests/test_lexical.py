"""BM25 against the one in the standard library's sqlite3."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from foliant.operators.lexical import LexicalIndex, search_frame

CHUNKS = "chunk_id string, heading_path array<string>, text string, category string"
VOCAB = "fireball Café café CAFE psionic aboleth-psionic foo_bar foo bar ½ straße x² the move attack don't".split()


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    some = lambda m: " ".join(rng.choice(VOCAB) for _ in range(rng.randint(0, m)))
    return [(f"c{i:03d}", [some(3), "Sub"] if i % 4 else None, some(25), rng.choice(["spells", "traps"])) for i in range(n)]


def fts(rows, query, hyphen, weights, category=None):
    con = sqlite3.connect(":memory:")
    tokenize = "unicode61 tokenchars '-'" if hyphen else "unicode61"
    con.execute(f'CREATE VIRTUAL TABLE t USING fts5(chunk_id UNINDEXED, title, text, category UNINDEXED, tokenize="{tokenize}")')
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, p[0] if p else "", t, c) for i, p, t, c in rows])
    import re

    words = re.findall(r"[\w-]+" if hyphen else r"\w+", query)
    if not words:
        return []
    match = " ".join(f'"{w}"' for w in words)
    more = " AND category = ?" if category else ""
    return con.execute(f"SELECT chunk_id, bm25(t, 0, {weights[0]}, {weights[1]}, 0) AS s FROM t WHERE t MATCH ?{more} ORDER BY s, chunk_id", (match, *([category] if category else []))).fetchall()


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(corpus(), CHUNKS).repartition(3)


def title():
    return F.coalesce(F.get("heading_path", F.lit(0)), F.lit(""))


ASKED = ["fireball", "cafe", "fireball the", "foo_bar", "foo bar", "aboleth-psionic", "the the", "missing the", "_", "_ the", "???", "", "OR AND", "½", "straße move", 'NOT "x²"', "psionic", "-"]


@pytest.mark.parametrize("hyphen", [False, True])
def test_against_fts(spark, frame, hyphen):
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id bigint, query string")
    index = LexicalIndex.build(frame, "chunk_id", "text", title(), F.col("category"), hyphen)
    for found in (index.search(queries, None, None, 10.0, 1.0), search_frame(frame, queries, "chunk_id", "text", None, title(), F.col("category"), None, hyphen, 10.0, 1.0)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.score))
        for i, q in enumerate(ASKED):
            want = fts(corpus(), q, hyphen, (10.0, 1.0))
            assert dict(got.get(i, [])) == pytest.approx(dict(want), rel=1e-9), q


def test_category_keeps_statistics(spark, frame, tmp_path):
    queries = spark.createDataFrame([(1, "fireball the")], "query_id bigint, query string")
    index = LexicalIndex.build(frame, "chunk_id", "text", title(), F.col("category")).write(str(tmp_path))
    got = {r.id: r.score for r in index.search(queries, 100, "traps").collect()}
    assert got == pytest.approx(dict(fts(corpus(), "fireball the", False, (10.0, 1.0), "traps")))


def test_weights_turn_the_order(spark):
    rows = [("a", ["fireball"], "x y", "c"), ("b", ["y"], "fireball fireball", "c"), *[(f"z{i}", ["q"], "w w", "c") for i in range(5)]]
    df = spark.createDataFrame(rows, CHUNKS)
    queries = spark.createDataFrame([(1, "fireball")], "query_id bigint, query string")
    first = lambda a, b: search_frame(df, queries, "chunk_id", "text", 1, title(), title_weight=a, text_weight=b).first().id
    assert first(1000.0, 1.0) == "a" and first(1.0, 1000.0) == "b"


def test_nulls_and_empty(spark):
    queries = spark.createDataFrame([(1, None), (2, "x")], "query_id bigint, query string")
    df = spark.createDataFrame([("a", None, None, None)], CHUNKS)
    assert search_frame(df, queries, "chunk_id", "text").collect() == []
    assert search_frame(df.limit(0), queries, "chunk_id", "text").collect() == []
    assert search_frame(df, queries.limit(0), "chunk_id", "text").collect() == []
