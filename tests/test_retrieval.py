"""Vectors, fusion, rerank, the search facade, widening and integrity."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.errors import BadRequest, BadVectors, CategoryDrift, DuplicateKey, ManifestMismatch, OrphanChunks, StaleIndex
from foliant.operators import embedding, fusion, integrity, metrics, rerank, vector
from foliant.operators.lexical import LexicalIndex
from foliant.operators.search import Retriever
from foliant.settings import AgentSettings, RetrievalSettings
from foliant.sources import runs

VECTORS = "id string, category string, embedding array<float>"


def asked(spark, *vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id bigint, vector array<double>")


def ids(df):
    return [(r.query_id, r.id) for r in df.orderBy("query_id", "rank").collect()]


def test_cosine_order_and_category(spark):
    v = spark.createDataFrame([("alpha", "b", [1.0, 0.0]), ("beta", "b", [0.9, 0.1]), ("gamma", "f", [0.0, 1.0])], VECTORS)
    assert ids(vector.search(v, asked(spark, [1, 0]), 3)) == [(0, "alpha"), (0, "beta"), (0, "gamma")]
    assert ids(vector.search(v, asked(spark, [1, 0]), 10, category_col="category", category="f")) == [(0, "gamma")]
    assert ids(vector.search(v, asked(spark, [2, 0]), 1)) == [(0, "alpha")]
    assert vector.search(v, asked(spark), 3).collect() == [] and vector.search(v.limit(0), asked(spark, [1, 0]), 3).collect() == []


def test_ties_come_in_id_order_and_blocks_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(f"{i:03d}", "c", [1.0, 0.0] if i % 2 else [float(x) for x in rng.normal(size=2)]) for i in range(200)]
    v = spark.createDataFrame(rows, VECTORS).repartition(5)
    queries = asked(spark, [1, 0], [0, 1], [1, 1])
    got = vector.search(v, queries, 7)
    assert [i for q, i in ids(got) if q == 0] == [f"{i:03d}" for i in range(1, 15, 2)]
    exact = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())
    assert exact(got) == exact(vector.search(v, queries, 7, block=1))
    units = {i: np.array(e) / np.linalg.norm(e) for i, _, e in rows}
    q = np.array([1, 1]) / math.sqrt(2)
    assert [i for k, i in ids(got) if k == 2] == sorted(units, key=lambda i: (-round(float(units[i] @ q), 12), i))[:7]


@pytest.mark.parametrize("bad", [[float("nan"), 1.0], [float("inf"), 1.0], [0.0, 0.0], None])
def test_bad_vectors(spark, bad):
    v = spark.createDataFrame([("a", "c", [1.0, 0.0]), ("b", "c", bad)], VECTORS)
    with pytest.raises(BadVectors, match="b"):
        vector.search(v, asked(spark, [1, 0]))
    assert ids(vector.search(v, asked(spark, [1, 0]), strict=False)) == [(0, "a")]
    assert [r.id for r in vector.faults(v).collect()] == ["b"]
    with pytest.raises(BadVectors):
        vector.search(v, asked(spark, [0, 0]))


def ranking(spark, rows):
    return spark.createDataFrame([(1, i, r) for r, i in enumerate(rows, 1)], "query_id bigint, id string, rank int")


def test_fusion(spark):
    one = fusion.fuse({"vector": ranking(spark, "ab")}).orderBy("rank").collect()
    assert [(r.id, r.score) for r in one] == [("a", 1 / 61), ("b", 1 / 62)]
    both = fusion.fuse({"vector": ranking(spark, "ab"), "bm25": ranking(spark, "ac")}).orderBy("rank").collect()
    assert both[0].id == "a" and both[0].score == pytest.approx(2 / 61) and {r.id for r in both} == set("abc")
    tie = fusion.fuse({"vector": ranking(spark, "ab"), "bm25": ranking(spark, "ba")}).orderBy("rank").collect()
    assert tie[0].score == tie[1].score and tie[0].id == "a"
    assert fusion.fuse({"vector": ranking(spark, "")}).collect() == []
    off = fusion.fuse({"vector": ranking(spark, "ab"), "bm25": ranking(spark, "c")}, {"bm25": 0.0}).orderBy("rank").collect()
    assert [(r.id, r.score) for r in off] == [("a", 1 / 61), ("b", 1 / 62), ("c", 0.0)]
    flip = {"vector": ranking(spark, "a"), "bm25": ranking(spark, "b")}
    assert fusion.fuse(flip, {"bm25": 10.0}).orderBy("rank").first().id == "b"
    assert fusion.fuse(flip, {"vector": 10.0}, k=1).collect()[0].id == "a"
    assert fusion.fuse({"vector": ranking(spark, "a")}, rrf_k=0).first().score == 1.0


def test_rerank(spark):
    rows = [(1, "a b", "x", "nothing here", 1), (1, "a b", "y", "b only", 2), (1, "a b", "z", "A B", 3), (1, "a b", "w", "also b", 4)]
    pool = spark.createDataFrame(rows, "query_id bigint, query string, id string, text string, rank int")
    assert [i for _, i in ids(rerank.rerank(pool, rerank.OverlapReranker()))] == ["z", "y", "w", "x"]
    assert [i for _, i in ids(rerank.rerank(pool, rerank.OverlapReranker(), 2))] == ["z", "y"]
    assert rerank.yes_probability(0.0, 0.0) == 0.5
    assert [r.score for r in rerank.overlap_scores(pool).orderBy("id").collect()] == [0.5, 0.0, 0.5, 1.0]


def test_embedder(spark):
    df = spark.createDataFrame([("a", "x", None), (None, "", "y z")], "id string, p string, q string")
    got = embedding.embed_column(df, embedding.HashingEmbedder(16), ["p", "q"]).collect()
    assert [len(r.embedding) for r in got] == [16, 16] and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in got)
    assert np.allclose(got[0].embedding, embedding.HashingEmbedder(16).embed(["x"], "document")[0])
    assert embedding.embed_column(df.limit(0), embedding.HashingEmbedder(16), ["p"]).collect() == []
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "id string, embedding array<double>")
    check = embedding.similarity_check(v, spark.createDataFrame([("a", "b", 0.707), ("a", "a", 0.5)], "a string, b string, score double"))
    assert sorted(r.ok for r in check.collect()) == [False, True]


CHUNKS = "chunk_id string, doc_id string, ordinal int, heading_path array<string>, text string, category string, n_tokens int, embedding array<float>"
ARTICLES = "doc_id string, url string, title string, category string, breadcrumb array<string>, body_md string, n_chars int"


class Fixed:
    """An embedder whose queries are all [1, 0]."""

    dim = 2

    def embed(self, texts, task):
        return np.array([[1.0, 0.0]] * len(texts), np.float32)


def library(spark, **settings_):
    rows = [(n.lower(), n, c, v) for n, c, v in (("Alpha", "bestiary", [1.0, 0.0]), ("Beta", "bestiary", [0.9, 0.1]), ("Gamma", "feats", [0.0, 1.0]))]
    chunks = spark.createDataFrame([(f"{i}#000", i, 0, [n], f"Text {i}", c, 10, v) for i, n, c, v in rows], CHUNKS)
    articles = spark.createDataFrame([(i, f"https://example.com/{i}", n, c, [], f"Body of {i}", 100) for i, n, c, _ in rows], ARTICLES)
    full = integrity.with_articles(chunks, articles)
    index = LexicalIndex.build(full, "chunk_id", "text", F.get("heading_path", F.lit(0)), F.col("category"))
    return Retriever(full, index, Fixed(), rerank.OverlapReranker(), RetrievalSettings(**settings_)), chunks, articles


def found(spark, retriever, query, **options):
    got = retriever.search(spark.createDataFrame([(1, query)], "query_id bigint, query string"), **options).orderBy("rank").collect()
    return [r.chunk_id[:-4] for r in got]


def test_search(spark):
    r, chunks, articles = library(spark, rrf_vector_weight=1.0)
    assert found(spark, r, "gamma", method="vector") == ["alpha", "beta", "gamma"]
    assert found(spark, r, "gamma", method="vector", category="feats", k=10) == ["gamma"]
    assert found(spark, r, "gamma", method="bm25") == ["gamma"]
    assert found(spark, r, "gamma")[0] == "gamma"
    assert found(spark, library(spark, rrf_vector_weight=50.0)[0], "gamma")[0] == "alpha"
    assert found(spark, r, "text gamma", k=1, rerank=True, fetch_k=3) == ["gamma"]
    hit = r.search(spark.createDataFrame([(1, "gamma")], "query_id bigint, query string"), method="bm25").first()
    assert (hit.url, hit.title, hit.full_article_length) == ("https://example.com/gamma", "Gamma", 100) and "embedding" not in hit.asDict()
    assert r.article("beta#000", articles).first().body_md == "Body of beta" and r.article("none", articles).collect() == []
    assert r.chunk_text("beta#000") == "Text beta" and r.chunk_text("none") is None


def test_serve(spark):
    r, *_ = library(spark)
    rows = [(1, "gamma", None, None), (2, "gamma", 5, "feats"), (3, "x", 5, None), (4, "gamma", 99, None), (5, "gamma", 5, "none")]
    got = r.serve(spark.createDataFrame(rows, "query_id bigint, query string, k int, category string"), ["bestiary", "feats"]).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.title) for x in got if x.query_id == 2] == [(2, "Gamma")] and len([x for x in got if x.query_id == 1]) == 3
    assert [(x.query_id, x.error_category) for x in got if x.query_id > 2] == [(3, "rephrase"), (4, "rephrase"), (5, "rephrase")]


def test_bad_requests(spark):
    r, *_ = library(spark)
    queries = spark.createDataFrame([(1, "x")], "query_id bigint, query string")
    for bad in (lambda: Retriever(r.chunks).search(queries, method="bm25"), lambda: Retriever(r.chunks).search(queries, method="vector"), lambda: r.search(queries, method="other"), lambda: Retriever(r.chunks, r.index, Fixed()).search(queries, rerank=True)):
        with pytest.raises(BadRequest):
            bad()


class Counting(Retriever):
    def search(self, queries, k=None, method="hybrid", category=None, rerank=False, fetch_k=None):
        self.fetched = [*getattr(self, "fetched", []), k]
        return super().search(queries, k, method, category, rerank, fetch_k)


def crowd(spark, docs):
    chunks = spark.createDataFrame([(f"{i:03d}", d, 0, ["T"], t, "c", 1, [x, 1.0]) for i, (d, t, x) in enumerate(docs)], CHUNKS)
    full = chunks.withColumn("url", F.concat(F.lit("https://e.com/"), "doc_id")).withColumn("title", F.lit("T")).withColumn("full_article_length", F.lit(1))
    return Counting(full, LexicalIndex.build(full, "chunk_id", "text"), Fixed())


def test_widening(spark):
    queries = spark.createDataFrame([(1, "hit")], "query_id bigint, query string")
    r = crowd(spark, [(f"d{i}", "filler", 0.0) for i in range(100)])
    assert r.top_documents(queries, 5, "bm25").collect() == [] and r.fetched == [25]
    r = crowd(spark, [("same", "hit", 0.0)] * 25 + [(f"d{i}", "filler", 0.0) for i in range(75)])
    assert [x.doc_id for x in r.top_documents(queries, 5, "bm25").collect()] == ["same"] and r.fetched == [25, 50]
    r = crowd(spark, [("dup", "x", 9.0)] * 10 + [(f"doc{i}", "x", 5.0 - i / 10) for i in range(10)])
    assert [x.doc_id for x in r.top_documents(queries, 2, "vector").orderBy("rank").collect()] == ["dup", "doc0"] and r.fetched == [10, 20]


def test_integrity(spark, tmp_path):
    r, chunks, articles = library(spark)
    with pytest.raises(OrphanChunks, match="gamma"):
        integrity.with_articles(chunks, articles.filter("doc_id <> 'gamma'"))
    with pytest.raises(DuplicateKey):
        integrity.with_articles(chunks, articles.union(articles))
    with pytest.raises(StaleIndex):
        integrity.check_index(chunks.filter("doc_id <> 'beta'"), r.index.postings)
    integrity.check_index(chunks, r.index.postings)
    assert integrity.check_categories(chunks, ["feats"]) == ["bestiary"]
    with pytest.raises(CategoryDrift):
        integrity.check_categories(chunks, ["feats", "none"])
    assert {(x.doc_id, x.side) for x in integrity.drift(chunks.filter("doc_id <> 'beta'"), articles.filter("doc_id <> 'alpha'"), "doc_id").collect()} == {("alpha", "left"), ("beta", "right")}
    m = integrity.manifest(spark, articles, chunks, 450, 50, "words", "hashing", 2)
    runs.write_manifest(m, f"{tmp_path}/m")
    stored = runs.read_manifest(spark, f"{tmp_path}/m")
    integrity.check_manifest(stored, articles.repartition(3), "hashing", 2)
    for bad in ((articles, "other", 2), (articles, "hashing", 3), (articles.limit(2), "hashing", 2)):
        with pytest.raises(ManifestMismatch):
            integrity.check_manifest(stored, *bad)
    m.withColumn("more", F.lit(1)).write.json(f"{tmp_path}/old")
    with pytest.raises(ManifestMismatch):
        runs.read_manifest(spark, f"{tmp_path}/old")


def test_settings():
    s = RetrievalSettings.from_env("RAG_", {"RAG_SEARCH_K": "7", "RAG_HYPHEN_TOKENS": "true", "RAG_TITLE_WEIGHT": "2.5"})
    assert (s.search_k, s.hyphen_tokens, s.title_weight, s.rrf_k) == (7, True, 2.5, 60)
    with pytest.raises(ValueError):
        AgentSettings(max_iterations=-1)


RESULTS = "query_id bigint, query string, type string, expected_urls array<string>"


def evaluated(spark):
    queries = spark.createDataFrame([(1, "a", "exact_name", ["https://E.com/x/1/"]), (2, "b", "paraphrase", ["https://e.com/y/2", "https://e.com/y/3"]), (3, "c", "paraphrase", ["https://e.com/x/9"])], RESULTS)
    hits = spark.createDataFrame([(1, 1, "https://e.com/x/0"), (1, 2, "HTTPS://e.com/x/1?q#f"), (2, 1, "https://e.com/y/3/"), (2, 4, "https://e.com/y/2"), (3, 1, "https://e.com/X/9")], "query_id bigint, rank int, url string")
    return metrics.first_hits(queries, hits), hits


def test_metrics(spark):
    results, hits = evaluated(spark)
    assert [(r.rank, r.reciprocal_rank) for r in results.orderBy("query_id").collect()] == [(2, 0.5), (1, 1.0), (None, 0.0)]
    s = metrics.summarise(results, 5).first()
    assert (s.n_queries, s.recall_at_1, s.recall_at_3, s.mrr) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(0.5)) and "recall_at_20" not in s.asDict()
    groups = {(r.grouping, r.key): r.n_queries for r in metrics.evaluate(results).collect()}
    assert groups == {("overall", None): 3, ("type", "exact_name"): 1, ("type", "paraphrase"): 2, ("category", "x"): 2, ("category", "y"): 1}
    assert [(r.query_id, r.top_url) for r in metrics.misses(results, hits).collect()] == [(3, "https://e.com/X/9")]
    with pytest.raises(Exception, match="empty"):
        metrics.summarise(results.limit(0))
    line = metrics.summarise(results).select(metrics.summary_line().alias("x")).first().x
    assert line.startswith("n=3") and line.endswith("MRR 0.50")


def test_collapse(spark):
    _, hits = evaluated(spark)
    two = hits.unionByName(spark.createDataFrame([(1, 3, "https://e.com/x/0/")], hits.schema))
    got = metrics.collapse(two, 2).filter("query_id = 1").orderBy("rank").collect()
    assert [(r.rank, r.hit_rank) for r in got] == [(1, 1), (2, 2)]


@settings(max_examples=8, deadline=None)
@given(st.permutations("abcdef"), st.permutations("abcdef"))
def test_fusion_is_fair(spark, a, b):
    """Swapping equal lists changes no score; every id stays."""
    x = {r.id: r.score for r in fusion.fuse({"p": ranking(spark, a), "q": ranking(spark, b)}).collect()}
    y = {r.id: r.score for r in fusion.fuse({"p": ranking(spark, b), "q": ranking(spark, a)}).collect()}
    assert x == pytest.approx(y) and set(x) == set("abcdef")
