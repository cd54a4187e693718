"""The lexical search at size: what is shuffled, equal results by both ways, packed postings, runs of words."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import lexical, postings
from foliant.operators.lexical import LexicalIndex, post, search_frame, search_weights, tokenised
from foliant.plans import queries as plans

#: Queries whose growth was found too steep.
FOUND = [
    "title_weight_sweep", "rrf_weight_sweep", "eval_by_group", "rrf_weighted", "rrf_fusion", "eval_misses", "hits_hydrated", "eval_summary", "eval_first_rank", "answer_prompt", "bm25_topk", "hybrid_search", "rerank_model", "rerank_topk", "bm25_weighted_fields", "answer_citations",
]
WORDS = [f"w{i}" for i in range(60)]


def passages(spark, n=600, seed=5, ids=None):
    rng = random.Random(seed)
    some = lambda m: " ".join(rng.choices(WORDS, k=m))
    rows = [((ids or range(n))[i], some(3) if i % 4 else None, some(rng.randint(0, 90)), rng.choice(["a", "b", None])) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, title string, text string, kind string").repartition(3).cache()


def asked(spark, n, m=6, seed=8):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(rng.sample(WORDS[:30], m))) for i in range(n)], "query_id bigint, query string")


def shuffled(spark) -> int:
    """Bytes that all tasks so far have written for a shuffle."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def cost(spark, run) -> int:
    before = shuffled(spark)
    run()
    return shuffled(spark) - before


def hits(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())


def test_no_row_of_a_query_and_a_passage_is_shuffled(spark):
    """400 queries of common words, of which few passages hold all: by joins each passage met each query that it shares a word with."""
    df, many = passages(spark), asked(spark, 400, 25)
    assert len(hits(search_frame(df, many, "id", "text", 5))) < 100
    assert cost(spark, lambda: search_frame(df, many, "id", "text", 5).collect()) < 100_000


def test_index_search_gathers_each_posting_once(spark, tmp_path):
    """What a search shuffles doesn't grow with the queries that share a word."""
    index, one, many = LexicalIndex.build(passages(spark), "id", "text").write(str(tmp_path)), asked(spark, 40, 25), asked(spark, 800, 25)
    one.count(), many.count()
    assert cost(spark, lambda: index.search(many, 5).collect()) < 2 * cost(spark, lambda: index.search(one, 5).collect())


def test_index_shuffles_packed_postings(spark, tmp_path):
    df = passages(spark, 2000)
    n = post(tokenised(df, "id", "text", F.col("title"))).count()
    assert cost(spark, lambda: LexicalIndex.build(df, "id", "text", F.col("title"), F.col("kind")).write(str(tmp_path))) < 14 * n


@pytest.mark.parametrize("category", [None, "a"])
def test_joins_give_the_same(spark, tmp_path, monkeypatch, category):
    df, queries = passages(spark), asked(spark, 40, 2).unionByName(spark.createDataFrame([(90, "w1 w1"), (91, "w2 none"), (92, ""), (None, "w3 w4 w5")], "query_id bigint, query string"))
    built = LexicalIndex.build(df, "id", "text", F.col("title"), F.col("kind"))
    run = lambda: [hits(x.fillna(-1, ["query_id"])) for x in (search_frame(df, queries, "id", "text", 7, F.col("title"), F.col("kind"), category), built.search(queries, 7, category), LexicalIndex.read(spark, str(tmp_path)).search(queries, 7, category))]
    built.write(str(tmp_path))
    narrow = run()
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    joined = run()
    assert narrow == joined and narrow[0] == narrow[1] == narrow[2] and len(narrow[0]) > 100


def test_ids_that_repeat_go_by_joins(spark, tmp_path):
    """Equal rows of one id count as one passage, as by the joins."""
    rows = [(1, "x y"), (1, "x y"), (2, "x"), (3, "z z z")]
    df, queries = spark.createDataFrame(rows, "id bigint, text string"), spark.createDataFrame([(7, "x")], "query_id bigint, query string")
    docs = tokenised(df, "id", "text")
    want = {(r.id, r.n_text) for r in post(docs).filter("term = 'x'").collect()}
    index = LexicalIndex.build(df, "id", "text").write(str(tmp_path))
    assert {(r.id, r.n_text) for r in index.postings.filter("term = 'x'").collect()} == want == {(1, 2), (2, 1)}
    assert [r.id for r in search_frame(df, queries, "id", "text").collect()] == [1, 2]
    twice = queries.union(queries)
    assert search_frame(df, twice, "id", "text").count() == 0  # neither has as many phrases as its id


def test_weights_at_once(spark):
    df, queries, grid = passages(spark), asked(spark, 30, 2), [(10.0, 1.0), (1.0, 1.0), (0.5, 3.0)]
    both = search_weights(df, queries, "id", "text", grid, 9, F.col("title"))
    for i, (a, b) in enumerate(grid):
        assert hits(both.filter(F.col("of") == i)) == hits(search_frame(df, queries, "id", "text", 9, F.col("title"), title_weight=a, text_weight=b)) != []


@pytest.mark.parametrize("name", FOUND)
def test_query_shuffles_little(spark, name):
    """No words, nor rows of a query and a passage that it doesn't match, are shuffled."""
    sf = "/root/testdata/sf0.01"
    text = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    assert cost(spark, lambda: plans.QUERIES[name](spark, sf).collect()) < 0.25 * text


def test_written_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT", 50)
    df = passages(spark, 300)
    built = LexicalIndex.build(df, "id", "text", F.col("title"), F.col("kind"))
    index, own = built.write(str(tmp_path)), lambda x: sorted(map(str, x.collect()))
    names = built.postings.columns
    assert own(index.postings.select(names)) == own(built.postings) and index.postings.select(names).dtypes == built.postings.dtypes
    assert own(index.terms) == own(built.terms) and own(index.stats) == own(built.stats)
    again = index.write(str(tmp_path / "again"))
    assert own(again.postings.select(names)) == own(built.postings)


def test_string_ids_and_nothing(spark, tmp_path):
    df = passages(spark, 40).withColumn("id", F.concat(F.lit("é"), F.col("id").cast("string")))
    built = LexicalIndex.build(df, "id", "text")
    assert sorted(map(str, built.write(str(tmp_path / "a")).postings.select(built.postings.columns).collect())) == sorted(map(str, built.postings.collect()))
    none = LexicalIndex.build(df.limit(0), "id", "text").write(str(tmp_path / "b"))
    assert none.postings.count() == 0 and none.search(asked(spark, 3), 5).collect() == []


def test_runs_held(spark, monkeypatch):
    rng = random.Random(2)
    texts = [rng.choices("abcd", k=rng.randint(0, 60)) for _ in range(80)]
    items = [rng.choices("abcde", k=k) for k in (1, 3, 5, 8, 9, 20)] + [["q"] * 3, texts[5][:8]]
    want = {(i, f"u{d}") for i, x in enumerate(items) for d, t in enumerate(texts) for m in [min(8, len(x))] for j in range(len(x) - m + 1) if m and any(t[p : p + m] == x[j : j + m] for p in range(len(t) - m + 1))}
    docs = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "url string, w array<string>").repartition(3)
    asked = spark.createDataFrame(list(enumerate(items)), "item_id bigint, w array<string>").filter(F.size("w") > 0)
    assert {tuple(r) for r in plans._truth(docs, asked).collect()} == want and len(want) > 50
    monkeypatch.setattr(plans, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in plans._truth(docs, asked).collect()} == want
    assert plans._truth(docs, asked.limit(0)).collect() == []


def test_truth_explodes_no_runs(spark, sf):
    plan = plans._truth(spark.createDataFrame([], "url string, w array<string>"), spark.createDataFrame([(1, ["a"])], "item_id bigint, w array<string>"))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_batches_are_cut_by_their_words():
    """Else a batch of 10,000 passages becomes arrays of all its words at once."""
    import pyarrow as pa

    lists = [["a"] * n for n in (5, 0, 3, 9, 1, 1, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists, pa.list_(pa.string())), pa.array(lists[::-1], pa.list_(pa.string()))], names=["id", "a", "b"])
    got = list(postings.cut([batch.slice(0, 0), batch, batch.slice(2, 4)], 1, 2, limit=8))
    assert [i for b in got for i in b.column(0).to_pylist()] == [*range(7), 2, 3, 4, 5]
    assert all(b.num_rows == 1 or sum(map(len, b.column(1).to_pylist() + b.column(2).to_pylist())) <= 8 for b in got) and len(got) > 5
