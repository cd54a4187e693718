"""Every operator on empty tables and on nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import bpe, langid, lattice, ordermin, perplexity, quality, quotes, substring, tokens, winnow

JSON, MODEL, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"))
LONG = "the quick brown fox jumps over the lazy dog and runs away from all of them again " * 3000
ROWS = [(1, "Hello world, this is a text.", "en"), (2, None, "en"), (3, "", "de"), (4, LONG, "en"), (5, "das ist ein Text und noch einer", "de"), (5, "das ist ein Text und noch einer", "de"), (6, " \n\t ", None), (None, "no id here at all", "en"), (7, "12345 !!", "fr"), (8, "tie one two three", None), (9, "tie one two three", None)]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for name in ("id", "node", "bucket", "chunk", "own", "w", "h", "payload", "class_id", "n_words", "key", "__id", "__kept", "__f_id", "__f_own", "hit_id", "hit_own", "kept_own", "f_id", "hash", "label"):
        df = df.withColumn(name, F.lit("x"))
    return df


def benchmark(spark, rows=((1, "das ist ein Text und noch einer"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def labels(spark, rows=((1, 1), (5, 0), (8, None), (None, 1), (7, 1), (4, 0))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int")


OPS = {
    "winnow": lambda s, d: winnow.contamination(d, benchmark(s)),
    "tokens": lambda s, d: tokens.token_counts(d, JSON),
    "langid": lambda s, d: langid.predict_languages(d, langid.fit(d)),
    "bpe": lambda s, d: bpe.encode_documents(d, RANKS, public_tokenizers.PATTERN),
    "perplexity": lambda s, d: perplexity.quality_rules(d),
    "lattice": lambda s, d: lattice.lattice_scores(d, MODEL),
    "quality": lambda s, d: quality.quality_scores(d, quality.fit(d, labels(s))),
    "substring": lambda s, d: substring.remove_repeats(d, keep_text=False),
    "ordermin": lambda s, d: ordermin.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPS)
def test_row_for_row(spark, name):
    got = OPS[name](spark, documents(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in ROWS)
    rows = {r.doc_id: r.asDict() for r in got}
    null = rows[2]
    if name in ("winnow", "substring", "perplexity"):
        assert null["n_words"] == 0 and rows[3]["n_words"] == 0 and rows[6]["n_words"] == 0
    if name in ("tokens", "bpe"):
        assert null["n_tokens"] == rows[3]["n_tokens"] == 0
    if name == "langid":
        assert null["lang_pred"] == rows[7]["lang_pred"] == "und" and null["score"] == 0
        assert all(0 <= r["score"] <= 1 for r in rows.values())
    if name == "lattice":
        assert null["n_tokens"] == rows[3]["n_tokens"] == 1
    if name == "quality":
        assert all(0 <= r["score"] <= 1 for r in rows.values())
    if name == "ordermin":
        assert rows[9]["class_id"] == rows[8]["class_id"] == 8 and null["class_id"] == 2
    if name == "winnow":
        assert rows[5]["contaminated"] and not rows[1]["contaminated"] and rows[5]["n_hit"] == 7
    if name == "substring":
        assert rows[4]["n_words"] == rows[4]["n_removed"] == len(LONG.split())


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](spark, documents(spark, [])).collect() == []


def test_stages_keep_all_columns(spark):
    docs = documents(spark).filter("doc_id is not null")
    model = langid.fit(docs)
    for out in (langid.keep_identified(docs, model), ordermin.keep_first(docs), substring.remove_repeats(docs), winnow.clean(docs, benchmark(spark))):
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} <= {i for i, _, _ in ROWS}


STAGES = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("rows", [[], [(i, t, lang, "s", len(t or "")) for i, t, lang in ROWS]])
def test_pipeline_edges(spark, tmp_path, rows):
    """The whole pipeline on an empty table, and on nulls, ties, repeated rows and clashing columns."""
    df = spark.createDataFrame(rows, STAGES).withColumn("hit_id", F.lit(1)).withColumn("Kept_own", F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert sorted(docs.columns) == sorted(df.columns)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted(r.doc_id or 0 for r in out)
    # 2, 3, 6, 7 have no letter, 9 is 8's copy, 5 holds the benchmark's item; the row without an id stays
    assert ids == ([0, 1, 4, 8] if rows else [])


def test_empty_benchmark_and_labels(spark):
    docs = documents(spark)
    assert not winnow.contamination(docs, benchmark(spark, [])).filter("contaminated").collect()
    got = quality.quality_scores(docs, quality.fit(docs, labels(spark, []))).collect()
    assert {r.score for r in got} == {0.5}


def test_quotes_edges(spark):
    rows = [(1, 0, "user", "a b"), (1, 1, "assistant", "> A  B\nyes"), (1, 1, "assistant", "> A  B\nyes"), (1, 2, "user", None), (None, 3, "user", "> a b"), (1, None, "user", "> a b"), (2, 0, "user", ""), (2, 1, None, ">\n> >\nx")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("own", F.lit(1)).withColumn("level", F.lit(2))
    got = quotes.link_quotes(df).collect()
    assert len(got) == len(rows)
    linked = [r for r in got if (r.conv_id, r.turn) == (1, 1)]
    assert [(r.parent_turn, r.thread_turn, r.depth, r.text) for r in linked] == [(0, 0, 1, "yes")] * 2
    assert next(r for r in got if (r.conv_id, r.turn) == (2, 1)).max_level == 0
    assert next(r for r in got if (r.conv_id, r.turn) == (1, 2)).text is None
    assert quotes.conversations(quotes.link_quotes(df.limit(0))).collect() == []
