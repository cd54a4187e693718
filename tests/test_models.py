"""Models that are loaded on workers: once, and with typed failures."""

import numpy as np
import public_tokenizers
import pytest

from foliant.errors import ModelUnavailable
from foliant.operators import models
from foliant.operators.chunking import chunk_articles
from foliant.operators.embedding import HashingEmbedder, embed_column
from foliant.operators.rerank import rerank


def test_loaded_once_and_typed():
    calls = []
    for _ in range(3):
        assert models.loaded("a tide table", lambda: calls.append(1) or "table") == "table"
    assert len(calls) == 1
    with pytest.raises(ModelUnavailable, match="can't be loaded"):
        models.FileTokenizer("/no/such/file.json").encode("x")
    assert ModelUnavailable.category == "retryable"


def test_tokenizer_file_packs_passages(spark):
    tok = models.FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [("a", "Tides", "sea", "The moon draws the water. " * 40)]
    got = chunk_articles(spark.createDataFrame(rows, "doc_id string, title string, category string, body_md string"), tok, max_tokens=60, overlap=10).collect()
    assert len(got) > 3 and all(r.n_tokens <= 61 and r.n_tokens == len(tok.encode(r.text)) for r in got)


def test_embedder_on_workers(spark):
    df = spark.createDataFrame([("one tide",), ("two tides",)], "text string")
    plain = embed_column(df, HashingEmbedder(16), ["text"]).collect()
    lazy = embed_column(df, models.LoadedEmbedder("hash16", 16, lambda: HashingEmbedder(16)), ["text"]).collect()
    assert [r.embedding for r in plain] == [r.embedding for r in lazy]

    class Broken:
        def embed(self, texts, task):
            raise RuntimeError("out of memory")

    with pytest.raises(ModelUnavailable, match="out of memory"):
        models.LoadedEmbedder("broken", 16, Broken).embed(["x"], "query")


def test_yes_no_reranker(spark):
    def make():
        return lambda pairs: np.array([[0.0, 3.0 if "<Document>: ebb" in p and p.startswith("<Instruct>: judge\n<Query>: tide") else -3.0] for p in pairs])

    pool = spark.createDataFrame([(1, "tide", 7, "flood", 1), (1, "tide", 8, "ebb", 2)], "query_id int, query string, id int, text string, rank int")
    got = rerank(pool, models.YesNoReranker("judge", "judge", make), 2).orderBy("rank").collect()
    assert [r.id for r in got] == [8, 7] and abs(got[0].score - 1 / (1 + np.exp(-3))) < 1e-9
