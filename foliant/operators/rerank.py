"""Reranking of a pool of candidates by a pluggable scorer of (query, text) pairs."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms
from .common import ranked

BATCH = 32


class Reranker(Protocol):
    def rerank(self, query: str, texts: list[str]) -> np.ndarray: ...


class OverlapReranker:
    """Share of the query's distinct words that the text has."""

    def rerank(self, query: str, texts: list[str]) -> np.ndarray:
        own = set(query.lower().split())
        return np.array([len(own & set(t.lower().split())) / max(1, len(own)) for t in texts])


def yes_probability(no: np.ndarray, yes: np.ndarray) -> np.ndarray:
    """Softmax over the two logits that a cross-encoder gives for no and yes."""
    return 1 / (1 + np.exp(np.clip(np.asarray(no, np.float64) - np.asarray(yes, np.float64), -700, 700)))


def rerank(pool: DataFrame, reranker: Reranker, k: int | None = None) -> DataFrame:
    """Columns query_id, id, score, rank from a pool (query_id, query, id, text, rank); equal scores keep the pool's order."""
    own = pool.select("query_id", "query", "id", "text", F.col("rank").alias("pool_rank"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}

    def run(batches):
        for b in batches:
            queries, texts, scores = b.column(1).to_pylist(), b.column(3).to_pylist(), []
            start = 0
            while start < len(queries):  # a model gets runs of one query
                end = start
                while end < len(queries) and end - start < BATCH and queries[end] == queries[start]:
                    end += 1
                scores += [float(x) for x in reranker.rerank(queries[start] or "", [t or "" for t in texts[start:end]])]
                start = end
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(4), pa.array(scores, pa.float64())], names=["query_id", "id", "pool_rank", "score"])

    scored = own.mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, pool_rank int, score double")
    return ranked(scored, ["query_id"], [F.desc("score"), F.col("pool_rank")], k).drop("pool_rank")


def overlap_scores(pool: DataFrame) -> DataFrame:
    """``pool`` with ``score``: the share of the query's distinct terms that the text has; in the JVM."""
    q, t = F.array_distinct(terms(F.col("query"))), F.array_distinct(terms(F.col("text")))
    return pool.withColumn("score", F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)))
