"""Weighted reciprocal-rank fusion of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked

RRF_K = 60


def fuse(rankings: dict[str, DataFrame], weights: dict[str, float] | None = None, rrf_k: int = RRF_K, k: int | None = None) -> DataFrame:
    """Columns query_id, id, score, rank from rankings (query_id, id, rank).

    The score is the sum of weight / (rrf_k + rank) over the rankings that have the id; a missing weight is 1. Equal
    scores are in the order in which the rankings, one after the other, name the ids.
    """
    parts = []
    for i, (name, r) in enumerate(rankings.items()):
        weight = float((weights or {}).get(name, 1.0))
        parts.append(r.select("query_id", "id", F.struct(F.lit(i).alias("of"), F.col("rank").cast("int").alias("rank")).alias("place"), (F.lit(weight) / (rrf_k + F.col("rank"))).alias("part")))
    each = reduce(DataFrame.unionByName, parts)
    # a list of at most one entry a ranking, summed in a fixed order
    total = each.groupBy("query_id", "id").agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"])
    return ranked(total.select("query_id", "id", score.alias("score"), "place"), ["query_id"], [F.desc("score"), F.col("place"), F.col("id")], k).drop("place")
