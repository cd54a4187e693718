"""Evaluation of rankings and answers, as set-based rollups over all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import passages, urls
from .common import fresh, ranked

RECALL_KS = (1, 3, 5, 20, 50)


def first_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Columns of ``queries`` (query_id, expected_urls, ...) with rank (null: a miss) and reciprocal_rank.

    A hit is a result (query_id, rank, url) whose normal form is that of an expected URL. The join is on the query and the
    URL, so results that nobody expects go no further than their task.
    """
    expected = queries.select("query_id", F.explode("expected_urls").alias("u")).select("query_id", urls.normalised(F.col("u")).alias("key")).distinct()
    found = hits.select("query_id", "rank", urls.normalised(F.col("url")).alias("key")).join(expected, ["query_id", "key"], "left_semi")
    best = found.groupBy("query_id").agg(F.min("rank").alias("rank"))
    return scored(queries.join(best, "query_id", "left"))


def scored(ranks: DataFrame) -> DataFrame:
    return ranks.withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))


def recall(k: int) -> Column:
    return F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))


def summary_columns(ks=RECALL_KS) -> list[Column]:
    return [F.count("*").alias("n_queries"), *[recall(k).alias(f"recall_at_{k}") for k in ks], F.avg("reciprocal_rank").alias("mrr")]


def measured_ks(k: int, ks=RECALL_KS) -> tuple[int, ...]:
    """Depths that were searched at all."""
    return tuple(x for x in ks if x <= k)


def not_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise EngineError("cannot summarise an empty result list")
    return df


def summarise(results: DataFrame, k: int = 50) -> DataFrame:
    """One row: n_queries, recall_at_k for each measured depth, mrr."""
    return not_empty(results).agg(*summary_columns(measured_ks(k)))


def grouped(results: DataFrame, by: dict[str, Column], columns: list[Column]) -> DataFrame:
    """Overall and by each of some keys in one pass: columns grouping (``overall`` or the key's name), key and ``columns``."""
    names = list(by)
    own = results.withColumns({f"__{n}": c for n, c in by.items()})
    sets = [[], *[[F.col(f"__{n}")] for n in names]]
    out = own.groupingSets(sets, *[F.col(f"__{n}") for n in names]).agg(*columns, *[F.grouping(f"__{n}").alias(f"__g_{n}") for n in names])
    which, key = F.lit("overall"), F.lit(None).cast("string")
    for n in reversed(names):
        which, key = F.when(F.col(f"__g_{n}") == 0, n).otherwise(which), F.when(F.col(f"__g_{n}") == 0, F.col(f"__{n}").cast("string")).otherwise(key)
    return out.select(which.alias("grouping"), key.alias("key"), *[c for c in out.columns if not c.startswith("__")])


def evaluate(results: DataFrame, k: int = 50) -> DataFrame:
    """Overall, by query type and by the category of the first expected URL."""
    return grouped(results, {"type": F.col("type"), "category": urls.category(F.get("expected_urls", F.lit(0)))}, summary_columns(measured_ks(k)))


def misses(results: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries without a hit, and what came first instead."""
    top = hits.filter("rank = 1").select("query_id", F.col("url").alias("top_url"))
    return results.filter("rank IS NULL").select("query_id", "query").join(top, "query_id", "left")


def collapse(hits: DataFrame, k: int | None = None) -> DataFrame:
    """The best hit of each URL (columns query_id, rank, url, ...), ranked anew and cut to k documents."""
    key, first = fresh(hits.columns, "url_key"), fresh(hits.columns, "first_of_url")
    own = ranked(hits.withColumn(key, urls.normalised(F.col("url"))), ["query_id", key], [F.col("rank")], 1, first)
    return ranked(own.withColumnRenamed("rank", "hit_rank"), ["query_id"], [F.col("hit_rank")], k).drop(key, first)


def answer_results(answers: DataFrame) -> DataFrame:
    """From answers (query_id, type, expected_urls, text, retrieved_urls, cited_urls, invented) the flags of each."""
    norm = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), urls.normalised)
    expected = norm(F.col("expected_urls"))
    right = F.transform(norm(F.col("cited_urls")), lambda u: F.array_contains(expected, u))
    return answers.select(
        "query_id", "type", "expected_urls", F.arrays_overlap(expected, norm(F.col("retrieved_urls"))).alias("expected_url_retrieved"), passages.refused(F.col("text")).alias("refused"),
        right.alias("citation_results"), F.exists(right, lambda x: x).alias("cited_correct_source"), (F.size("invented") > 0).alias("invented_citation"),
    )


def answer_columns() -> list[Column]:
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return [F.count("*").alias("n_queries"), rate("expected_url_retrieved").alias("retrieval_rate"), rate("cited_correct_source").alias("citation_rate"), rate("refused").alias("refusal_rate"), rate("invented_citation").alias("invented_citation_rate")]


def evaluate_answers(results: DataFrame) -> DataFrame:
    return grouped(results, {"type": F.col("type"), "category": urls.category(F.get("expected_urls", F.lit(0)))}, answer_columns())


def summary_line(n: str = "n_queries", ks=RECALL_KS) -> Column:
    """A printed line of a summary row."""
    parts = [F.format_string(f"R@{k} %.2f", F.col(f"recall_at_{k}")) for k in ks]
    return F.concat_ws("  ", F.format_string("n=%d", F.col(n)), *parts, F.format_string("MRR %.2f", F.col("mrr")))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Counts of the values, the most frequent first."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def best_of_grid(summaries: DataFrame, order: str = "grid", metric: str = "mrr") -> DataFrame:
    """The grid point with the best metric, the first of equals."""
    return summaries.orderBy(F.desc(metric), order).limit(1)
