"""Answers from retrieved excerpts: prompts, a pluggable generator, citations and text windows."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions import passages

TEMPLATE = "Answer from the numbered excerpts alone. Put the number of the excerpt that a claim comes from in square brackets after it. If they don't answer the question, reply exactly: " + passages.NO_COVERAGE + "\n\nExcerpts:\n{excerpts}\n\nQuestion: {question}\n"
#: Bounds of requests.
QUERY_CHARS, SEARCH_K, WINDOW_CHARS = (2, 300), (5, 10), (1000, 60_000)


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class ExtractiveGenerator:
    """Answers with the first line of the first excerpt."""

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            lines = p.partition("[1] ")[2].split("\n")
            out.append(f"{lines[1].strip()} [1]" if len(lines) > 1 else passages.NO_COVERAGE)
        return out


def excerpt(n: Column, title: Column, heading_path: Column, text: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), title, F.lit(" — "), F.array_join(heading_path, " > "), F.lit("\n"), text)


def prompts(queries: DataFrame, hits: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Columns query_id, query, hits (array in rank order; a query's hits are at most its k), prompt (null without hits)."""
    own = hits.select("query_id", F.struct("rank", "title", "heading_path", "url", "text", "chunk_id").alias("hit"))
    listed = own.groupBy("query_id").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    out = queries.select("query_id", "query").join(listed, "query_id", "left")
    texts = F.array_join(F.transform("hits", lambda h: excerpt(h["rank"], h["title"], h["heading_path"], h["text"])), "\n\n")
    return out.withColumn("prompt", F.when(F.size("hits") > 0, F.replace(F.replace(F.lit(template), F.lit("{excerpts}"), texts), F.lit("{question}"), F.col("query"))))


def answer(prompted: DataFrame, generator: Generator | None = None) -> DataFrame:
    """Columns query_id, query, hits, text; without hits the generator isn't asked and the text is the refusal."""
    generator = generator or ExtractiveGenerator()

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        asked = p.dropna()
        return pd.Series(generator.generate(asked.tolist()), index=asked.index, dtype=object).reindex(p.index)

    return prompted.withColumn("text", F.coalesce(run("prompt"), F.lit(passages.NO_COVERAGE))).drop("prompt")


def cite(answered: DataFrame) -> DataFrame:
    """With citations (n, title, heading_path, url) and invented (numbers beyond the hits)."""
    hits = F.coalesce("hits", F.array().cast(answered.schema["hits"].dataType))
    numbers = passages.cited_numbers(F.col("text"))
    found = F.transform(passages.resolved(numbers, hits), lambda c: F.struct(c["n"].alias("n"), c["hit"]["title"].alias("title"), c["hit"]["heading_path"].alias("heading_path"), c["hit"]["url"].alias("url")))
    return answered.withColumns({"citations": found, "invented": passages.invented(numbers, F.size(hits))})


def answer_questions(queries: DataFrame, hits: DataFrame, generator: Generator | None = None, template: str = TEMPLATE) -> DataFrame:
    return cite(answer(prompts(queries, hits, template), generator))


def invented_report(answers: DataFrame) -> DataFrame:
    return answers.filter(F.size("invented") > 0).select("query_id", "query", "invented")


def article_window(requests: DataFrame, chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """For requests (chunk_id, max_chars) the window of the article about the passage; unknown ids give error_category."""
    text = chunks.select("chunk_id", "doc_id", F.col("text").alias("chunk_text"))
    own = requests.join(text, "chunk_id", "left").join(articles.select("doc_id", "url", "title", "category", "breadcrumb", F.col("body_md"), "n_chars"), "doc_id", "left")
    w = passages.window(F.col("body_md"), F.col("chunk_text"), F.col("max_chars"))
    bad = ~F.col("max_chars").between(*WINDOW_CHARS)
    error = F.when(bad | F.col("body_md").isNull(), "rephrase")
    good = lambda c: F.when(error.isNull(), c)
    return own.select("chunk_id", "doc_id", "title", "url", "category", "breadcrumb", good(w["body"]).alias("body"), "n_chars", good(w["window_start"]).alias("window_start"), good(w["window_end"]).alias("window_end"), error.alias("error_category"))


def request_error(query: Column, k: Column, category: Column, categories: list[str]) -> Column:
    """``rephrase`` for a request out of bounds, else null."""
    bad = query.isNull() | ~F.length(query).between(*QUERY_CHARS) | ~F.coalesce(k.between(*SEARCH_K), F.lit(True)) | (category.isNotNull() & ~category.isin(categories))
    return F.when(bad, "rephrase")


def require_positive(**values: float | None) -> None:
    for name, value in values.items():
        if value is not None and value <= 0:
            raise BadRequest(f"{name} has to be positive")
