"""The corpus build, and what searches it: pages to articles to passages to vectors and an index, each a table in one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import html
from ..operators import answers, chunking, embedding, integrity, metrics
from ..operators.lexical import LexicalIndex
from ..operators.rerank import OverlapReranker
from ..operators.search import Retriever
from ..settings import RetrievalSettings
from ..sources import runs


def embedder_of(settings: RetrievalSettings) -> embedding.Embedder:
    return embedding.HashingEmbedder(settings.embedding_dim)


def title_of() -> Column:
    """A passage's title in the index: its first heading."""
    return F.coalesce(F.get("heading_path", F.lit(0)), F.lit(""))


def build(pages: DataFrame, out: str, base_url: str, settings: RetrievalSettings | None = None, template: html.Template | None = None, tokenizer: chunking.Tokenizer | None = None, embedder: embedding.Embedder | None = None) -> DataFrame:
    """Build the tables articles, rejects, chunks, index and manifest under ``out`` from pages (slug, html); returns the manifest.

    Pages are parsed once; passages and vectors come from one narrow pass over the articles, written by category. Nothing
    is written if no page is an article.
    """
    settings = settings or RetrievalSettings()
    embedder = embedder or embedder_of(settings)
    spark = pages.sparkSession
    parsed = html.parse_pages(pages, base_url, settings.min_body_length, template or html.Template())
    parsed.write.mode("overwrite").parquet(f"{out}/parsed")
    parsed = spark.read.parquet(f"{out}/parsed")
    articles = html.articles(parsed)
    if articles.isEmpty():
        raise EngineError("no page is an article")
    chunks = chunking.chunk_articles(articles, tokenizer, settings.max_tokens, settings.overlap)
    embedding.embed_column(chunks, embedder, ["text"]).write.mode("overwrite").partitionBy("category").parquet(f"{out}/chunks")
    chunks = chunking.check_limits(spark.read.parquet(f"{out}/chunks"), settings.max_tokens)
    LexicalIndex.build(chunks, "chunk_id", "text", title_of(), F.col("category"), settings.hyphen_tokens).write(f"{out}/index")
    manifest = integrity.manifest(spark, articles, chunks, settings.max_tokens, settings.overlap, type(tokenizer or chunking.WordTokenizer()).__name__, settings.embedding_model, embedder.dim, settings.hyphen_tokens)
    runs.write_manifest(manifest, f"{out}/manifest")
    return runs.read_manifest(spark, f"{out}/manifest")


def load_articles(spark: SparkSession, folder: str) -> DataFrame:
    return html.articles(spark.read.parquet(f"{folder}/parsed"))


def load(spark: SparkSession, folder: str, settings: RetrievalSettings | None = None, embedder: embedding.Embedder | None = None, advertised: list[str] | None = None) -> Retriever:
    """A retriever over a built folder, after its checks: manifest, orphans, index ids, categories."""
    settings = settings or RetrievalSettings()
    embedder = embedder or embedder_of(settings)
    articles = load_articles(spark, folder)
    integrity.check_manifest(runs.read_manifest(spark, f"{folder}/manifest"), articles, settings.embedding_model, embedder.dim)
    chunks = integrity.with_articles(spark.read.parquet(f"{folder}/chunks"), articles)
    index = LexicalIndex.read(spark, f"{folder}/index")
    integrity.check_index(chunks, index.postings)
    if advertised:
        integrity.check_categories(chunks, advertised)
    return Retriever(chunks, index, embedder, OverlapReranker(), settings)


def evaluate(retriever: Retriever, queries: DataFrame, k: int = 50, method: str = "hybrid", rerank: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, summaries overall and by group, hits) of evaluation queries, all in one batch."""
    hits = retriever.top_documents(queries, k, method, rerank)
    results = metrics.first_hits(queries, hits)
    return results, metrics.evaluate(metrics.not_empty(results), k), hits


def ask(retriever: Retriever, queries: DataFrame, generator: answers.Generator | None = None, **search) -> DataFrame:
    """Cited answers of questions (query_id, query)."""
    return answers.answer_questions(queries, retriever.search(queries, **search), generator)


def evaluate_answers(retriever: Retriever, queries: DataFrame, generator: answers.Generator | None = None, **search) -> tuple[DataFrame, DataFrame]:
    """(results, rates overall and by group) of answers to evaluation queries."""
    answered = ask(retriever, queries, generator, **search)
    own = answered.select("query_id", "text", F.transform("hits", lambda h: h["url"]).alias("retrieved_urls"), F.transform("citations", lambda c: c["url"]).alias("cited_urls"), "invented")
    results = metrics.answer_results(queries.select("query_id", "type", "expected_urls").join(own, "query_id"))
    return results, metrics.evaluate_answers(metrics.not_empty(results))
