"""One search over an index: vector, BM25 or hybrid, with an optional rerank, for a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..settings import RetrievalSettings
from . import fusion, metrics, vector
from .answers import SEARCH_K, request_error
from .common import bounded, size_of, small, written
from .embedding import Embedder, embed_column
from .lexical import LexicalIndex
from .rerank import Reranker
from .rerank import rerank as rerank_pool

METHODS = ("vector", "bm25", "hybrid")


@dataclass
class Retriever:
    """``chunks`` hold an ``embedding`` for vector search, and url, title and full_article_length (integrity.with_articles)."""

    chunks: DataFrame
    index: LexicalIndex | None = None
    embedder: Embedder | None = None
    reranker: Reranker | None = None
    settings: RetrievalSettings = field(default_factory=RetrievalSettings)

    def search(self, queries: DataFrame, k: int | None = None, method: str = "hybrid", category: str | None = None, rerank: bool = False, fetch_k: int | None = None) -> DataFrame:
        """Hits of queries (query_id, query): query_id, rank, score and the columns of the chunks without the embedding."""
        k = k or self.settings.search_k
        if method not in METHODS:
            raise BadRequest(f"method has to be one of {METHODS}")
        if method != "vector" and self.index is None:
            raise BadRequest(f"{method} search needs a lexical index")
        if rerank and self.reranker is None:
            raise BadRequest("no reranker")
        depth = max(k, fetch_k) if rerank and fetch_k else k
        found = self.candidates(queries, depth, method, category)
        if rerank:
            texts = self.chunks.select(F.col("chunk_id").alias("id"), "text")
            pool = found.join(texts, "id").join(small(queries.select("query_id", "query")), "query_id")
            found = rerank_pool(pool, self.reranker, k)
        return self.hydrate(found, size_of(queries) * k)

    def candidates(self, queries: DataFrame, depth: int, method: str, category: str | None = None) -> DataFrame:
        """Columns query_id, id, score, rank. What hybrid search fuses are the best of each side, at least ``hybrid_pool``."""
        if method == "vector":
            return self._vector(queries, depth, category)
        if method == "bm25":
            return self._bm25(queries, depth, category)
        pool = max(depth, self.settings.hybrid_pool)
        weights = {"vector": self.settings.rrf_vector_weight, "bm25": self.settings.rrf_bm25_weight}
        return fusion.fuse({"vector": self._vector(queries, pool, category), "bm25": self._bm25(queries, pool, category)}, weights, self.settings.rrf_k, depth)

    def _vector(self, queries, k, category):
        if self.embedder is None:
            raise BadRequest("no embedder")
        asked = embed_column(queries.select("query_id", "query"), self.embedder, ["query"], "query", "vector")
        return vector.search(self.chunks, asked, k, "chunk_id", "embedding", "category", category)

    def _bm25(self, queries, k, category):
        return self.index.search(queries, k, category, self.settings.title_weight, self.settings.text_weight)

    def serve(self, requests: DataFrame, categories: list[str]) -> DataFrame:
        """Requests (query_id, query, k, category) as a search tool takes them: hybrid, reranked from the best ``rerank_fetch_k``.

        A request out of bounds gives one row with ``error_category``; one without hits gives one with ``message``. The
        distinct categories, an advertised list, are one plan each; ranks don't depend on k within its bounds.
        """
        k = F.coalesce("k", F.lit(SEARCH_K[0]))
        checked = requests.select("query_id", "query", k.alias("k"), "category", request_error(F.col("query"), k, F.col("category"), categories).alias("error_category"))
        good, parts = checked.filter("error_category IS NULL"), []
        for c in [None, *categories]:
            asked = good.filter(F.col("category").eqNullSafe(F.lit(c)))
            if not asked.isEmpty():
                hits = self.search(asked, SEARCH_K[1], category=c, rerank=self.reranker is not None, fetch_k=self.settings.rerank_fetch_k)
                parts.append(hits.join(small(asked.select("query_id", "k")), "query_id").filter("rank <= k").select("query_id", "rank", "score", "chunk_id", "title", "url", F.col("text").alias("body"), "full_article_length"))
        columns = ["rank", "score", "chunk_id", "title", "url", "body", "full_article_length"]
        found = reduce(DataFrame.unionByName, parts) if parts else checked.limit(0).select("query_id", *[F.lit(None).alias(n) for n in columns])
        out = checked.join(found, "query_id", "left")
        message = F.when(F.col("error_category").isNull() & F.col("rank").isNull(), "no passage matches")
        return out.select("query_id", *columns, message.alias("message"), "error_category")

    def hydrate(self, found: DataFrame, at_most: int) -> DataFrame:
        """Rows of the chunks behind the ids; the found side, k rows a query, is broadcast if that is little."""
        own = self.chunks.drop("embedding").withColumnRenamed("chunk_id", "id")
        return own.join(bounded(found, at_most), "id").withColumnRenamed("id", "chunk_id")

    def article(self, chunk_id: str, articles: DataFrame) -> DataFrame:
        """The article of one passage; no rows for an unknown id."""
        own = self.chunks.filter(F.col("chunk_id") == chunk_id).select("doc_id")
        return articles.join(F.broadcast(own), "doc_id", "left_semi")  # one row

    def chunk_text(self, chunk_id: str) -> str | None:
        row = self.chunks.filter(F.col("chunk_id") == chunk_id).select("text").first()
        return row.text if row else None

    def top_documents(self, queries: DataFrame, k: int, method: str = "hybrid", rerank: bool = False) -> DataFrame:
        """k distinct pages a query.

        The fetch begins at ``eval_overfetch`` times k and doubles for the queries that still have fewer than k pages, until
        all chunks are fetched or a query has no more. Rounds are as many as the logarithm of the chunks at most.
        """
        total = self.chunks.count()
        fetch = min(k * self.settings.eval_overfetch, total)
        pending, done = queries, None
        while True:
            hits = written(self.search(pending, max(1, fetch), method, rerank=rerank), "hits")
            pages = metrics.collapse(hits, k)
            counts = hits.groupBy("query_id").agg(F.count("*").alias("n_hits")).join(pages.groupBy("query_id").agg(F.count("*").alias("n_pages")), "query_id")
            short = counts.filter((F.col("n_pages") < k) & (F.col("n_hits") >= fetch)).select("query_id")
            if fetch >= total or short.isEmpty():
                return pages if done is None else done.unionByName(pages)
            settled = pages.join(short, "query_id", "left_anti")
            done = settled if done is None else done.unionByName(settled)
            pending = pending.join(short, "query_id", "left_semi")
            fetch = min(2 * fetch, total)
