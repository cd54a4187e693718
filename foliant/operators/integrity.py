"""Checks between tables: unique keys, orphans, drift, and the manifest of a build."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CategoryDrift, DuplicateKey, ManifestMismatch, OrphanChunks, StaleIndex
from ..functions.text import terms
from ..schemas import MANIFEST


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``children`` that ``parents`` doesn't have."""
    return children.select(key).distinct().join(parents.select(key), key, "left_anti")


def drift(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side has and the other doesn't: columns key and side (``left`` or ``right``: who has it)."""
    return orphans(left, right, key).withColumn("side", F.lit("left")).unionByName(orphans(right, left, key).withColumn("side", F.lit("right")))


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key is not yet there: what an incremental run has to do."""
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def with_articles(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """Chunks with their article's url, title and length; raises if an article is twice there or missing."""
    found = duplicates(articles, "doc_id").limit(5).collect()
    if found:
        raise DuplicateKey(f"doc_id stands more than once: {[r.doc_id for r in found]}")
    lost = orphans(chunks, articles, "doc_id").orderBy("doc_id").limit(10).collect()
    if lost:
        raise OrphanChunks(f"chunks without an article: {[r.doc_id for r in lost]}")
    return chunks.join(articles.select("doc_id", "url", "title", F.col("n_chars").alias("full_article_length")), "doc_id", "left")


def check_index(chunks: DataFrame, postings: DataFrame) -> None:
    """Raises if the index has ids that the chunks don't, or lacks a chunk that has a term; others have no postings."""
    stale = orphans(postings.select(F.col("id").alias("chunk_id")), chunks, "chunk_id").orderBy("chunk_id").limit(10).collect()
    if stale:
        raise StaleIndex(f"the index holds ids that the chunks don't: {[r.chunk_id for r in stale]}")
    worded = chunks.filter(F.size(terms(F.col("text"))) > 0)
    lost = orphans(worded, postings.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id").orderBy("chunk_id").limit(10).collect()
    if lost:
        raise StaleIndex(f"the index lacks chunks: {[r.chunk_id for r in lost]}")


def check_categories(chunks: DataFrame, advertised: list[str]) -> list[str]:
    """Categories that only the corpus has; raises if an advertised one isn't there."""
    own = {r.category for r in chunks.select("category").distinct().collect()}
    lost = sorted(set(advertised) - own)
    if lost:
        raise CategoryDrift(f"no chunk has the categories {lost}")
    return sorted(own - set(advertised) - {None})


def content_digest(df: DataFrame) -> str:
    """sha256 over the sorted digests of all rows, by way of counts in 256 groups: the same for any partitioning."""
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    groups = df.select(row.alias("h")).groupBy(F.substring("h", 1, 2).alias("g")).agg(*[F.sum(F.conv(F.substring("h", i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in (3, 15, 27, 39)], F.count("*").alias("n"))
    return groups.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("*")))), 256)).first()[0]  # at most 256 rows


def manifest(spark: SparkSession, articles: DataFrame, chunks: DataFrame, max_tokens: int, overlap: int, tokenizer: str, embedding_model: str, embedding_dim: int, hyphen: bool = False) -> DataFrame:
    """One row that tells what an index was built from."""
    row = (articles.count(), chunks.count(), content_digest(articles), content_digest(chunks.drop("embedding")), max_tokens, overlap, tokenizer, embedding_model, embedding_dim, "float32", hyphen, datetime.now(UTC).isoformat())
    return spark.createDataFrame([row], MANIFEST)


def check_manifest(stored: DataFrame, articles: DataFrame, embedding_model: str, embedding_dim: int) -> None:
    row = stored.first()
    if row is None or set(stored.columns) != set(MANIFEST.names):
        raise ManifestMismatch("the manifest is not of this build")
    wrong = [f"{name}: {had!r} is not {now!r}" for name, had, now in (("embedding_model", row.embedding_model, embedding_model), ("embedding_dim", row.embedding_dim, embedding_dim), ("corpus_sha256", row.corpus_sha256, content_digest(articles))) if had != now]
    if wrong:
        raise ManifestMismatch("; ".join(wrong))
