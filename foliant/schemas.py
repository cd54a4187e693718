"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType())}


def struct(spec: str) -> T.StructType:
    """A schema from ``name type, ...``, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split(" ") for f in spec.split(", "))])


ARTICLE_DDL = "doc_id string, url string, title string, category string, breadcrumb array<string>, body_md string, n_chars int"
CHUNK_DDL = "chunk_id string, doc_id string, ordinal int, heading_path array<string>, text string, category string, n_tokens int"

ARTICLES = struct(ARTICLE_DDL)
CHUNKS = struct(CHUNK_DDL)
RANKING = struct("query_id bigint, chunk_id string, score double, rank int")
HITS = struct("query_id bigint, rank int, score double, chunk_id string, doc_id string, heading_path array<string>, text string, category string, n_tokens int, url string, title string, full_article_length int")
EVAL_QUERY = struct("query_id bigint, query string, type string, expected_urls array<string>")
MANIFEST = struct(
    "n_articles bigint, n_chunks bigint, corpus_sha256 string, chunks_sha256 string, max_tokens int, overlap int, tokenizer string, "
    "embedding_model string, embedding_dim int, embedding_dtype string, hyphen_tokens boolean, created_at string"
)
#: Six kinds of event, told apart by ``type``; a kind leaves the other kinds' columns null.
EVENT_DDL = "ts timestamp, run string, seq bigint, type string, question string, text string, call_id string, name string, args map<string,string>, outcome string, stopped_reason string"
EVENT = struct(EVENT_DDL)
EVENT_TYPES = ("run_started", "model_reasoning", "tool_started", "tool_finished", "run_finished", "run_failed")
STOP_REASONS = ("answer", "max_iters", "context_budget", "wall_clock", "fatal_tool_error", "llm_unavailable")
FAILED_REASONS = ("wall_clock", "fatal_tool_error", "llm_unavailable")
