"""Embeddings of texts by a pluggable model; the default hashes words and needs no model file."""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadVectors
from .common import fresh

BATCH = 32


class Embedder(Protocol):
    """``task`` is ``query`` or ``document``: models may put a prompt before queries."""

    dim: int

    def embed(self, texts: list[str], task: str) -> np.ndarray: ...


class HashingEmbedder:
    """Words and their 3-grams hashed to signed places; the same in every process. A text without words has one fixed vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str], task: str) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split() or [""]:
                raw = word.encode("utf-8", "surrogatepass")
                for gram in [raw, *(raw[i : i + 3] for i in range(len(raw) - 2))]:
                    h = zlib.crc32(gram)
                    row[(h >> 1) % self.dim] += 1 if h & 1 else -1
            if not row.any():
                row[0] = 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def embed_column(df: DataFrame, embedder: Embedder, columns: list[str], task: str = "document", to: str = "embedding") -> DataFrame:
    """``df`` with the embedding of its ``columns`` joined by line ends; nulls are left out of a text. One narrow pass."""
    own = df.withColumn(fresh(df.columns, "joined"), F.concat_ws("\n", *columns))

    def run(batches):
        for b in batches:
            texts, found = b.column(b.num_columns - 1).to_pylist(), []
            for i in range(0, len(texts), BATCH):
                got = np.asarray(embedder.embed(texts[i : i + BATCH], task), np.float32)
                if got.shape != (len(texts[i : i + BATCH]), embedder.dim):
                    raise BadVectors(f"the model gave vectors of shape {got.shape}, not of dimension {embedder.dim}")
                found.append(got)
            flat = np.concatenate(found).reshape(-1) if found else np.empty(0, np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, embedder.dim), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], vectors], names=[*b.schema.names[:-1], to])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return own.mapInArrow(run, f"{fields}, `{to}` array<float>")


def similarity_check(vectors: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Columns a, b, score, ok: cosines of the pairs (a, b, score) of ``expected`` among vectors (id, embedding)."""
    from ..functions.vectors import dot, unit

    a = vectors.select(F.col("id").alias("a"), unit(F.col("embedding")).alias("va"))
    b = vectors.select(F.col("id").alias("b"), unit(F.col("embedding")).alias("vb"))
    found = expected.withColumnRenamed("score", "expected").join(a, "a").join(b, "b")
    score = dot(F.col("va"), F.col("vb"))
    return found.select("a", "b", score.alias("score"), (F.abs(score - F.col("expected")) <= tolerance).alias("ok"))
