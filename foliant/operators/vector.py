"""Exact cosine search.

Vectors are checked and normalised in the JVM. The search itself is one narrow pass: each batch of vectors is multiplied
with the block of queries, a task keeps the best k of its rows for each query, and only those are ranked together. A
block of queries is broadcast and holds at most ``BLOCK`` of them; each further block is a pass of its own over all vectors, written
before the next begins, so neither the plan nor the driver grows with the queries (the products are the work, and they do). Equal scores are in the order of the ids. Null, empty, not finite or zero vectors raise, or are left out with
``strict=False``.
"""

from __future__ import annotations

from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadVectors
from ..functions.vectors import fault, unit
from .common import new_folder, ranked

BLOCK = 2048


def faults(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """Columns id and fault of the vectors that can't be searched."""
    return vectors.select(F.col(id_col).alias("id"), fault(F.col(vector_col), dim).alias("fault")).filter("fault IS NOT NULL")


def normalised(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", dim: int | None = None, strict: bool = True) -> DataFrame:
    """``vectors`` with ``vector_col`` of length 1."""
    own = fault(F.col(vector_col), dim)
    if strict:
        bad = faults(vectors, id_col, vector_col, dim).orderBy("id").limit(10).collect()
        if bad:
            raise BadVectors(", ".join(f"{r.id}: {r.fault}" for r in bad))
    else:
        vectors = vectors.filter(own.isNull())
    return vectors.withColumn(vector_col, unit(F.col(vector_col)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "embedding", category_col: str | None = None, category=None, strict: bool = True, block: int = BLOCK) -> DataFrame:
    """Columns query_id, id, score, rank for queries (query_id, vector). The category is filtered before anything is scored."""
    if category_col is not None and category is not None:
        vectors = vectors.filter(F.col(category_col) == category)
    own = normalised(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding")), strict=strict)
    asked = normalised(queries.select(F.col("query_id").alias("id"), F.col("vector").alias("embedding")), strict=True)
    kind = asked.schema["id"].dataType.simpleString()
    blocks = iter(lambda rows=asked.toLocalIterator(): list(islice(rows, block)), [])
    first, second = next(blocks, []), next(blocks, None)
    found = _best(own, first, k, kind)
    if second is not None:
        folder = new_folder(vectors.sparkSession, "best")
        for rows in chain([first, second], blocks):
            _best(own, rows, k, kind).write.mode("append").parquet(folder)
        found = vectors.sparkSession.read.schema(found.schema).parquet(folder)
    return ranked(found, ["query_id"], [F.desc("score"), F.col("id")], k)


def _best(vectors: DataFrame, rows: list, k: int, kind: str) -> DataFrame:
    """The best k rows of each task for each query of a block."""
    shared = vectors.sparkSession.sparkContext.broadcast(([r.id for r in rows], np.array([r.embedding for r in rows], np.float64)))
    own_kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        ids, matrix = shared.value
        if not ids:
            return
        held: list[list[tuple[float, object]]] = [[] for _ in ids]  # each query's best k so far, as (-score, id)
        for b in batches:
            if not b.num_rows:
                continue
            b = b.take(pc.sort_indices(b.column(0)))  # ties below then come in the order of the ids
            names = b.column(0).to_pylist()
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            if len(flat) != len(names) * matrix.shape[1]:
                raise BadVectors(f"vectors have another dimension than the queries' {matrix.shape[1]}")
            for q, row in enumerate(matrix @ flat.reshape(len(names), -1).T):
                at = range(len(row))
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    above = np.flatnonzero(row > least)
                    at = [*above.tolist(), *np.flatnonzero(row == least)[: k - len(above)].tolist()]
                held[q] = sorted(held[q] + [(-float(row[i]), names[i]) for i in at])[:k]
        for q, best in zip(ids, held, strict=True):
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(best)), pa.array([i for _, i in best]), pa.array([-s for s, _ in best])], names=["query_id", "id", "score"])

    return vectors.mapInArrow(run, f"query_id {kind}, id {own_kind}, score double")
