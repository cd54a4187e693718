"""Shared pieces: written tables, words and bounded sizes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.common import BATCH_KEY, dropped, fresh, small_batches, written

__all__ = ["BATCH_KEY", "LETTER", "SPACE", "bounded_batches", "crc_mod", "crc_mod_col", "dropped", "fresh", "release", "slices", "small_batches", "width", "words_of", "written"]

#: ASCII white space: what separates the words of most operators here.
SPACE = " \t\n\r\x0b\x0c"
LETTER = re.compile(r"[^\W\d_]")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle; the cluster sizes this setting to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(doc_id, n: int) -> int | None:
    """crc32 of the id as text, modulo ``n``; None for a null id."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def crc_mod_col(doc_id, n: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def release() -> None:
    """Give freed memory back: a worker idles with what it holds while other stages run beside it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """For applications, not operators: from now on rows pass to Python in batches of about ``size``, unless the session says
    otherwise. Operators cut what they get by ``slices``; this bounds what Spark itself holds."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, size)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at least a row and about ``limit`` bytes of ``column``: Python objects are made of one at a time."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64) + 16)
        start = 0
        while start < b.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield b.slice(start, stop - start)
            start = stop
