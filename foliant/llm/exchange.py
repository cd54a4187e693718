"""Global exchange of distinct keys.

Documents are packed into chunks of bounded text. A chunk sends each of its distinct keys once, to the key's hash
bucket; a bucket answers every distinct key once for all chunks; the answers go home to the chunk. So what is shuffled
is one entry for each key and chunk, never one for each occurrence, and a key that fills a third of the corpus is one
entry for each chunk like any other. The number of buckets follows the bytes of the texts (``BUCKET_BYTES`` of text each), so
what meets in one bucket is bounded up to ``MOST_BUCKETS``; where a key's answer needs that key alone, ``ask_each`` takes a
bucket's entries one at a time, whatever its size. The chunks are a written table in the shared folder: both uses of them
see the same rows whatever executors are lost.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, slices, small_batches, written

CHUNK_BYTES = 8 << 20
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 12, 1 << 14
LEVEL = 9
TABLE = "chunk string, bucket int, payload binary, keys binary"
ANSWERS = "chunk string, bucket int, answer binary"


def squeeze(*parts: bytes, level: int = LEVEL) -> bytes:
    head = struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts))
    return zstandard.ZstdCompressor(level).compress(head + b"".join(parts))


def unsqueeze(blob: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 8 * n, []
    for size in struct.unpack_from(f"<{n}Q", raw, 4):
        out.append(raw[at : at + size])
        at += size
    return out


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array by significance, which compress better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""


def unplanes(raw, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1) if len(raw) else np.empty(0, dtype)


def pack_ranked(x: np.ndarray) -> list[bytes]:
    """Three parts for numbers that are small when frequent: one byte each, two more for those from 224 on, the rest above 2^21."""
    high = x >= 224
    big = x[high]
    over = big >> 16
    one = x.astype(np.uint8)
    one[high] = 224 + np.minimum(over, 31)
    return [one.tobytes(), planes((big & 0xFFFF).astype(np.uint16)), over[over >= 31].astype(np.uint32).tobytes()]


def unpack_ranked(one, low, over) -> np.ndarray:
    out = np.frombuffer(one, np.uint8).astype(np.uint32)
    high = out >= 224
    top = out[high] - 224
    top[top == 31] = np.frombuffer(over, np.uint32)
    out[high] = (top << 16) | unplanes(low, np.uint16)
    return out


def pack_sizes(sizes: list[int]) -> tuple[bytes, bytes]:
    """Two parts: a byte for each size, and those from 255 on."""
    x = np.asarray(sizes, np.uint64)
    return np.minimum(x, 255).astype(np.uint8).tobytes(), x[x >= 255].tobytes()


def unpack_sizes(low, high) -> np.ndarray:
    out = np.frombuffer(low, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(high, np.uint64).astype(np.int64)
    return out


def pack_strings(words: list[bytes]) -> tuple[bytes, bytes, bytes]:
    return *pack_sizes([len(w) for w in words]), b"".join(words)


def unpack_strings(low, high, joined) -> list[bytes]:
    raw, out, at = bytes(joined), [], 0
    for e in np.cumsum(unpack_sizes(low, high)).tolist():
        out.append(raw[at:e])
        at = e
    return out


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts: one narrow pass over one column."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def buckets_for(n_bytes: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, n_bytes // BUCKET_BYTES))


def by_chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Tables of consecutive rows with about ``limit`` bytes of text; a longer text is a chunk of its own."""
    held, size = [], 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) + 16
        start, run = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if size + run and size + run + n > limit:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start, run = [], 0, i, 0
            run += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
            size += run
    if held:
        yield pa.Table.from_batches(held)


def chunks(df: DataFrame, text: str, make: Callable[[pa.Table], tuple[bytes, dict[int, bytes]]], name: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """Written table of chunks. ``make`` turns a chunk's rows into its payload and its keys by bucket."""
    schema = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("payload", pa.binary()), ("keys", pa.binary())])

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, table in enumerate(by_chunks(batches, text, limit)):
            payload, keys = make(table)
            chunk, order = f"{part}-{k}", sorted(keys)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * (1 + len(order))), pa.array([-1, *order], pa.int32()), pa.array([payload] + [None] * len(order), pa.binary()), pa.array([None, *(keys[b] for b in order)], pa.binary())], schema=schema)
            del payload, keys
            release()

    with small_batches(df.sparkSession):
        return written(df.mapInArrow(run, TABLE), name)


def ask(table: DataFrame, resolve: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """One answer for each chunk and bucket; ``resolve`` sees the keys of all chunks in one bucket."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        answers = resolve(bucket, group.column("keys").to_pylist())
        release()
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "answer": pa.array(answers, pa.binary())})

    return table.filter(F.col("bucket") >= 0).select("chunk", "bucket", "keys").groupBy("bucket").applyInArrow(run, ANSWERS)


def ask_each(table: DataFrame, n_buckets: int, resolver: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """Like ``ask`` where a key's answer needs that key alone: ``resolver`` gives a task's function of one entry."""
    schema = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("answer", pa.binary())])

    def run(batches):
        resolve = resolver()
        for b in slices(batches, 2, CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(resolve, b.column(2).to_pylist()), pa.binary())], schema=schema)
            release()
        del resolve
        release()

    return table.filter(F.col("bucket") >= 0).select("chunk", "bucket", "keys").repartition(n_buckets, "bucket").mapInArrow(run, ANSWERS)


def home(table: DataFrame, answers: DataFrame, finish: Callable[[bytes, dict[int, bytes]], pa.Table], schema) -> DataFrame:
    """Answers back at their chunk; ``finish`` makes the rows of one chunk from its payload and its answers by bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = finish(left.column("payload")[0].as_py(), dict(zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist(), strict=True)))
        release()
        return out

    payload = table.filter(F.col("bucket") < 0).select("chunk", "payload")
    return payload.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def tabled(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def untabled(raw) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(raw)).read_all()
