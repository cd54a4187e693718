"""Exact removal of word windows that stand more than once, behind a count-min sketch.

Each window of ``size`` words is counted in the sketch under its anchor, the least hash of the runs of ``ANCHOR`` words
inside it. Equal windows have equal anchors, so the merged sketches of all parts never count a window too low; one whose
estimate is 1 is unique and goes no further. The others are grouped exactly by 96-bit digests: a chunk sends each of
its distinct digests once (``exchange``), so a passage in a third of the corpus is one entry for each chunk.

The sketch has two rows of cells, sized with the input up to ``MOST_CELLS`` each: what is broadcast is one bit a cell,
so never over 2 x 32 MB. Beyond that size more windows pass the filter; results stay exact.

Null and empty texts have no words and stay; texts shorter than a window stay whole. Repeated rows repeat each other.
All columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ask, buckets_for, chunks, home, planes, squeeze, tabled, text_bytes, unplanes, unsqueeze, untabled
from .shared import release, small_batches, width, words_of

SIZE, ANCHOR = 35, 20
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 28
SHARDS = 64
STEP_WORDS, HELD = 400_000, 1_000_000  # words and sketched windows at a time, which bound a worker's memory
MULT_A, MULT_B, MULT_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Hashes(dict):
    """64-bit hashes of words, in a cache of bounded size."""

    def __missing__(self, word):
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def rolled(h: np.ndarray, n: int, by: np.uint64) -> np.ndarray:
    """A polynomial in ``by`` over each run of ``n`` hashes."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= by
        out += h[i : i + m]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MULT_B
    return x ^ (x >> np.uint64(29))


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each run of ``n``."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def steps(texts: list[str | None], hashes: Hashes):
    """Word hashes of some texts in one array, and how many words each has; about STEP_WORDS at a time."""
    rows, sizes, total, first = [], [], 0, 0
    for i, text in enumerate(texts):
        own = words_of(text)
        rows.append(np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own)))
        sizes.append(len(own))
        total += len(own)
        if total >= STEP_WORDS or i == len(texts) - 1:
            yield first, np.concatenate(rows), np.array(sizes, np.int64)
            rows, sizes, total, first = [], [], 0, i + 1


def anchored(h: np.ndarray, sizes: np.ndarray, size: int, anchor: int):
    """Starts of all windows that lie in one text, and their anchors."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    starts = np.flatnonzero(np.arange(len(h)) + size <= ends)
    if not len(starts):
        return starts, np.empty(0, np.uint64), np.empty(0, np.uint64)
    runs = mixed(rolled(h, anchor, MULT_A))
    inside = np.arange(len(runs)) + anchor <= ends[: len(runs)]
    return starts, least(runs, size - anchor + 1)[starts], runs[inside]


def cells(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    down = np.uint64(64 - bits)
    return x >> down, (x * MULT_C) >> down


def sketch(texts: DataFrame, n_bytes: int, size: int, anchor: int) -> tuple[list[np.ndarray], int]:
    """One bit for each cell of the two merged rows: whether it counts two or more."""
    want = max(LEAST_CELLS, min(MOST_CELLS, n_bytes // 13))
    bits = int(want - 1).bit_length()
    shard_bits = SHARDS.bit_length() - 1
    low = np.uint64(bits - shard_bits)

    def part(batches):
        """The sketch of one part, as the cells that count one and those that count more."""
        hashes, held, n = Hashes(), [], 0

        def flush():
            both = np.concatenate(held)
            once_more = np.concatenate([both[:, 0], np.repeat(both[:, 0][both[:, 1] > 1], 1)])
            for row, at in enumerate(cells(once_more, bits)):
                at, counts = np.unique(at, return_counts=True)
                shard = (at >> low).astype(np.int64)
                edges = np.searchsorted(shard, np.arange(SHARDS + 1))
                blobs = []
                for s in range(SHARDS):
                    own, c = at[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]]
                    own = (own & np.uint64((1 << int(low)) - 1)).astype(np.uint32)
                    blobs.append(squeeze(planes(np.diff(own, prepend=np.uint32(0)).astype(np.uint32)), np.packbits(c > 1).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([row * SHARDS + s for s in range(SHARDS)], pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "cells"])

        for batch in batches:
            for _, h, sizes in steps(batch.column(0).to_pylist(), hashes):
                _, anchors, runs = anchored(h, sizes, size, anchor)
                if not len(anchors):
                    continue
                anchors = np.unique(anchors)
                runs = np.sort(runs)
                times = np.searchsorted(runs, anchors, "right") - np.searchsorted(runs, anchors, "left")
                held.append(np.stack([anchors, np.minimum(times, 2).astype(np.uint64)], 1))
                n += len(anchors)
                if n >= HELD:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()
        release()

    def merge(batches):
        """Sum of the parts' sketches, a shard at a time in saturating counters."""
        counters: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = counters.setdefault(shard, np.zeros(1 << int(low), np.uint8))
                deltas, more = unsqueeze(blob)
                at = np.cumsum(unplanes(deltas, np.uint32), dtype=np.int64)
                c[at] = np.minimum(c[at] + 1 + np.unpackbits(np.frombuffer(more, np.uint8), count=len(at)), 2)
        pack = zstandard.ZstdCompressor(3).compress
        for shard, c in counters.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pack(np.packbits(c > 1).tobytes())], pa.binary())], names=["shard", "cells"])

    merged = texts.mapInArrow(part, "shard int, cells binary").repartition(min(2 * SHARDS, max(width(texts.sparkSession), 12)), "shard").mapInArrow(merge, "shard int, cells binary")
    rows = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(2)]
    per = (1 << int(low)) // 8
    with small_batches(texts.sparkSession):
        found = merged.collect()  # one bit for each cell, compressed
    for r in found:
        s = r.shard % SHARDS
        rows[r.shard // SHARDS][s * per : (s + 1) * per] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.cells), np.uint8)
    return rows, bits


def flagged(rows: list[np.ndarray], bits: int, anchors: np.ndarray) -> np.ndarray:
    out = np.ones(len(anchors), bool)
    for row, at in zip(rows, cells(anchors, bits), strict=True):
        at = at.astype(np.int64)
        out &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def remove_repeats(df: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Remove each word that a repeated window covers.

    With ``keep_text``: all columns of ``df``, ``text_col`` with the kept words joined by one space (texts that lose
    nothing stay as they are). Without: id, n_words, n_removed and kept_sha256, the digest of the kept words so joined.
    """
    spark = df.sparkSession
    anchor = max(1, min(ANCHOR, size - 1))
    texts = df.select(F.col(text_col).alias("text"))
    n_bytes = text_bytes(texts, "text")
    n_buckets = buckets_for(n_bytes)
    rows, bits = sketch(texts, n_bytes, size, anchor)
    shared = spark.sparkContext.broadcast(rows)  # at most 2 x MOST_CELLS bits

    def make(table: pa.Table):
        hashes, at, digests = Hashes(), [], []
        texts, offset = table.column(text_col).to_pylist(), 0
        for _, h, sizes in steps(texts, hashes):
            starts, anchors, _ = anchored(h, sizes, size, anchor)
            ok = flagged(shared.value, bits, anchors)
            starts = starts[ok]
            if len(starts):
                a, b = mixed(rolled(h, size, MULT_B)), mixed(rolled(h ^ MULT_C, size, MULT_C) * MULT_A)
                digests.append(np.stack([a[starts], b[starts]], 1))
                at.append(starts + offset)
            offset += len(h)
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        keys = np.concatenate(digests) if digests else np.empty((0, 2), np.uint64)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]).any(1)
        ranks = np.cumsum(new) - 1
        first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
        times = np.diff(np.flatnonzero(np.append(new, True)))
        # numbered by where they first stand, so that the windows of a run have numbers in a row
        by_place = np.argsort(first)
        number = np.empty(len(by_place), np.uint32)
        number[by_place] = np.arange(len(by_place), dtype=np.uint32)
        which = np.empty(len(order), np.uint32)
        which[order] = number[ranks]
        distinct, times = keys[first[by_place]], times[by_place]
        to = (distinct[:, 0] % np.uint64(n_buckets)).astype(np.uint16)
        out = {}
        for b in np.unique(to).tolist():
            own = to == b
            out[b] = squeeze(distinct[own, 0].tobytes(), (distinct[own, 1] >> np.uint64(32)).astype(np.uint32).tobytes(), np.packbits(times[own] > 1).tobytes())
        payload = squeeze(tabled(table), planes(np.diff(at, prepend=0).astype(np.uint32)), planes(np.diff(which, prepend=np.uint32(0))), planes(to))
        return payload, out

    def resolve(_, blobs):
        parts = [unsqueeze(b) for b in blobs]
        parts = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32), m) for a, b, m in parts]
        sizes = [len(a) for a, _, _ in parts]
        a, b = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for (_, _, m), n in zip(parts, sizes, strict=True)]).astype(bool)
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        twin = np.zeros(len(order), bool)
        twin[1:] |= same
        twin[:-1] |= same
        repeated = many.copy()
        repeated[order] |= twin  # more than one chunk has it
        return [squeeze(np.packbits(x).tobytes()) for x in np.split(repeated, np.cumsum(sizes)[:-1])]

    def finish(payload, answers):
        raw, at, which, to = unsqueeze(payload)
        table, at, which, to = untabled(raw), np.cumsum(unplanes(at, np.uint32), dtype=np.int64), np.cumsum(unplanes(which, np.uint32), dtype=np.uint32), unplanes(to, np.uint16)
        repeated = np.zeros(len(to), bool)
        for b, blob in answers.items():
            own = np.flatnonzero(to == b)
            repeated[own] = np.unpackbits(np.frombuffer(unsqueeze(blob)[0], np.uint8), count=len(own)).astype(bool)
        at = at[repeated[which]] if len(which) else at
        texts = table.column(text_col).to_pylist()
        kept_texts, n_words, n_removed, digests, offset, lo = [], [], [], [], 0, 0
        for text in texts:
            own = words_of(text)
            n = len(own)
            hi = int(np.searchsorted(at, offset + n))
            gone = 0
            if hi > lo:
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, at[lo:hi] - offset, 1)
                np.add.at(edge, np.minimum(at[lo:hi] - offset + size, n), -1)
                keep = np.cumsum(edge)[:n] == 0
                gone = n - int(keep.sum())
                own = [own[i] for i in np.flatnonzero(keep).tolist()]
            offset, lo = offset + n, hi
            n_words.append(n)
            n_removed.append(gone)
            if keep_text:
                kept_texts.append(b" ".join(own).decode("utf-8", "surrogatepass") if gone else text)
            else:
                digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
        if keep_text:
            return table.set_column(table.schema.get_field_index(text_col), text_col, pa.array(kept_texts, pa.string()))
        return pa.table({id_col: table.column(id_col), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    docs = df if keep_text else df.select(id_col, text_col)
    table = chunks(docs, text_col, make, "substring")
    schema = docs.schema if keep_text else f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string"
    return home(table, ask(table, resolve), finish, schema)
