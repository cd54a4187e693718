"""Arrow batches of the lexical search: a passage's words counted, matched with a block of queries, and dealt as postings.

A query's words all have to stand in a passage, so a passage is decided where it is read: no row of a query and a passage
exists before the passage is known to hold all words, and a batch sends only the best k of each query on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Columns of a passage's counts: one entry for each of the words asked that it holds.
COUNTS = "length int, codes array<int>, n_title array<int>, n_text array<int>"


def kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def listed(offsets: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))


def rows_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each value, and each row's values."""
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return np.repeat(np.arange(len(lists)), sizes), sizes


def cut(batches, *columns: int, limit: int = 1 << 20):
    """The batches in parts of at least a row and about ``limit`` values of their lists: arrays are made of one part at a time."""
    for b in batches:
        ends = np.cumsum(sum(np.diff(b.column(c).offsets.to_numpy()).astype(np.int64) for c in columns))
        start = 0
        while start < b.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield b.slice(start, stop - start)
            start = stop


def codes_of(flat: pa.Array, words: pa.Array) -> np.ndarray:
    """Places of the values in ``words``, -1 for others."""
    return pc.fill_null(pc.index_in(flat, value_set=words.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def counted(docs: DataFrame, words: list[str]) -> DataFrame:
    """Columns id, category and ``COUNTS`` of each passage of ``tokenised``, with codes that are places in ``words``. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        words, n_words = pa.array(shared.value, pa.string()), max(1, len(shared.value))
        for b in cut(batches, 2, 3):
            sums, length = [], np.zeros(b.num_rows, np.int64)
            for column in (2, 3):
                row, sizes = rows_of(b.column(column))
                code = codes_of(b.column(column).flatten(), words)
                sums.append(np.unique((row * n_words + code)[code >= 0], return_counts=True))
                length += sizes
            keys = np.union1d(sums[0][0], sums[1][0]).astype(np.int64)
            offsets = np.searchsorted(keys, np.arange(b.num_rows + 1) * n_words)
            counts = [listed(offsets, keys % n_words)]
            for own, n in sums:
                all_n = np.zeros(len(keys), np.int64)
                all_n[np.searchsorted(keys, own)] = n
                counts.append(listed(offsets, all_n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(length, pa.int32()), *counts], names=["id", "category", "length", "codes", "n_title", "n_text"])

    return docs.select("id", "category", "of_title", "of_text").mapInArrow(run, f"id {kind(docs, 'id')}, category {kind(docs, 'category')}, {COUNTS}")


def best(counts: DataFrame, ids: list, asked: list[list[int]], idf: list[float], mean: float, weights: list[tuple[float, float]], k: int | None, k1: float, b_: float, query_type: DataType) -> DataFrame:
    """Columns query_id, id, score and ``of``, the place of the weights: for each query (``ids``, and the codes of its words in order)
    the passages that hold all its words; with ``k`` at most k of a batch, the first of equals by their ids. Narrow."""
    sizes = np.array([len(x) for x in asked], np.int64)
    shared = counts.sparkSession.sparkContext.broadcast((ids, np.array([c for x in asked for c in x], np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array(idf, np.float64)))
    own_type = to_arrow_type(query_type)

    def run(batches):
        ids, flat, starts, idf = shared.value
        for b in cut(batches, 2) if len(flat) else ():
            b = b.take(pc.sort_indices(b.column(0), null_placement="at_start"))  # ties below then come in the order of the ids
            row, _ = rows_of(b.column(2))
            code, n_title, n_text = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3, 4))
            order = np.argsort(code, kind="stable")  # by word, then by row
            row, n_title, n_text = row[order], n_title[order].astype(np.float64), n_text[order].astype(np.float64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(idf)))])
            norm = k1 * (1 - b_ + b_ * b.column(1).to_numpy(zero_copy_only=False).astype(np.float64) / mean)
            some = np.flatnonzero(starts[1:] > starts[:-1])  # queries with words
            least = np.minimum.reduceat(ends[flat + 1] - ends[flat], starts[some])
            q_out, at_out, score_out, of_out = [], [], [], []
            for q in some[least > 0]:
                own = flat[starts[q] : starts[q + 1]]
                rare = own[np.argsort(ends[own + 1] - ends[own], kind="stable")]
                found = row[ends[rare[0]] : ends[rare[0] + 1]]
                for c in rare[1:]:
                    there = row[ends[c] : ends[c + 1]]
                    found = found[there[np.minimum(np.searchsorted(there, found), len(there) - 1)] == found]
                    if not len(found):
                        break
                if not len(found):
                    continue
                places = [(c, ends[c] + np.searchsorted(row[ends[c] : ends[c + 1]], found)) for c in own]
                for of, (title_weight, text_weight) in enumerate(weights):
                    score = np.zeros(len(found))
                    for c, at in places:  # in the order of the query's words: equal passages get equal scores
                        f = title_weight * n_title[at] + text_weight * n_text[at]
                        score -= idf[c] * f * (k1 + 1) / (f + norm[found])
                    first = np.arange(len(found))
                    if k is not None and len(first) > k:
                        first = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
                        first = first[np.argsort(score[first], kind="stable")[:k]]
                    q_out.append(np.full(len(first), q))
                    of_out.append(np.full(len(first), of))
                    at_out.append(found[first])
                    score_out.append(score[first])
            if q_out:
                of_query = pa.array(ids, own_type).take(pa.array(np.concatenate(q_out)))
                yield pa.RecordBatch.from_arrays([of_query, b.column(0).take(pa.array(np.concatenate(at_out))), pa.array(np.concatenate(score_out)), pa.array(np.concatenate(of_out), pa.int32())], names=["query_id", "id", "score", "of"])

    return counts.select("id", "length", "codes", "n_title", "n_text").mapInArrow(run, f"query_id {query_type.simpleString()}, id {kind(counts, 'id')}, score double, of int")


#: Postings of a packed segment, and what stands beside each term in it. Numbers are stored by the places of their bytes, which pack best.
SEGMENT = 4096
LISTS = ["id", "category", "length", "n_title", "n_text", "at"]
SPLIT = {f"{c}.list.element": "BYTE_STREAM_SPLIT" for c in ("length", "n_title", "n_text", "at.list.element")}


def packed(docs: DataFrame, every: str) -> DataFrame:
    """Columns first, first_id and packed: the postings of a batch of passages by term, cut in the order of the terms into
    segments of about ``SEGMENT`` postings, each a small Parquet file. Segments with first ``every`` have all passages, without places. Narrow.

    Postings of a term are in the order of the ids, the places of each ascending.
    """

    def segment(rows: pa.RecordBatch) -> bytes:
        out, split = pa.BufferOutputStream(), SPLIT | ({"id.list.element": "BYTE_STREAM_SPLIT"} if pa.types.is_integer(rows.schema.field("id").type.value_type) else {})
        pq.write_table(pa.Table.from_batches([rows]), out, compression="zstd", use_dictionary=["category.list.element"], column_encoding=split, write_statistics=False)
        return out.getvalue().to_pybytes()

    def run(batches):
        for b in cut(batches, 2, 3):
            n = b.num_rows
            b = b.take(pc.sort_indices(b.column(0), null_placement="at_start"))
            (title_row, title_n), (text_row, text_n) = rows_of(b.column(2)), rows_of(b.column(3))
            place = lambda sizes: np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            coded = pa.concat_arrays([b.column(2).flatten(), b.column(3).flatten()]).dictionary_encode()
            by_term = pc.sort_indices(coded.dictionary)
            rank = np.empty(len(by_term), np.int64)
            rank[by_term.to_numpy()] = np.arange(len(by_term))
            code = rank[coded.indices.to_numpy(zero_copy_only=False)]
            # places in the text count down from -1, so the text goes backwards, then the title
            code = np.concatenate([code[len(title_row) :][::-1], code[: len(title_row)]])
            key = code * n + np.concatenate([text_row[::-1], title_row])
            at = np.concatenate([-1 - place(text_n)[::-1], place(title_n)])
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order].astype(np.int32)
            del code, order
            starts = np.flatnonzero(np.diff(key, prepend=-1))  # of the postings
            ends = np.append(starts, len(key))
            below = np.concatenate([[0], np.cumsum(at < 0)])
            n_text = below[ends[1:]] - below[ends[:-1]]
            row, term = key[starts] % n, key[starts] // n
            offsets = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))  # of the terms
            length = pa.array(title_n + text_n, pa.int32())

            def rows(terms, offsets, row, n_title, n_text, ends, at, b=b, length=length):
                own = [b.column(0).take(row), b.column(1).take(row), length.take(row), pa.array(n_title, pa.int32()), pa.array(n_text, pa.int32()), listed(ends, at)]
                return pa.RecordBatch.from_arrays([terms, *(listed(offsets, x) for x in own)], names=["term", *LISTS])

            none = np.zeros(n, np.int64)
            parts = [rows(pa.array([every]), np.array([0, n]), pa.array(np.arange(n)), none, none, np.zeros(n + 1, np.int64), none[:0])]
            if len(term):
                every_term = rows(coded.dictionary.take(by_term), offsets, pa.array(row), np.diff(ends) - n_text, n_text, ends, at)
                cuts = np.append(np.flatnonzero(np.diff(offsets[:-1] // SEGMENT, prepend=-1)), len(offsets) - 1)
                parts += [every_term.slice(i, j - i) for i, j in zip(cuts, cuts[1:])]
            firsts = pa.array([p.column(0)[0].as_py() for p in parts]), pa.concat_arrays([p.column(1).slice(0, 1).flatten().slice(0, 1) for p in parts])
            yield pa.RecordBatch.from_arrays([*firsts, pa.array([segment(p) for p in parts], pa.binary())], names=["first", "first_id", "packed"])

    return docs.select("id", "category", "of_title", "of_text").mapInArrow(run, f"first string, first_id {kind(docs, 'id')}, packed binary")


def unpacked(segments: DataFrame, category_kind: str) -> DataFrame:
    """Columns term and lists id, category, length, n_title, n_text, at of packed segments, a row each term. Narrow."""

    def run(batches):
        for b in batches:
            for x in b.column(0):
                yield from pq.read_table(pa.BufferReader(x.as_buffer()), use_threads=False).to_batches()

    return segments.select("packed").mapInArrow(run, f"term string, id array<{kind(segments, 'first_id')}>, category array<{category_kind}>, length array<int>, n_title array<int>, n_text array<int>, at array<array<int>>")


def postings(lists: DataFrame) -> DataFrame:
    """A row each posting."""
    return lists.select("term", F.inline(F.arrays_zip(*LISTS)).alias(*LISTS))


def runs_held(docs: DataFrame, ids: list, items: list[list[str]], most: int, id_type: DataType) -> DataFrame:
    """Columns item_id and url of the documents (url, w: words) that hold a run of ``most`` words of an item, or all of a shorter one; may repeat. Narrow.

    Words are numbers of the items' vocabulary. A bit map of the runs' hashes sieves the places of a text; what passes is compared.
    """
    words = {w: i for i, w in enumerate(sorted({w for x in items for w in x}))}
    by_size: dict[int, list] = {}
    for i, x in enumerate(items):
        m = min(len(x), most)
        by_size.setdefault(m, []).extend([[i, *(words[w] for w in x[j : j + m])] for j in range(len(x) - m + 1)] if m else [])
    own_type = to_arrow_type(id_type)
    shared = docs.sparkSession.sparkContext.broadcast((ids, list(words), {m: np.unique(np.array(r, np.int64), axis=0) for m, r in by_size.items() if r}))

    def hashed(code: np.ndarray, n: int, m: int) -> np.ndarray:
        """Of the m numbers from each of the first n places on; the upper bits are mixed best."""
        out = np.zeros(n, np.uint64)
        for j in range(m):
            out = (out ^ code[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)

    def run(batches):
        ids, words, asked = shared.value
        words, tables = pa.array(words, pa.string()), []
        for m, runs in asked.items():
            of_run = np.array([hashed(r, 1, m)[0] for r in runs[:, 1:]], np.uint64)
            order, sieve = np.argsort(of_run, kind="stable"), np.zeros(1 << 22, bool)
            sieve[of_run >> np.uint64(42)] = True
            tables.append((m, of_run[order], runs[order], sieve))
        for b in cut(batches, 1):
            row, _ = rows_of(b.column(1))
            code = codes_of(b.column(1).flatten(), words)
            alien = np.concatenate([[0], np.cumsum(code < 0)])
            pairs = []
            for m, of_run, runs, sieve in tables:
                n = len(code) - m + 1
                if n <= 0:
                    continue
                at = np.flatnonzero((row[:n] == row[m - 1 :]) & (alien[m:] == alien[:-m]))
                if not len(at):
                    continue
                h = hashed(code, n, m)[at]
                passed = sieve[h >> np.uint64(42)]
                at, h = at[passed], h[passed]
                low, high = np.searchsorted(of_run, h), np.searchsorted(of_run, h, "right")
                n_same = high - low
                place = np.repeat(low - np.cumsum(n_same) + n_same, n_same) + np.arange(n_same.sum())  # each run of equal hash
                at = np.repeat(at, n_same)
                same = (code[at[:, None] + np.arange(m)] == runs[place, 1:]).all(axis=1)
                pairs.append(np.stack([runs[place[same], 0], row[at[same]]], axis=1))
            found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(ids, own_type).take(pa.array(found[:, 0])), b.column(0).take(pa.array(found[:, 1]))], names=["item_id", "url"])

    return docs.select("url", "w").mapInArrow(run, f"item_id {id_type.simpleString()}, url string")
