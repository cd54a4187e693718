"""Probability of a text over all its segmentations into the pieces of an existing vocabulary.

A word's lattice has a node for each character and an edge for each vocabulary piece; a forward recursion in log space
sums the probabilities of all paths. Pieces never reach across words, so a text's log probability is the sum of its
words' and of the end's. Pieces come from an existing vocabulary file. That file is one of merges and holds ranks, no unigram
scores; so the pieces' log probabilities are counted over all training rows, from the file's own cut of each distinct word times the
word's count, with one added to each piece. Words meet once in the corpus (``exchange``): counts are exact and each
distinct word is scored once.

Null and empty texts have the end token alone. Rows with a null id count as training rows. Repeated rows count as often
as they stand there. With no training rows every count is zero and the piece probabilities are equal. Very long texts are
taken whole; a worker holds a chunk of texts at a time. Columns besides id and text are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ask, buckets_for, chunks, home, pack_strings, planes, squeeze, tabled, text_bytes, unpack_strings, unplanes, unsqueeze, untabled
from .shared import crc_mod, words_of

MARK = "▁"
END = b""  # no word is empty


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[str | None]]:
    """The library's processor, and the pieces that may stand in a word by id; None for the others."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return sp, [None if sp.is_control(i) or sp.is_unknown(i) or MARK in p[1:] else p for i, p in enumerate(own)]


class Lattice:
    """Log10 probabilities of words from piece probabilities (natural logs by id)."""

    def __init__(self, path: str, logs: np.ndarray):
        sp, pieces = vocabulary(path)
        self.bytes = [0.0] * 256
        self.logs: dict[str, float] = {}
        for i, p in enumerate(pieces):
            if p is None:
                continue
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = float(logs[i])
            else:
                self.logs[p] = float(logs[i])
        longest: dict[str, int] = {}
        for p in self.logs:
            longest[p[0]] = max(longest.get(p[0], 0), len(p))
        self.longest = longest

    def word(self, word: str) -> float:
        """Log10 of the sum over all segmentations; a character that is no piece is spelled in bytes."""
        s = MARK + word
        n, logs, longest = len(s), self.logs, self.longest
        forward: list[float | None] = [None] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            at = forward[i]
            c = s[i]
            if c not in logs:
                x = at + sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass"))
                old = forward[i + 1]
                forward[i + 1] = x if old is None else max(old, x) + math.log1p(math.exp(-abs(old - x)))
            for j in range(i + 1, min(n, i + longest.get(c, 0)) + 1):
                w = logs.get(s[i:j])
                if w is not None:
                    x, old = at + w, forward[j]
                    forward[j] = x if old is None else max(old, x) + math.log1p(math.exp(-abs(old - x)))
        return forward[n] / math.log(10)


def piece_logs(path: str, counts: dict[int, int], ends: int) -> tuple[np.ndarray, float]:
    """Natural logs of (count + 1) / (all + pieces + 1) by id, and of the end."""
    _, pieces = vocabulary(path)
    usable = np.array([p is not None for p in pieces])
    c = np.zeros(len(pieces))
    for i, n in counts.items():
        c[i] = n
    c[~usable] = 0
    total = c.sum() + ends + usable.sum() + 1
    return np.where(usable, np.log((c + 1) / total), -np.inf), math.log((ends + 1) / total)


def lattice_scores(df: DataFrame, path: str, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Rows whose crc32 of the id modulo ``modulus`` is ``held`` are scored but never learnt from.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    n_buckets = buckets_for(text_bytes(docs, "text"))

    def make(table: pa.Table):
        numbers, rows, sizes, held_out = {}, [], [], []
        learnt = []
        ends = 0
        for i, text in zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True):
            own = words_of(text)
            own = [w.lower() for w in own]
            x = np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.uint32, len(own))
            rows.append(x)
            sizes.append(len(own))
            held_out.append(crc_mod(i, modulus) == held)
            if not held_out[-1]:
                learnt.append(x)
                ends += 1
        numbers[END] = len(numbers)
        counts = np.bincount(np.concatenate(learnt), minlength=len(numbers)).astype(np.uint64) if learnt else np.zeros(len(numbers), np.uint64)
        counts[-1] = ends
        keys = list(numbers)
        to = np.fromiter((xxhash.xxh3_64_intdigest(k) % n_buckets for k in keys), np.uint16, len(keys))
        out = {}
        for b in np.unique(to).tolist():
            at = np.flatnonzero(to == b)
            out[b] = squeeze(*pack_strings([keys[i] for i in at.tolist()]), planes(counts[at]))
        flat = np.concatenate(rows) if rows else np.empty(0, np.uint32)
        return squeeze(tabled(table.select(["id"])), np.array(sizes, np.uint32).tobytes(), np.array(held_out, np.uint8).tobytes(), planes(flat), planes(to)), out

    def merged(blobs):
        """Words of a bucket with their training counts, and each chunk's words as indexes of them."""
        numbers, where, counts = {}, [], []
        for blob in blobs:
            *packed, n = unsqueeze(blob)
            own = unpack_strings(*packed)
            where.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own)))
            counts.append(unplanes(n, np.uint64))
        total = np.zeros(len(numbers), np.uint64)
        for w, n in zip(where, counts, strict=True):
            total[w] += n  # a chunk sends a word once
        return list(numbers), total, where

    def tally(group: pa.Table) -> pa.Table:
        keys, total, _ = merged(group.column("keys").to_pylist())
        sp, _ = vocabulary(path)
        pieces = np.zeros(sp.get_piece_size(), np.int64)
        learnt = np.flatnonzero(total)
        ends = 0
        for start in range(0, len(learnt), 20_000):
            at = learnt[start : start + 20_000].tolist()
            ends += sum(int(total[i]) for i in at if keys[i] == END)
            at = [i for i in at if keys[i] != END]
            own = sp.encode([keys[i].decode("utf-8", "surrogatepass") for i in at], num_threads=1)
            if own:
                lengths = np.fromiter(map(len, own), np.int64, len(own))
                pieces += np.bincount(np.fromiter((t for x in own for t in x), np.int64, lengths.sum()), np.repeat(total[at].astype(np.float64), lengths), len(pieces)).astype(np.int64)
        seen = np.flatnonzero(pieces)
        return pa.table({"piece": pa.array([*seen.tolist(), -1, -2, -3], pa.int32()), "n": pa.array([*pieces[seen].tolist(), int(total.sum()), len(learnt), ends], pa.int64())})

    table = chunks(docs, "text", make, "lattice")
    sums = table.filter("bucket >= 0").select("bucket", "keys").groupBy("bucket").applyInArrow(tally, "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    sums = {r.piece: r.n for r in sums.collect()}  # at most one row for each piece of the vocabulary
    n_all, n_distinct, ends = sums.pop(-1, 0), sums.pop(-2, 0), sums.pop(-3, 0)
    logs, end_log = piece_logs(path, sums, ends)

    def resolve(_, blobs):
        keys, total, where = merged(blobs)
        lattice = Lattice(path, logs)
        scores = np.array([end_log / math.log(10) if k == END else lattice.word(k.decode("utf-8", "surrogatepass")) for k in keys])
        return [squeeze(planes(total[w]), scores[w].tobytes()) for w in where]

    def finish(payload, answers):
        ids, sizes, held_out, flat, to = unsqueeze(payload)
        sizes, flat, to = np.frombuffer(sizes, np.uint32), unplanes(flat, np.uint32), unplanes(to, np.uint16)
        c, s = np.zeros(len(to), np.uint64), np.zeros(len(to))
        for b, blob in answers.items():
            n, scores = unsqueeze(blob)
            at = np.flatnonzero(to == b)
            c[at], s[at] = unplanes(n, np.uint64), np.frombuffer(scores)
        base, known = np.log10(c.astype(np.float64) + 1), c > 0
        least = math.log10(n_all + n_distinct + 1)
        out, start = [], 0
        for n in sizes.tolist():
            own = flat[start : start + n]
            start += n
            out.append((n + 1, int(known[own].sum() + known[-1]), float(base[own].sum() + base[-1]) - (n + 1) * least, float(s[own].sum() + s[-1])))
        columns = list(zip(*out, strict=True))
        return pa.table({id_col: untabled(ids).column("id"), "held_out": pa.array(np.frombuffer(held_out, np.uint8).astype(bool)), "n_tokens": pa.array(columns[0], pa.int64()), "n_known": pa.array(columns[1], pa.int64()), "train_tokens": pa.array([n_all] * len(out), pa.int64()), "base_score": pa.array(columns[2], pa.float64()), "score": pa.array(columns[3], pa.float64())})

    return home(table, ask(table, resolve), finish, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
