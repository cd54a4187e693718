"""Supervised subword embeddings for document quality.

A word is the mean of learnt vectors of itself and of its character 3- and 4-grams, all hashed to ``BUCKETS`` rows; a
document is the mean of its words; a softmax layer gives the classes. numpy stochastic gradient descent learns both on
a bounded sample: at most ``FIT_ROWS`` labelled rows, taken by hash of the id. The two layers multiply into one number
for each bucket, so a distinct word is one cached number and a document their mean. Every row is scored on its whole
text. Null and empty texts have no words and score by the bias alone; with nothing to learn from the score is 0.5.
n-grams are of code points, of words of any length.

Labels of one id that differ teach nothing; of rows with one id one is learnt from; a null id has no label. Repeated rows are each scored,
alike. Very long texts are taken whole, one at a time. Columns besides id, text and (of the labels) the label are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, crc_mod_col, release, slices, words_of

BUCKETS, VECTOR, FIT_ROWS, EPOCHS, RATE = 1 << 15, 8, 3000, 12, 0.5
CACHE = 500_000


def subwords(word: bytes) -> list[int]:
    """Buckets of a word and of its n-grams (of code points, ends marked)."""
    w = b"<" + word + b">"
    out = [zlib.crc32(w) % BUCKETS]
    if w.isascii():
        n = len(w)
        out += [zlib.crc32(w[i : i + 3]) % BUCKETS for i in range(n - 2)] + [zlib.crc32(w[i : i + 4], 1) % BUCKETS for i in range(n - 3)]
    else:
        at = [i for i, c in enumerate(w) if c & 0xC0 != 0x80] + [len(w)]  # where code points start
        out += [zlib.crc32(w[i:j]) % BUCKETS for i, j in zip(at, at[3:], strict=False)] + [zlib.crc32(w[i:j], 1) % BUCKETS for i, j in zip(at, at[4:], strict=False)]
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document and their weights, which add up to 1."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint16), np.empty(0, np.float32)
    times: dict[bytes, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    own = [(subwords(w), n) for w, n in times.items()]
    at = np.fromiter((b for s, _ in own for b in s), np.int64)
    weight = np.repeat([n / len(s) for s, n in own], [len(s) for s, _ in own]) / len(words)
    total = np.bincount(at, weight, BUCKETS)
    seen = np.flatnonzero(total)
    return seen.astype(np.uint16), total[seen].astype(np.float32)


class Model:
    """score = 1 / (1 + exp(-(bias + mean over words of a word's number)))"""

    def __init__(self, numbers: np.ndarray, bias: float):
        self.numbers, self.bias = numbers, bias


class Scorer(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.own, self.bias = model.numbers.tolist(), model.bias

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        own = self.own
        s = [own[b] for b in subwords(word)]
        self[word] = x = sum(s) / len(s)
        return x

    def score(self, text):
        words = words_of(text)
        x = self.bias + (math.fsum(map(self.__getitem__, words)) / len(words) if words else 0.0)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def fit(df: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled rows whose crc32 of the id modulo ``modulus`` is not ``held``."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (crc_mod_col("id", modulus) != held))
    own = own.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    chosen = {r.id: r.label for r in own.orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()}  # at most fit_rows
    if not chosen:
        return Model(np.zeros(BUCKETS), 0.0)

    def run(batches):
        for b in slices(batches, 1):
            got = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([w.tobytes() for _, w in got], pa.binary())], names=["id", "at", "weight"])
        release()

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = docs.filter(F.col("id").isin(list(chosen))).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, at binary, weight binary")
    rows = rows.groupBy("id").agg(F.min(F.struct("at", "weight")).alias("row")).select("id", "row.*").collect()  # at most 6 bytes a bucket and row, fit_rows of them
    rows = sorted(((r.id, np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.weight, np.float32)) for r in rows), key=lambda r: r[0])
    return train([(at, w, int(chosen[i])) for i, at, w in rows if len(at)])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Stochastic gradient descent with a falling rate; the rarer class is weighted up at most threefold."""
    if len({y for _, _, y in rows}) < 2:
        return Model(np.zeros(BUCKETS), (4.0 if rows[0][2] else -4.0) if rows else 0.0)
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1, 1, (BUCKETS, VECTOR)) / VECTOR
    out, bias = rng.normal(0, 0.3, (VECTOR, 2)), np.zeros(2)
    share = sum(y for _, _, y in rows) / len(rows)
    up = [min(3.0, 0.5 / (1 - share)), min(3.0, 0.5 / share)]
    done, total = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)).tolist():
            at, w, y = rows[k]
            rate = RATE * (1 - done / total)
            done += 1
            own = vectors[at]
            h = w @ own
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= up[y] * rate
            back = out @ p
            out -= np.outer(h, p)
            bias -= 0.1 * p
            vectors[at] = own - (w / np.sqrt((w * w).sum()))[:, None] * back  # weights are tiny: a step of unit length
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def quality_scores(df: DataFrame, model: Model, threshold: float = 0.7, modulus: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, held_out, score, predicted for every row."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def run(batches):
        scorer = Scorer(shared.value)
        for b in slices(batches, 1):
            scores = [scorer.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([crc_mod(i, modulus) == held for i in b.column(0).to_pylist()], pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[id_col, "held_out", "score", "predicted"])
        scorer.clear()
        release()

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
