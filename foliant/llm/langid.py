"""Language identification by a blended-spectrum string kernel.

Two texts are as alike as their sets of character n-grams of 1 to 4 (presence, not counts; hashed to ``DIM`` places)
overlap, over the root of both sizes. Nyström: the kernel against landmark texts, times the inverse root of the
landmarks' own kernel, gives features; a one-versus-rest kernel ridge regression on them gives a score for each
language. Landmarks, whitening and weights multiply into one matrix, so a batch of texts is scored by one product.

The fit reads a bounded sample of labelled rows: at most ``PER_LANG`` of a language and ``FIT_ROWS`` in all, taken by
hash of the id; of rows with one id, one. Every row is scored on its whole text, a very long one in pieces. The score is the
best language's own regression output, cut to 0..1, so it does not depend on how many languages there are; of equal outputs
the first language by name wins. Null texts and texts without a letter are ``und`` with score 0, and so is every row if
there is nothing to learn from. Rows with a null id or language are not learnt from. Repeated rows are each scored, alike. Columns
besides id, text and (in the fit) language are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LETTER, crc_mod, crc_mod_col, release, slices

DIM_BITS, GRAMS = 14, 4
DIM = 1 << DIM_BITS
PER_LANG, FIT_ROWS, LANDMARKS, RIDGE = 300, 3000, 256, 1e-3
SALTS = 64  # parts of a language in the choice of its sample
PIECE, ROWS = 1 << 16, 64  # characters and texts at a time, which bound a worker's memory
STEP, MULT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def presence(text: str, out: np.ndarray) -> None:
    """Set the places of the text's n-grams in ``out`` (DIM bytes)."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(c), PIECE):  # a very long text in pieces that overlap
        x = c[start : start + PIECE + GRAMS - 1].astype(np.uint64)
        h = np.zeros(len(x), np.uint64)
        for n in range(GRAMS):
            if len(x) <= n:
                break
            h = h[: len(x) - n] * STEP + x[n:] + np.uint64(1)
            out[((h ^ (h >> np.uint64(32))) * MULT) >> np.uint64(64 - DIM_BITS)] = 1


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray):
        self.langs, self.weights, self.bias = langs, weights, bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        own = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        for start in range(0, len(own), ROWS):
            part = own[start : start + ROWS]
            p = np.zeros((len(part), DIM), np.uint8)
            for row, i in zip(p, part, strict=True):
                presence(texts[i], row)
            p = p.astype(np.float32)
            f = (p @ self.weights) / np.sqrt(p.sum(1, keepdims=True)) + self.bias
            f = np.clip(f, 0, 1)
            for i, k, s in zip(part, f.argmax(1).tolist(), f.max(1).tolist(), strict=True):
                out[i] = (self.langs[k], float(s))
        return out


def fit(df: DataFrame, modulus: int = 4, held: int = 2, per_lang: int = PER_LANG, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a language whose crc32 of the id modulo ``modulus`` is not ``held``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & (crc_mod_col("id", modulus) != held))
    # the least hashes of a language's parts, three times what they need on average: no task ranks all rows of a language
    own = rows.select("id", "lang", F.xxhash64("id").alias("hash"), F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)).alias("salt"))
    in_part, in_lang = Window.partitionBy("lang", "salt").orderBy("hash", "id"), Window.partitionBy("lang").orderBy("hash", "id")
    of_parts = own.withColumn("n", F.row_number().over(in_part)).filter(F.col("n") <= max(8, 3 * per_lang // SALTS))
    ids = of_parts.withColumn("n", F.row_number().over(in_lang)).filter(F.col("n") <= per_lang).orderBy("n", "lang", "id").limit(fit_rows)
    chosen = [r.id for r in ids.collect()]  # at most fit_rows ids
    if not chosen:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32))

    def bits(batches):
        for b in slices(batches, 2):
            ids, langs, packed = [], [], []
            for i, lang, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if LETTER.search(t):
                    out = np.zeros(DIM, np.uint8)
                    presence(t, out)
                    ids.append(i)
                    langs.append(lang)
                    packed.append(np.packbits(out).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(langs, pa.string()), pa.array(packed, pa.binary())], names=["id", "lang", "bits"])
        release()

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.filter(F.col("id").isin(chosen) & F.col("text").isNotNull()).select("id", "lang", "text").mapInArrow(bits, f"id {kind}, lang string, bits binary")
    got = got.groupBy("id").agg(F.min(F.struct("lang", "bits")).alias("row")).select("row.*").collect()  # 2 KB a row, at most fit_rows of them
    got = sorted({(r.lang, bytes(r.bits)) for r in got})
    langs = sorted({x for x, _ in got})
    if not langs:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([[float(x == lang) for lang in langs] for x, _ in got])
    rng = np.random.default_rng(7)
    at = rng.permutation(len(got))[:LANDMARKS]
    marks = unit_rows([got[i][1] for i in at])
    values, vectors = np.linalg.eigh(marks @ marks.T)
    ok = values > 1e-8 * values.max()
    white = vectors[:, ok] / np.sqrt(values[ok])
    phi = np.concatenate([unit_rows([b for _, b in got[i : i + ROWS]]) @ marks.T for i in range(0, len(got), ROWS)]) @ white
    mean = y.mean(0)
    centre = phi.mean(0)
    phi0 = phi - centre
    a = np.linalg.solve(phi0.T @ phi0 + RIDGE * len(got) * np.eye(phi.shape[1]), phi0.T @ (y - mean))
    return Model(langs, (marks.T @ white @ a).astype(np.float32), (mean - centre @ a).astype(np.float32))


def unit_rows(packed: list[bytes]) -> np.ndarray:
    """Presence bits of some texts as rows of length 1."""
    p = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in packed]).astype(np.float64)
    return p / np.sqrt(p.sum(1, keepdims=True))


def predict_languages(df: DataFrame, model: Model, modulus: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, held_out, lang_pred, score for every row."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIM floats a language, at most FIT_ROWS languages

    def run(batches):
        for b in slices(batches, 1):
            got = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([crc_mod(i, modulus) == held for i in b.column(0).to_pylist()], pa.bool_()), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])
        release()

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model, min_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """All columns of the rows whose language is known with at least ``min_score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        for b in slices(batches, at):
            got = shared.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([x != "und" and s >= min_score for x, s in got], pa.bool_()))
        release()

    return df.mapInArrow(run, df.schema)
