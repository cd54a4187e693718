"""Quality rules and an n-gram perplexity filter.

A modified Kneser-Ney model of order ``ORDER`` over code points (lower case, white space and control characters as a space,
ASCII digits as ``0``; any script) is counted by Spark from all rows, one model a language. Each part counts its own
n-grams, Spark sums them, derives the continuation counts of the lower orders, the discounts of each language and order, and
the interpolated probability of each n-gram that stands in the corpus by joins on contexts and suffixes. From order
``PRUNED`` on an n-gram seen once keeps nothing (its discount is 1), so that no text is vouched for by itself. The model is
two arrays, 64-bit hashes of language and n-gram in order and their log probabilities, and is searched as such. It grows with
the corpus: up to ``BROADCAST_GRAMS`` n-grams it is broadcast; beyond that it stays distributed by the hash, chunks
of documents send their distinct n-grams there and get the answers back (``exchange``), with equal results.

A document's entropy is the mean negative log probability of its code points, to four decimals; ``perplexity`` is its
exponential. It must lie in its language's band: the quartiles (nearest rank, exact) over that language's documents that
pass the base rules, widened by ``REACH`` times their distance, at least by ``SLACK``. Documents of no language have a model and a band of
their own. Where no document of a language passes the base rules there is no band and nothing to reject by it.

Null and empty texts have no words, fail the base rules, take no part in the counts and have no perplexity. Very long texts
are taken whole, one at a time. Repeated rows count as often as they stand there and get equal results. Columns besides id, text and language
are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import buckets_for, chunks, home, squeeze, tabled, text_bytes, unsqueeze, untabled
from .shared import SPACE, dropped, release, slices, words_of, written

ORDER, PRUNED = 5, 3
REACH, SLACK = 3.0, 0.5
BROADCAST_GRAMS = 8_000_000  # 12 bytes each
PLACES = 4  # decimals of an entropy
PIECE = 1 << 20  # symbols at a time, which bounds a worker's memory
DENSE = 1 << 23  # cells of a ranking table, likewise
HELD = 1_000_000  # n-grams that a part holds before it adds equal ones up
SYMBOLS = frozenset("#*$%&|<>")
STEP, MULT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def symbols(text: str) -> np.ndarray:
    """A text's symbols between the spaces it begins after and the one it ends in."""
    c = np.frombuffer(f"{' ' * (ORDER - 1)}{text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[c <= 32] = 32
    c[(c >= 48) & (c <= 57)] = 48
    return c


def ranked(keys: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Numbers from 0 on in place of keys below ``size``, and how many there are."""
    if size > DENSE:
        own, at = np.unique(keys, return_inverse=True)
        return at.astype(np.int64), len(own)
    seen = np.zeros(size, bool)
    seen[keys] = True
    number = np.cumsum(seen, dtype=np.int32)
    return (number[keys] - 1).astype(np.int64), int(number[-1])


class Grams:
    """The n-grams of some arrays of symbols: ``of`` has the number of each position's n-gram, ``points`` the code points of
    each number, ``edges`` where an array's positions begin."""

    def __init__(self, rows: list[np.ndarray]):
        sizes = np.array([len(r) for r in rows], np.int64)
        c = np.concatenate(rows)
        symbol, n_symbols = ranked(c.astype(np.int64), int(c.max()) + 1)
        of, n = symbol, n_symbols
        for k in range(1, ORDER):
            of, n = ranked(of[:-1] * n_symbols + symbol[k:], n * n_symbols)
        ends = np.cumsum(sizes)
        inside = np.ones(len(of), bool)  # those that lie in one array
        for k in range(1, ORDER):
            inside[(ends - k)[ends - k < len(of)]] = False
        starts = np.flatnonzero(inside)
        self.of, n = ranked(of[starts], n)
        first = np.empty(n, np.int64)
        first[self.of[::-1]] = starts[::-1]
        self.points = c[first[:, None] + np.arange(ORDER)]
        self.counts = np.bincount(self.of, minlength=n)
        self.lengths = sizes - ORDER + 1
        self.edges = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over each array's positions of its n-grams' values."""
        return np.add.reduceat(values[self.of], self.edges)


def seed(lang: str) -> np.uint64:
    return hashed(np.frombuffer(lang.encode("utf-32-le", "surrogatepass"), np.uint32)[None, :], np.uint64(len(lang)))[0]


def hashed(points: np.ndarray, start) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    h = np.zeros(len(points), np.uint64) + start
    for i in range(points.shape[1]):
        h = (h ^ points[:, i]) * MULT
        h = (h ^ (h >> np.uint64(29))) * STEP
        h ^= h >> np.uint64(32)
    return h


def pieces(langs: list[str], texts: list[str | None]):
    """Language, rows and n-grams of about ``PIECE`` symbols of one language at a time; a longer text is cut into pieces whose
    n-grams are those of the text."""
    by_lang: dict[str, list[int]] = {}
    for i, (lang, text) in enumerate(zip(langs, texts, strict=True)):
        if text:
            by_lang.setdefault(lang, []).append(i)
    for lang, rows in by_lang.items():
        of, held, size = [], [], 0
        for i in rows:
            c = symbols(texts[i])
            for start in range(0, len(c) - ORDER + 1, PIECE):
                own = c[start : start + PIECE + ORDER - 1]
                of.append(i)
                held.append(own)
                size += len(own)
                if size >= PIECE:
                    yield lang, of, Grams(held)
                    of, held, size = [], [], 0
        if held:
            yield lang, of, Grams(held)


def count_grams(docs: DataFrame) -> DataFrame:
    """Columns lang, gram, n of all texts (docs: lang, text)."""

    def part(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add_up(lang):
            points, n = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            h = hashed(points, seed(lang))
            order = np.argsort(h, kind="stable")
            at = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            held[lang] = [(points[order[at]], np.add.reduceat(n[order], at))]

        for b in slices(batches, 1):
            for lang, _, grams in pieces(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(lang, []).append((grams.points, grams.counts))
                if sum(len(n) for _, n in held[lang]) > HELD + len(held[lang][0][1]):
                    add_up(lang)
        for lang in list(held):
            add_up(lang)
            (points, n), = held.pop(lang)
            for start in range(0, len(n), 50_000):
                own = np.ascontiguousarray(points[start : start + 50_000]).view(f"<U{ORDER}").ravel().tolist()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.string()), pa.array(n[start : start + 50_000], pa.int64())], names=["lang", "gram", "n"])
        release()

    return docs.mapInArrow(part, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discount(k: int) -> Column:
    """What is taken off a count ``n`` at order k, from the counts of counts n1 to n4 of its language.

    Where these allow no estimate the discounts are 0.5, 1 and 1.5.
    """
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    own = [i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")) for i in (1, 2, 3)]
    sound = functools.reduce(lambda a, b: a & b, [*(F.col(f"n{i}") > 0 for i in (1, 2, 3, 4)), *((d > 0) & (d < i) for i, d in enumerate(own, 1))])
    one, two, three = (F.when(sound, d).otherwise(0.5 * i) for i, d in enumerate(own, 1))
    return F.when(F.col("n") == 1, F.lit(1.0) if k >= PRUNED else one).when(F.col("n") == 2, two).otherwise(three)


def probabilities(counts: DataFrame) -> DataFrame:
    """Columns lang, gram, p for each n-gram of the highest order, from its counts."""
    of_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # below the highest order: in how many contexts a gram is seen
        of_order[k] = written(of_order[k + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "grams")
    lower = of_order[1].groupBy("lang").agg((1 / F.count("*")).alias("below")).withColumn("suffix", F.lit(""))
    used = []
    for k in range(1, ORDER + 1):
        of_counts = of_order[k].groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        own = small(of_counts, of_order[k], "lang").select("lang", "gram", F.expr(f"left(gram, {k - 1})").alias("context"), F.expr("substring(gram, 2)").alias("suffix"), "n", discount(k).alias("less"))
        contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("less").alias("mass"))
        joined = own.join(contexts, ["lang", "context"]).join(lower, ["lang", "suffix"]) if k > 1 else small(lower.drop("suffix"), small(contexts.drop("context"), own, "lang"), "lang")
        p = written(joined.select("lang", "gram", ((F.col("n") - F.col("less") + F.col("mass") * F.col("below")) / F.col("total")).alias("p")), "kneser-ney")
        lower = p.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
        used.append(p)
    dropped(*used[:-1], *(of_order[k] for k in range(1, ORDER)))
    return used[-1]


def small(one: DataFrame, many: DataFrame, key: str, rows: int = 100_000, how: str = "inner") -> DataFrame:
    """``many`` with the columns of ``one``, which has a row a language and is broadcast if these are at most ``rows``."""
    return many.join(F.broadcast(one) if one.limit(rows + 1).count() <= rows else one, key, how)


def hash_table(probs: DataFrame) -> DataFrame:
    """Written table of hash and log p."""

    def run(batches):
        for b in batches:
            points = np.array(b.column(1).to_pylist(), f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)
            langs = b.column(0).dictionary_encode()
            start = np.array([seed(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(hashed(points, start).view(np.int64), pa.int64()), pa.array(np.log(b.column(2).to_numpy()).astype(np.float32), pa.float32())], names=["hash", "log_p"])
        release()

    return written(probs.select("lang", "gram", "p").mapInArrow(run, "hash bigint, log_p float"), "model")


class Model:
    """Sorted hashes of (language, n-gram) and their log probabilities."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.logs = hashes[order], logs[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        return self.logs[np.searchsorted(self.hashes, h)]

    def entropies(self, langs: list[str], texts: list[str | None]) -> list[float | None]:
        sums, lengths = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for lang, of, grams in pieces(langs, texts):
            np.subtract.at(sums, of, grams.sums(self.find(hashed(grams.points, seed(lang))).astype(np.float64)))
            np.add.at(lengths, of, grams.lengths)
        return [round(float(x / n), PLACES) if n else None for x, n in zip(sums, lengths, strict=True)]


def base_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = words_of(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 5:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        if len(numbers) < n:
            own = ids
            for i in range(1, 5):  # exact: pairs of ranks, ranked again
                pair = own[:-1] * (n + 1) + ids[i:]
                if i < 4:
                    own = np.unique(pair, return_inverse=True)[1]
                else:
                    _, own, times = np.unique(pair, return_inverse=True, return_counts=True)
            at = np.flatnonzero(times[own] > 1)
            if len(at):
                edge = np.zeros(n + 1, np.int64)
                edge[at] += 1
                edge[at + 5] -= 1
                repeat = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, dup, repeat


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def rows_of(ids, langs, texts: list[str | None], model: Model) -> pa.RecordBatch:
    found = list(zip(*map(base_features, texts), strict=True)) or [()] * len(FEATURES)
    return pa.RecordBatch.from_arrays([ids, langs, *(pa.array(x, pa.int64()) for x in found), pa.array(model.entropies(langs.to_pylist(), texts), pa.float64())], names=["id", "lang", *FEATURES, "entropy"])


def scored_at_once(docs: DataFrame, table: DataFrame, schema: str) -> DataFrame:
    """With the whole model broadcast: at most BROADCAST_GRAMS n-grams."""
    got = table.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(Model(got.column("hash").to_numpy().view(np.uint64), got.column("log_p").to_numpy()))

    def score(batches):
        for b in slices(batches, 2):
            yield rows_of(b.column(0), b.column(1), b.column(2).to_pylist(), shared.value)
        release()

    return docs.mapInArrow(score, schema)


def scored_by_exchange(docs: DataFrame, table: DataFrame, schema: str) -> DataFrame:
    """With the model in buckets by the hash, each asked once by each chunk of documents."""
    n_buckets = buckets_for(text_bytes(docs, "text"))

    def distinct(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of a chunk's n-grams in order of their buckets, and these."""
        found = [np.unique(hashed(g.points, seed(lang))) for b in slices(rows.to_batches(), 2) for lang, _, g in pieces(b.column(1).to_pylist(), b.column(2).to_pylist())]
        h = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
        to = h.view(np.int64) % n_buckets
        order = np.argsort(to, kind="stable")
        return h[order], to[order]

    def make(rows):
        h, to = distinct(rows)
        edges = np.searchsorted(to, np.arange(n_buckets + 1)).tolist()
        return squeeze(tabled(rows)), {k: squeeze(h[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a}

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"chunk": pa.array([], pa.string()), "bucket": pa.array([], pa.int32()), "answer": pa.array([], pa.binary())})
        model = Model(right.column("hash").to_numpy().view(np.uint64), right.column("log_p").to_numpy())
        found = [squeeze(model.find(np.frombuffer(unsqueeze(k)[0], np.uint64)).tobytes()) for k in left.column("keys").to_pylist()]
        release()
        return pa.table({"chunk": left.column("chunk"), "bucket": left.column("bucket"), "answer": pa.array(found, pa.binary())})

    def finish(payload, answers):
        rows = untabled(unsqueeze(payload)[0])
        model = Model(distinct(rows)[0], np.concatenate([np.frombuffer(unsqueeze(answers[k])[0], np.float32) for k in sorted(answers)] or [np.empty(0, np.float32)]))
        return pa.Table.from_batches([rows_of(b.column(0), b.column(1), b.column(2).to_pylist(), model) for b in slices(rows.combine_chunks().to_batches(), 2)])

    asked = chunks(docs, "text", make, "grams")
    model = table.select(F.pmod("hash", F.lit(n_buckets)).cast("int").alias("bucket"), "hash", "log_p")
    answers = asked.filter("bucket >= 0").select("chunk", "bucket", "keys").groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(answer, "chunk string, bucket int, answer binary")
    return home(asked, answers, finish, schema)


def bands(scored: DataFrame, failed: Column, reach: float, slack: float) -> DataFrame:
    """Columns lang, low, high from the exact quartiles of the entropies; counts by entropy keep a language out of one task."""
    bins = scored.filter(F.col("entropy").isNotNull() & ~failed).groupBy("lang", "entropy").agg(F.count("*").alias("n"))
    upto, every = Window.partitionBy("lang").orderBy("entropy"), Window.partitionBy("lang")
    bins = bins.select("lang", "entropy", F.sum("n").over(upto).alias("upto"), F.sum("n").over(every).alias("n"))
    place = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * q), F.col("entropy")))
    wide = F.greatest(reach * (F.col("q3") - F.col("q1")), F.lit(slack))
    return bins.groupBy("lang").agg(place(0.25).alias("q1"), place(0.75).alias("q3")).select("lang", (F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"))


def quality_rules(df: DataFrame, reach: float = REACH, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Columns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity for every row."""
    lang = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(""))  # no language is one of its own
    docs = df.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text"))
    counts = written(count_grams(docs.select("lang", "text")), "counts")
    probs = probabilities(counts)
    table = hash_table(probs)
    schema = f"id {docs.schema['id'].dataType.simpleString()}, lang string, {', '.join(f'{c} bigint' for c in FEATURES)}, entropy double"
    by = scored_at_once if table.limit(broadcast_grams + 1).count() <= broadcast_grams else scored_by_exchange
    scored = written(by(docs, table, schema), "perplexity")
    dropped(counts, probs, table)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    limits = small(bands(scored, failed, reach, slack), scored, "lang", how="left")
    inside = F.coalesce((F.col("entropy") >= F.col("low")) & (F.col("entropy") <= F.col("high")), F.lit(True))
    return limits.select(F.col("id").alias(id_col), *FEATURES, failed.alias("base_failed"), (~failed & inside).alias("kept"), F.exp("entropy").alias("perplexity"))
