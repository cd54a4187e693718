"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of five words (lower-cased), each labelled with how many like it came before. A sketch
takes the ``KEEP`` least of them under its own hash and keeps them in text order, so it is equal in two texts with a
chance that falls with their edit distance, not just with the overlap of their sets. ``SKETCHES`` of these are drawn
from runs of five words and as many from runs of three, and texts of up to ``FEW`` words are also found by what is left of
them without some words, which misses no edge between two of them. Of pairs with scattered replaced words at an edit
similarity of 0.8, the lowest, simulated pairs miss all buckets in 4 of 100 cases at 200 words, 7 at 50 and 18 at 15
(README); classes are held together by more than one pair.

Texts with equal words are one node. In each bucket of a sketch, and in the finer buckets of that sketch with the two
after it, each node is first compared with the first node that it shares most buckets with (``ROOTS`` of
these), and the classes of these edges are found; then, where a bucket still has several classes, with its first and last node. What
a bucket leaves undecided, pairs of nodes in different classes, is decided exactly: in buckets of up to
``FEW_NODES`` nodes by all their pairs; nodes of more crowded ones by a prefix filter. Two texts with an edge share one of the
rarest words of each (a fifth of them and one more, in one order of all words), so only nodes that share such a word are looked at, and of
these pairs only those go on whose common frequent words, counted exactly, and the places of the shared word leave an edge possible; this finds
every edge between nodes of crowded buckets. So each pair that shares a bucket is in one class already, is compared, or is
excluded by a lower bound of its distance (lengths, word profiles, shared rare words). An edge holds if the words of
both align within a band of ``1 - THRESHOLD`` of the longer; classes are the connected components of the edges. Nothing
of the documents comes to the driver but counts of the ``COMMON`` most frequent words.

Rows with no words are classes of their own; a class's id is the least id in it. Rows with a null id belong
to the class of their text. Repeated rows share a class. Very long texts are taken whole; their
alignment first tries the words that each has once. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import ranked
from .shared import dropped, fresh, release, slices, words_of, written

K, KEEP, SKETCHES, THRESHOLD = 5, 2, 20, 0.8
SHORT_K = 3  # words of the k-mers of the second sketches
FEW, DROPS = 14, 2  # texts of up to FEW words are found by what is left without up to DROPS of them
LEVELS = (1, 3)
BINS = 256  # of a word profile
ROOTS = 1  # first nodes of buckets that a node is compared with before any other: in a large group one is enough, what it misses comes after
FEW_NODES = 16  # a bucket of so many nodes has its pairs compared one by one
TOP = 512  # tokens that are bits of a map, 64 a column: the more, the fewer pairs meet and the wider their rows
REPEATS = 4  # of a word's occurrences in a text, those from here on are only counted
COMMON = 1 << 16  # words whose frequency orders prefixes; all others count as rare
LONG = 5000  # words from which an alignment is first tried by anchors
PIECE = 1 << 14  # k-mers at a time, which bounds a worker's memory
STEP, MULT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.random.default_rng(20).integers(1, 2**63, (SKETCHES, 2), dtype=np.uint64) | np.uint64(1)
_SHORT_SEEDS = np.random.default_rng(21).integers(1, 2**63, (SKETCHES, 2), dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MULT
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


class Words(dict):
    def __missing__(self, word):
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def lowered(text: str | None) -> list[bytes]:
    return words_of(text.lower()) if text else []


def kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the occurrence-labelled runs of k words; a shorter text is one run."""
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = out * STEP + h[i : i + n]
    out = mixed(out)
    order = np.argsort(out, kind="stable")
    own = out[order]
    first = np.append(True, own[1:] != own[:-1])
    if not first.all():
        at = np.arange(n)
        label = np.empty(n, np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        out = mixed(out + label * MULT)
    return out


def sketches(h: np.ndarray, k: int = K, seeds: np.ndarray = _SEEDS) -> np.ndarray:
    """Order MinHash sketches of a text's word hashes."""
    m = kmers(h, k)
    best_hash, best_at, best_mer = None, None, None
    rows = np.arange(SKETCHES)
    for start in range(0, len(m), PIECE):
        own = m[start : start + PIECE]
        x = own[None, :] * seeds[:, :1]
        x ^= seeds[:, 1:]
        x ^= x >> np.uint64(33)
        x *= MULT
        least = []
        for _ in range(min(KEEP, x.shape[1])):  # a few times the least is faster than a partial sort
            at = x.argmin(1)
            least.append((at, x[rows, at]))
            x[rows, at] = np.uint64(2**64 - 1)
        at = np.stack([a for a, _ in least], 1)
        got = np.stack([h for _, h in least], 1), at + start, own[at]
        if best_hash is not None:
            got = tuple(np.concatenate(p, 1) for p in zip((best_hash, best_at, best_mer), got, strict=True))
            keep = np.argsort(got[0], axis=1)[:, :KEEP]
            got = tuple(np.take_along_axis(g, keep, 1) for g in got)
        best_hash, best_at, best_mer = got
    mers = np.take_along_axis(best_mer, np.argsort(best_at, axis=1), 1)
    out = np.zeros(SKETCHES, np.uint64)
    for i in range(mers.shape[1]):
        out = mixed(out * STEP + mers[:, i])
    return out


def bands(s: np.ndarray) -> np.ndarray:
    """Bucket keys: each sketch (of the last axis) alone, and each with the ones after it."""
    number = np.arange(SKETCHES, dtype=np.uint64)
    out = []
    for level in LEVELS:
        x = mixed(number + np.uint64(1000 * level))
        for i in range(level):
            x = mixed(x * STEP + np.roll(s, -i, -1))
        out.append(x)
    return np.concatenate(out, -1).view(np.int64)


def remainders(h: np.ndarray) -> np.ndarray:
    """Hashes of a short text without each choice of up to DROPS words: at the default threshold any two texts of up to FEW
    words that have an edge share one, since an edit takes at most one word out of each."""
    n = len(h)
    if not n or n > FEW:
        return np.empty(0, np.uint64)
    found = []
    for places in stays(n):
        x = np.full(len(places), places.shape[1] + 5000, np.uint64)
        for i in range(places.shape[1]):
            x = mixed(x * STEP + h[places[:, i]])
        found.append(x)
    return np.unique(np.concatenate(found))


@functools.cache
def stays(n: int) -> list[np.ndarray]:
    """The places that stay of n, a row for each choice of those that go, by how many go."""
    edits = [(m, int((1 - THRESHOLD) * m + 1e-9)) for m in range(n, FEW + 1)]
    drops = min(DROPS, max(most for m, most in edits if m - most <= n))
    return [np.array(list(itertools.combinations(range(n), n - r)), np.int64).reshape(-1, n - r) for r in range(drops + 1)]


def bucket_keys(h: np.ndarray) -> np.ndarray:
    """All bucket keys of a text: bands of both kinds of sketches, and remainders of short texts."""
    return keys_of_all([h])[0]


def keys_of_all(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The bucket keys of each text; what follows the sketches is done for all texts at once."""
    if not texts:
        return []
    short = np.stack([sketches(h, SHORT_K, _SHORT_SEEDS) for h in texts])
    short = mixed(mixed(np.arange(SKETCHES, dtype=np.uint64) + np.uint64(9000)) * STEP + short).view(np.int64)
    both = np.concatenate([bands(np.stack([sketches(h) for h in texts])), short], 1)
    return [np.concatenate([b, remainders(h).view(np.int64)]) if len(h) <= FEW else b for b, h in zip(both, texts, strict=True)]


def distance(a: list[int], b: list[int], most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, by bit-parallel columns of a band about the diagonal."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return None
    if not m:
        return n
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    # rows i of column j are kept for j - most <= i < j + most + 1; bit 0 is row j - most
    size = min(2 * most + 1, 2 * n + 1)
    half = size // 2
    mask = (1 << size) - 1
    vp, vn, score = (mask << half) & mask, 0, half
    # column 0 in band coordinates: rows -half..half; vertical differences are +1 below row 0
    low = half  # value on the band's lowest row (row j + half), counted down its diagonal
    for j, x in enumerate(b):
        shift = j - half
        pm = where.get(x, 0)
        pm = (pm >> shift if shift >= 0 else pm << -shift) & mask
        d0 = ((((pm & vp) + vp) & mask) ^ vp) | pm | vn
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        if not d0 >> (size - 1) & 1:
            low += 1
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
        if low - 2 * half > most:
            return None
    # value at row n, column m: climb from the band's lowest row, m + half
    value = low
    for i in range(m + half, n, -1):
        bit = i - 1 - (m - half)
        if bit < size:
            value -= (vp >> bit & 1) - (vn >> bit & 1)
    return value if value <= most else None


def anchored(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether an alignment through words that each text has once, in order, is within ``most``; if not nothing is known."""
    one, two = (dict(zip(*(v.tolist() for v in np.unique(x, return_index=True)), strict=True)) for x in (a, b))
    single = [set(w[c == 1].tolist()) for w, c in (np.unique(x, return_counts=True) for x in (a, b))]
    places = sorted((one[w], two[w]) for w in single[0] & single[1])
    ends: list[int] = []  # the longest rising run of places, by its ends
    chain: list[int] = []
    back = [-1] * len(places)
    for k, (_, y) in enumerate(places):
        at = bisect.bisect_left(ends, y)
        back[k] = chain[at - 1] if at else -1
        ends[at : at + 1], chain[at : at + 1] = [y], [k]
    k, run = chain[-1] if chain else -1, [(len(a), len(b))]
    while k >= 0:
        run.append(places[k])
        k = back[k]
    total, i, j = 0, 0, 0
    for x, y in reversed(run):
        n, m = x - i, y - j
        if n and m:
            own = distance(a[i:x].tolist(), b[j:y].tolist(), min(most - total, max(n, m))) if max(n, m) < LONG else max(n, m)
            total += most + 1 if own is None else own
        else:
            total += n + m
        if total > most:
            return False
        i, j = x + 1, y + 1
    return True


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    longest = max(len(a), len(b))
    most = int((1 - threshold) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if longest >= LONG and anchored(a, b, most):
        return True
    return distance(a.tolist(), b.tolist(), most) is not None


def profile(words: np.ndarray) -> bytes:
    """How many words fall in each bin of their hash, up to 255."""
    return np.minimum(np.bincount(words % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


def near_profiles(a: list[bytes], b: list[bytes], size_a: list[int], size_b: list[int], threshold: float = THRESHOLD) -> np.ndarray:
    """Whether sizes (bytes of the words, four each) and profiles leave an edge possible: each edit takes at most
    one word out of a bin and puts one in."""
    x, y = (np.frombuffer(b"".join(p), np.uint8).reshape(-1, BINS).astype(np.int16) for p in (a, b))
    n, m = np.array(size_a, np.int64) // 4, np.array(size_b, np.int64) // 4
    most = ((1 - threshold) * np.maximum(n, m) + 1e-9).astype(np.int64)
    more, less = (np.maximum(d, 0).sum(1, dtype=np.int64) for d in (x - y, y - x))
    return (np.abs(n - m) <= most) & (more <= most) & (less <= most)


def size_class(size: str, threshold: float):
    """Texts whose lengths allow an edge are in one class or in two that follow one another."""
    if threshold < 0.1:
        return F.lit(0)
    return F.floor(F.log(size) / -math.log(threshold - 0.01)).cast("int")


def all_pairs(rest: DataFrame) -> DataFrame:
    """All pairs of a bucket's nodes in different classes whose lengths allow an edge."""
    a = rest.select("band", "size", F.col("node").alias("root"), F.col("label").alias("of"))
    b = rest.select("band", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), "node", "label")
    return a.join(b, ["band", "size"]).filter((F.col("root") < F.col("node")) & (F.col("of") != F.col("label"))).select("root", "node").distinct()


def occurrences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's words in order of their hash, how many like it came before each, and the place of each."""
    place = np.argsort(words, kind="stable")
    own = words[place]
    first = np.append(True, own[1:] != own[:-1])
    at = np.arange(len(own))
    return own, at - np.maximum.accumulate(np.where(first, at, 0)), place


def rare_pairs(crowd: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes (crowd: node, label, words) in different classes that may have enough words in common for an edge.

    A token is a word with how many like it came before. Of a longer text with n words and one with m, an edge aligns at least ``n - most``
    tokens of both, and one more for each word of the other that is put in. The ``TOP`` most frequent tokens are bits of a map, so two texts'
    common ones are counted as they meet; of tokens from the ``REPEATS``-th of a word on only the number is known, and the lesser counts as common.
    What is then still needed are ordinary tokens: in any one order of all, the first that both have aligned has no more before it than the text
    can spare, and its places in both give a lower bound of the words put in. Pairs that need no ordinary token meet at the rarest
    of the map's tokens that they share; it too is within the first ``most`` and one of each, ordinary tokens first and repeats last.
    """

    def tally(batches):
        """Of each word: how often it stands, and in how many texts at least 1, 2, .. ``REPEATS`` times."""
        for b in slices(batches, 2):
            found = [occurrences(np.frombuffer(raw, np.uint32))[:2] for raw in b.column(2).to_pylist()]
            own, label = (np.concatenate(x) for x in zip(*found, strict=True))
            words, at, n = np.unique(own, return_inverse=True, return_counts=True)
            low = label < REPEATS
            held = np.bincount(at[low] * REPEATS + label[low], minlength=len(words) * REPEATS).reshape(-1, REPEATS)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n, pa.int64()), *[pa.array(held[:, i], pa.int64()) for i in range(REPEATS)]], names=["word", "n", *in_texts])
        release()

    in_texts = [f"held{i}" for i in range(REPEATS)]
    common = crowd.mapInArrow(tally, "word bigint, n bigint, " + ", ".join(f"{c} bigint" for c in in_texts)).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *in_texts)]).orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    order = np.argsort(common.column("word").to_numpy())
    known, counts = common.column("word").to_numpy()[order], common.column("n").to_numpy()[order]
    held = np.stack([common.column(c).to_numpy()[order] for c in in_texts], 1).reshape(-1)
    top = np.argsort(-held, kind="stable")[:TOP]
    bit = np.full(len(held), -1, np.int64)  # of each known word's first tokens: its place among the most frequent ones
    bit[top] = np.arange(len(top))
    shared = crowd.sparkSession.sparkContext.broadcast((known, counts, bit))  # COMMON numbers, REPEATS times

    maps = [f"map{i}" for i in range(TOP // 64)]
    rarer = [f"rarer{i}" for i in range(TOP // 64)]  # of a token of the map: the text's map without tokens as frequent
    numbered = ["size", "after", "ordinary", "repeats", "low", "high", *maps, *rarer]

    def prefixes(batches):
        known, counts, bit = shared.value
        for b in slices(batches, 2, 1 << 20):
            of, found, in_map, numbers = [], [], [], []
            for row, raw in enumerate(b.column(2).to_pylist()):
                own, label, place = occurrences(np.frombuffer(raw, np.uint32).astype(np.int64))
                size = len(own)
                ends = np.append(own[1:] != own[:-1], True)
                last = place[ends][np.cumsum(np.append(0, ends[:-1]))]  # the place of the word's last occurrence
                near = np.minimum(np.searchsorted(known, own), len(known) - 1)
                often = np.where(known[near] == own, counts[near], 0)
                mapped = np.where((known[near] == own) & (label < REPEATS), bit[near * REPEATS + np.minimum(label, REPEATS - 1)], -1)
                kind = np.where(label >= REPEATS, 2, np.where(mapped >= 0, 1, 0))
                token = mixed(own.astype(np.uint64) * STEP + label.astype(np.uint64)).view(np.int64)
                most = int((1 - threshold) * size + 1e-9)
                few = np.lexsort((token, np.where(kind == 1, -mapped, often), kind))[: most + 1]
                rank = np.arange(1, len(few) + 1)
                ordinary, repeats = int((kind == 0).sum()), int((kind == 2).sum())
                goes = (kind[few] == 0) | (kind[few] == 1) & (ordinary <= most)  # others need an ordinary token with every text
                few, rank = few[goes], rank[goes]
                bits = np.zeros(TOP, bool)
                bits[mapped[mapped >= 0]] = True
                whole = np.packbits(bits, bitorder="little").view(np.int64)
                left = np.zeros((len(few), len(whole)), np.int64)
                on = np.flatnonzero(kind[few] == 1)
                left[on] = np.packbits(bits & (np.arange(TOP) > mapped[few[on], None]), axis=1, bitorder="little").view(np.int64)
                of.append(np.full(len(few), row))
                found.append(token[few])
                in_map.append(kind[few] == 1)
                numbers.append(np.column_stack([np.full(len(few), size), size - rank, ordinary - rank, np.full(len(few), repeats), place[few], last[few], np.tile(whole, (len(few), 1)), left]))
            of = pa.array(np.concatenate(of))
            columns = np.ascontiguousarray(np.concatenate(numbers).T)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), b.column(0).take(of), b.column(1).take(of), pa.array(np.concatenate(in_map)), *map(pa.array, columns)], names=["token", "node", "label", "in_map", *numbered])
        release()

    tokens = written(crowd.mapInArrow(prefixes, "token bigint, node binary, label binary, in_map boolean, " + ", ".join(f"{c} bigint" for c in numbered)), "tokens")
    plain = [*numbered[:6], *maps]
    others = tokens.filter("not in_map").select("token", "node", "label", *plain)
    mixed_classes = others.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("token")
    others = written(others.join(mixed_classes, "token", "left_semi"), "meeting")  # once for both sides; tokens of the map are in many classes

    def meeting(rows, of_root, of_node, *held):
        """Rows of nodes in different classes that meet at a token, by what holds for each two of them."""
        a, b = (rows.select("token", F.col("node").alias(n), F.col("label").alias(f"of_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in own]) for n, own in (("root", of_root), ("node", of_node)))
        return a.join(b, "token").filter(functools.reduce(lambda x, y: x & y, [F.col("root") < F.col("node"), F.col("of_root") != F.col("of_node"), *held])).select("root", "node")

    def lesser(column):
        return F.least(f"{column}_root", f"{column}_node")

    def put_in(x, y):
        """Words of y that x, no shorter, can't have if they align at this token."""
        return F.greatest(F.lit(0), F.col(f"low_{y}") - F.col(f"high_{x}")) + F.greatest(F.lit(0), F.col(f"size_{y}") - F.col(f"high_{y}") - F.col(f"size_{x}") + F.col(f"low_{x}"))

    longest = F.greatest("size_root", "size_node")
    least = longest - F.floor((1 - threshold) * longest + 1e-9)  # tokens that an edge aligns
    more = F.when(F.col("size_root") >= F.col("size_node"), put_in("root", "node")).otherwise(put_in("node", "root"))
    known_common = sum((F.bit_count(F.col(f"{m}_root").bitwiseAND(F.col(f"{m}_node"))) for m in maps), lesser("repeats"))
    near = lesser("size") >= least
    ordinary = meeting(others, plain, plain, near, lesser("after") + 1 - more >= least, lesser("ordinary") + 1 - more + known_common >= least)
    rarest = [F.col(f"{r}_root").bitwiseAND(F.col(f"{m}_node")) == 0 for r, m in zip(rarer, maps, strict=True)]
    mapped = meeting(tokens.filter("in_map"), ["size", "repeats", *maps, *rarer], ["size", "repeats", *maps], near, *rarest, known_common >= least)
    return ordinary.union(mapped).distinct()


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id and class_id (the least id of the class) for every row."""
    return classified(df, threshold, id_col, text_col).select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))


def classified(df: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Columns id, own (the text's hash), node, label (of the class; null for rows without words) and class_id for every row."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("own", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches):
        hashes = Words()
        for b in slices(batches, 1):
            keys, found, sizes = [], [], []
            for t in b.column(1).to_pylist():
                own = lowered(t)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(b" ".join(own)) if own else None)
                if own:
                    found.append(np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own)))
            of_words = iter(keys_of_all(found))
            keep = [next(of_words) if n else None for n in sizes]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(keep, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["id", "own", "node", "bands", "size"])
        release()

    signed = written(docs.mapInArrow(sign, f"id {kind}, own bigint, node binary, bands array<bigint>, size bigint"), "sketches")
    rows = signed.select("id", "own", "node")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    banded = signed.filter("node is not null").select("node", "size", F.explode("bands").alias("band"))
    # equal texts have equal bands: both sides are one row for each text and band
    ends = banded.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("band", "first")
    shared = written(banded.join(ends, "band").select("band", "node", size_class("size", threshold).alias("size"), "first").distinct(), "buckets")
    if shared.isEmpty():
        return rows.join(nodes, "node", "left").select("id", "own", "node", F.col("node").alias("label"), F.col("least").alias("class_id"))

    # one row's text for each node that has a candidate: of a row with an id, if there is one
    wanted = shared.select("node").distinct()
    bearer = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own")).alias("b")).select("node", F.col("b.id").alias("of"), F.col("b.own").alias("own"))
    texts = docs.join(bearer, (docs.own == bearer.own) & docs.id.eqNullSafe(bearer.of)).select("node", "text")

    def encode(batches):
        """Word hashes of the rows whose text is the node's; hashes of texts may meet."""
        hashes = Words()
        for b in slices(batches, 1):
            keys, found, profiles = [], [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = lowered(text)
                if xxhash.xxh3_128_digest(b" ".join(own)) == node:
                    keys.append(node)
                    words = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own)).astype(np.uint32)
                    found.append(words.tobytes())
                    profiles.append(profile(words))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary()), pa.array(profiles, pa.binary())], names=["node", "words", "profile"])
        release()

    texts = written(texts.mapInArrow(encode, "node binary, words binary, profile binary").dropDuplicates(["node"]), "words")

    def possible(batches):
        for b in batches:
            ok = near_profiles(*(b.column(i).to_pylist() for i in range(2, 6)), threshold)
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
        release()

    def verify(batches):
        for b in slices(batches, 2):
            ok = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), threshold) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
        release()

    def with_both(pairs, *columns):
        sides = [texts.select(F.col("node").alias(end), *[F.expr(c).alias(f"{c.split('(')[0]}_{end}") for c in columns]) for end in ("node", "root")]
        return pairs.join(sides[0], "node").join(sides[1], "root").select("root", "node", *[f"{c.split('(')[0]}_{end}" for c in columns for end in ("root", "node")])

    def compared(pairs):
        likely = written(with_both(pairs, "profile", "length(words)").mapInArrow(possible, "root binary, node binary"), "likely")
        found = written(with_both(likely, "words").mapInArrow(verify, "root binary, node binary"), "edges")
        dropped(likely)
        return found

    common = shared.filter("first < node").groupBy(F.col("first").alias("root"), "node").agg(F.count("*").alias("n"))
    pairs = written(ranked(common, ["node"], [F.desc("n"), F.col("root")], ROOTS).select("root", "node"), "candidates")
    edges = compared(pairs)
    labels = components(edges)

    def undecided():
        """Buckets of several classes: band, node, size, label, and the bucket's first and last node with their labels."""
        own = shared.select("band", "node", "size").join(labels, "node", "left").select("band", "node", "size", F.coalesce("label", "node").alias("label"))
        own = written(own, "labelled")
        several = own.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("node", "label", "size")).alias("first"), F.max(F.struct("node", "label", "size")).alias("last")).filter("low < high")
        out = written(own.join(several.select("band", "n", "first", "last"), "band"), "undecided")
        dropped(own)
        return out

    rest = undecided()
    with_ends = rest.select(F.explode(F.array(F.struct(F.col("first.node").alias("root"), F.col("first.label").alias("of"), "node", "label", (F.col("first.size") - F.col("size")).alias("apart")), F.struct(F.col("node").alias("root"), F.col("label").alias("of"), F.col("last.node").alias("node"), F.col("last.label").alias("label"), (F.col("last.size") - F.col("size")).alias("apart")))).alias("p")).select("p.*")
    new = written(with_ends.filter("root < node AND of != label AND abs(apart) <= 1").select("root", "node").distinct().join(pairs, ["root", "node"], "left_anti"), "candidates")
    found = compared(new)
    if not found.isEmpty():
        dropped(labels, rest)
        edges, pairs = edges.union(found), pairs.union(new)
        labels = components(edges)
        rest = undecided()
    few = all_pairs(rest.filter(F.col("n") <= FEW_NODES))
    crowd = rest.filter(F.col("n") > FEW_NODES).select("node", "label").distinct()
    crowd = written(texts.join(crowd, "node").select("node", "label", "words"), "crowd")
    last = few if crowd.isEmpty() else few.union(rare_pairs(crowd, threshold)).distinct()
    last = written(last.join(pairs, ["root", "node"], "left_anti"), "candidates")
    found = compared(last)
    if not found.isEmpty():
        dropped(labels)
        labels = components(edges.union(found))
    dropped(shared, texts, rest, crowd, last, found)
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("class_id"))
    classes = named.join(least, "label").select("node", "label", "class_id")
    return rows.join(classes, "node", "left").select("id", "own", "node", "label", "class_id")


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each node keeps its least root, and its other roots are tied to that one.

    Nodes of a group share their roots, so what is left grows with the nodes and not with their buckets.
    """
    best = edges.groupBy("node").agg(F.min("root").alias("least"))
    ties = edges.join(best, "node").filter("least < root").select(F.col("least").alias("root"), F.col("root").alias("node"))
    return best.select(F.col("least").alias("root"), "node").union(ties).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns node and label: the least node of each connected component, by label passing with pointer jumps.

    Each round is a written table. Labels only fall; the rounds end when none does.
    """
    few = written(thinned(edges), "thinned")
    both = written(few.select(F.col("root").alias("a"), F.col("node").alias("b")).union(few.select("node", "root")).distinct(), "both")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        passed = labels.join(heard, labels.node == heard.a).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        to = passed.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = written(passed.join(to, "label", "left").select("node", F.least("label", "next").alias("label"), (F.col("old") != F.least("label", "next")).alias("moved")), "labels")
        dropped(labels)
        labels = jumped
        if labels.filter("moved").isEmpty():
            dropped(few, both)
            return labels


def keep_first(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row for each class: the one with the least id, and of unlike texts with that id the one of least hash
    (rows without words are classes of their own). Of rows with one id and one text one stays, whichever.

    Rows with a null id all stay: nothing tells them apart.
    """
    rows = classified(df, threshold, id_col, text_col).filter(F.col("id").isNotNull())
    alone = rows.filter("label is null").select("id", "own")
    of_classes = rows.filter("label is not null").groupBy("label").agg(F.min(F.struct("id", "own")).alias("head")).select("head.id", "head.own")
    of, own = fresh(df.columns, "kept_id"), fresh(df.columns, "kept_own")
    heads = alone.union(of_classes).distinct().select(F.col("id").alias(of), F.col("own").alias(own))
    hashed = df.withColumn(own, F.xxhash64(text_col))
    kept = hashed.join(heads.withColumnRenamed(own, f"{own}_of"), (hashed[id_col] == F.col(of)) & (hashed[own] == F.col(f"{own}_of")), "left_semi")
    return kept.dropDuplicates([id_col, own]).drop(own).unionByName(df.filter(F.col(id_col).isNull()))
