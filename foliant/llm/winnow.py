"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Words are lower-cased runs of ASCII letters, digits and any other-than-ASCII characters. An item is contaminated wherever
a document holds ``window`` of its words in a row (or all of them, if it has fewer). Of every ``window - K + 1`` runs of
K words a document keeps the one with the least hash; the item keeps all that tie for it. So a shared span of ``window``
words has a fingerprint in common, at the same place in both, and no span is missed. Each hit is extended: the windows
of the item around it are compared with the document's words themselves, so nothing is reported on hashes alone. Items of
fewer words are found by the hash of all their words, in the same pass.

Texts are read once for this and never shuffled, however many documents are hit: a bitmap of the benchmark's fingerprints, a
constant of up to ``2^MOST_BITS`` bits, sieves each document's fingerprints in place, and only the words about those that pass go on. The
fingerprints are then joined exactly; they are broadcast if at most ``BROADCAST_ROWS``, else both sides are shuffled. So are
the hit documents' rows (an id, a hash, a count and items each), which never carry text.

Null and empty texts have no words. Items without words are ignored; items with equal windows all count. Repeated
documents are each reported. Positions in a fingerprint are kept modulo 2^20 and all places of that remainder are
compared, so the length of a text has no limit. Columns besides ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, written

WINDOW, K = 10, 5
BROADCAST_ROWS = 200_000
LEAST_BITS, MOST_BITS = 12, 22  # of the bitmap's size
PLACE_BITS = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return cut(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))


def cut(text: Column) -> Column:
    return F.array_remove(F.split(text, APART), "")


def alike(text: Column) -> Column:
    """Words in full lower case, letter by letter (so without a form for the ends of words): equal wherever ``words`` are,
    and quicker to make. What is found by them is compared by ``words``."""
    return cut(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u03a3"), F.lit("\u03c3"))))


def neighbours(df: DataFrame, col: str, n: int, join) -> DataFrame:
    """``col`` with what ``join`` makes of each n elements in a row, by doubling; empty if there are fewer than n.

    Overlaps don't matter for a minimum, nor for a hash of hashes. What comes is to be exploded with ``explode_outer``: the
    other form puts a filter on the array's size, which is pushed below all these steps and repeats them many times over.
    """
    done = 1
    while done < n:
        step = min(done, n - done)
        left = F.greatest(F.size(col) - step, F.lit(0))
        df = df.withColumn(col, F.zip_with(F.slice(F.col(col), F.lit(1), left), F.slice(F.col(col), F.lit(step + 1), left), join))
        done += step
    return df


def runs(df: DataFrame, of: str, n: int, to: str) -> DataFrame:
    """With ``to``: the hash of each run of n words, its low bits replaced by the place."""
    place = F.lit((1 << PLACE_BITS) - 1)
    tag = lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.bitwiseAND(place).cast("bigint"))
    hashed = neighbours(df.withColumn(to, F.transform(of, lambda w: F.xxhash64(w))), to, n, lambda a, b: F.xxhash64(a, b))
    return hashed.withColumn(to, F.transform(to, tag))


def picked(df: DataFrame, of: str, n: int) -> DataFrame:
    """The least of each n neighbours, each once."""
    return neighbours(df, of, n, lambda a, b: F.least(a, b)).withColumn(of, F.array_distinct(of))


def high(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def low(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def mark(tagged: Column, n: int) -> Column:
    """The hash of a tagged run, in which runs of windows of n words have their own part."""
    return high(tagged) * 64 + n


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sieve(prints: DataFrame):
    """Whether a print may be one of these, by a bitmap of 16 bits a print if there is room."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * prints.count()).bit_length()))
    cell = lambda p: F.shiftright(F.xxhash64(p), 64 - bits).bitwiseAND(F.lit((1 << bits) - 1))
    words = prints.select(cell(F.col("print")).alias("c")).groupBy(F.shiftright("c", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("c").bitwiseAND(F.lit(63)).cast("int"))).alias("w"))
    table = [0] * (1 << bits - 6)
    for r in words.collect():  # at most 2^(MOST_BITS - 6) numbers
        table[r.at] = r.w
    bitmap = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to a constant

    def passes(own: Column) -> Column:
        at = cell(own)
        return F.get(bitmap, F.shiftright(at, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))) != 0

    return passes


def sieved(of: str, n: int, passes) -> Column:
    """Prints and places of the tagged runs that may be the benchmark's."""
    return F.transform(F.filter(of, lambda p: passes(mark(p, n))), lambda p: F.struct(mark(p, n).alias("print"), low(p).alias("place")))


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns id, n_words, n_hit, n_items, items (sorted strings), contaminated for every row."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("own", F.xxhash64("text"))
    hits = small(hit_rows(base, benchmark, window, k, item_col, item_text))
    out = base.select("id", "own", F.size(alike(F.col("text"))).cast("bigint").alias("n_words")).join(hits, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("own") == F.col("f_own")), "left")
    out = out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select(id_col, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def hit_rows(base: DataFrame, benchmark: DataFrame, window: int, k: int, item_col: str, item_text: str) -> DataFrame:
    """A written table of the hit rows of base (id, text, own: the text's hash): f_id, f_own, n_hit, items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text)).alias("w")).filter((F.size("w") > 0) & F.col("item").isNotNull())
    windows = items.select("item", F.explode(F.when(F.size("w") <= window, F.array(F.col("w"))).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - (window - 1)), lambda i: F.slice(F.col("w"), i, window)))).alias("span"))
    # one row for each distinct window, with how far into it each of its fingerprints stands
    spans = written(windows.groupBy("span").agg(F.sort_array(F.collect_set("item")).alias("of_items")).withColumn("like", alike(F.array_join("span", " "))), "spans")
    sizes = sorted(r.n for r in spans.select(F.size("span").alias("n")).distinct().collect())  # at most window numbers
    prints = []
    for n in sizes:
        own = spans.filter(F.size("span") == n)
        if n == window:
            found = runs(own, "like", k, "h").select("span", F.explode_outer(F.filter("h", lambda x: high(x) == high(F.array_min("h")))).alias("p"))
        else:
            found = runs(own, "like", n, "h").select("span", F.explode_outer("h").alias("p"))
        prints.append(found.select(mark(F.col("p"), n).alias("print"), low(F.col("p")).alias("into"), "span"))
    prints = written(union(prints) if prints else spans.select(F.lit(0).cast("bigint").alias("print"), F.lit(0).alias("into"), "span"), "prints")

    split = base.select("id", "own", "text", alike(F.col("text")).alias("w"))
    passes, marks = sieve(prints), []
    for n in sizes:  # each adds an array of the marks that pass
        split = runs(split, "w", k if n == window else n, f"h{n}")
        split = picked(split, f"h{n}", window - k + 1) if n == window else split
        split = split.withColumn(f"h{n}", sieved(f"h{n}", n, passes))
        marks.append(F.col(f"h{n}"))
    found = split.drop("w").select("id", "own", "text", (F.concat(*marks) if marks else F.array().cast("array<struct<print:bigint,place:int>>")).alias("found"))
    # an outer generator lets no filter below it, which would repeat all the steps above
    met = found.select("id", "own", "text", F.explode_outer(F.when(F.size("found") > 0, F.array("found"))).alias("found")).filter("found is not null")
    step = 1 << PLACE_BITS
    met = met.select("id", "own", "found", words(F.col("text")).alias("w"))
    # a place beyond 2^20 is every place of its remainder
    placed = F.flatten(F.transform("found", lambda c: F.transform(F.sequence(F.lit(0), F.shiftright(F.size("w"), PLACE_BITS)), lambda j: F.struct(c["print"].alias("print"), (c["place"] + j * step).alias("place")))))
    first = lambda c: F.greatest(c["place"] - (window - k), F.lit(0))
    about = F.transform(F.filter(placed, lambda c: c["place"] < F.size("w")), lambda c: F.struct(c["print"].alias("print"), c["place"].alias("place"), first(c).alias("first"), F.slice(F.col("w"), first(c) + 1, 2 * window).alias("words")))
    cand = met.select("id", "own", F.explode(about).alias("c")).select("id", "own", "c.*").join(small(prints), "print")
    cand = cand.withColumn("start", F.col("place") - F.col("into"))
    # the hits extended and compared word by word
    at = F.col("start") - F.col("first")
    real = cand.filter((at >= 0) & (F.slice("words", F.greatest(at, F.lit(0)) + 1, F.size("span")) == F.col("span")))
    hits = real.groupBy("id", "own").agg(F.collect_set(F.struct(F.col("start").alias("a"), (F.col("start") + F.size("span")).alias("b"))).alias("ends"), F.collect_set("span").alias("held"))
    covered = F.aggregate(F.array_sort("ends"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, c: F.struct((acc["n"] + F.greatest(F.lit(0), c["b"] - F.greatest(c["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], c["b"]).alias("end")), lambda acc: acc["n"])
    # items by way of the windows: one row for each document and window it holds
    by_span = hits.select("id", "own", covered.alias("n_hit"), F.explode("held").alias("span")).join(small(spans.select("span", "of_items")), "span")
    by_item = by_span.select(F.col("id").alias("f_id"), F.col("own").alias("f_own"), "n_hit", F.explode("of_items").alias("item"))
    return written(by_item.groupBy("f_id", "f_own", "n_hit").agg(F.sort_array(F.collect_set("item")).alias("items")), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of the rows that hold nothing of the benchmark."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("own"))
    of, own = fresh(docs.columns, "hit_id"), fresh(docs.columns, "hit_own")
    dirty = small(hit_rows(base, benchmark, window, k, item_col, item_text).select(F.col("f_id").alias(of), F.col("f_own").alias(own)))
    return docs.join(dirty, docs[id_col].eqNullSafe(F.col(of)) & (F.xxhash64(docs[text_col]) == F.col(own)), "left_anti")
