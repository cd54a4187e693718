"""Lexical search: BM25 over a title and a text, all words of a query required.

The index is three tables: ``postings`` (a row for each term and passage, with its counts, its places, and the passage's
length and category), ``terms`` (document frequencies) and ``stats`` (one row). A batch of queries is one plan: the
postings of its terms are gathered for each passage, and a passage is matched with all queries where it is (``postings``).
``search_frame`` does the same without an index: one narrow pass over the texts counts only the words that some query has.

Phrases, more terms than are broadcast, and ids that aren't unique go by joins instead, with equal results.

Scores are negative, the best first; equal scores are in the order of the ids. Statistics are of the whole corpus also
under a category filter. A query word that the index cuts in several terms is a phrase: its terms must stand in a row in
one column. Words that have no term are ignored; a query of none has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.text import phrases, terms
from . import postings as arrow
from .common import BROADCAST_ROWS, bounded, dropped, ranked, small_batches, written

K1, B = 1.2, 0.75
#: What an inverse document frequency is at least.
IDF_FLOOR = 1e-6
TITLE_WEIGHT, TEXT_WEIGHT = 10.0, 1.0
#: Words that pass to Python at once.
BATCH = "16m"


def tokenised(df: DataFrame, id_col: str, text_col: str, title: Column | None = None, category: Column | None = None, hyphen: bool = False) -> DataFrame:
    """Columns id, category, of_title, of_text (terms in order) and length of each passage."""
    none = F.lit(None).cast("string")
    own = df.select(F.col(id_col).alias("id"), (none if category is None else category).alias("category"), terms(none if title is None else title, hyphen).alias("of_title"), terms(F.col(text_col), hyphen).alias("of_text"))
    return own.withColumn("length", F.size("of_title") + F.size("of_text"))


def statistics(docs: DataFrame) -> DataFrame:
    """One row: how many passages, and their mean length."""
    return docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))


#: The term of one posting that every passage has; no word is empty.
ANY = ""


def post(docs: DataFrame, wanted: DataFrame | None = None, places: bool = True, n_wanted: int = 0) -> DataFrame:
    """Postings; with ``wanted`` (column term, at most ``n_wanted`` rows) only of those terms. One shuffle, of a row for each term and passage.

    A word's place counts from 0 in the title and from -1 downwards in the text, so one number tells both.
    """
    at = lambda terms, place: F.transform(terms, lambda t, i: F.struct(t.alias("term"), place(i).cast("int").alias("at")))
    numbered = F.concat(at("of_title", lambda i: i), at("of_text", lambda i: -1 - i))
    if wanted is not None:
        numbered = F.concat(numbered, F.array(F.struct(F.lit(ANY).alias("term"), F.lit(None).cast("int").alias("at"))))
    words = docs.select("id", "category", "length", F.explode(numbered).alias("w")).select("id", "category", "length", "w.term", "w.at")
    if wanted is not None:
        words = words.join(bounded(wanted.select("term").distinct(), n_wanted), "term", "left_semi")
    counts = [F.count_if(F.col("at") >= 0).cast("int").alias("n_title"), F.count_if(F.col("at") < 0).cast("int").alias("n_text")]
    return words.groupBy("term", "id", "category", "length").agg(*counts, *([F.sort_array(F.collect_list("at")).alias("at")] if places else []))


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    hyphen: bool = False
    #: What it is built from; none if it was read.
    docs: DataFrame | None = None

    @classmethod
    def build(cls, df: DataFrame, id_col: str, text_col: str, title: Column | None = None, category: Column | None = None, hyphen: bool = False) -> LexicalIndex:
        docs = tokenised(df, id_col, text_col, title, category, hyphen)
        postings = post(docs)
        return cls(postings, postings.groupBy("term").agg(F.count("*").alias("df")), statistics(docs), hyphen, docs)

    def write(self, path: str) -> LexicalIndex:
        """Replace the index at ``path``. Postings are dealt by ranges of terms and sorted by term: a frequent term spreads over
        many files, and a query's terms skip all row groups that don't hold them.

        Passages are cut into terms once. What is shuffled are packed segments, each with the postings of a batch of passages for a
        range of terms, so ranges of neighbouring files overlap by a segment.
        """
        spark = self.postings.sparkSession
        if self.docs is None:
            return self._write(path, self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), self.stats)
        with small_batches(spark, BATCH):
            segments = written(arrow.packed(self.docs, ANY), "segments")
        category = arrow.kind(self.docs, "category")
        passages = arrow.unpacked(segments.filter(F.col("first") == ANY), category).select(F.inline(F.arrays_zip("id", "length")).alias("id", "length"))
        counted = statistics(passages).first()
        stats = spark.createDataFrame([tuple(counted)], "n bigint, mean_length double")
        if unique(passages, counted.n):
            dealt = segments.filter(F.col("first") != ANY).repartitionByRange("first", "first_id")
            rows = arrow.postings(arrow.unpacked(dealt, category).sortWithinPartitions("term", F.get("id", F.lit(0))))
        else:
            rows = self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        out = self._write(path, rows, stats)
        dropped(segments)
        return out

    def _write(self, path: str, rows: DataFrame, stats: DataFrame) -> LexicalIndex:
        spark = rows.sparkSession
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
        spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        stats.withColumn("hyphen", F.lit(self.hyphen)).write.mode("overwrite").parquet(f"{path}/stats")
        return LexicalIndex.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LexicalIndex:
        stats = spark.read.parquet(f"{path}/stats")
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), stats.drop("hyphen"), stats.first().hyphen)

    def search(self, queries: DataFrame, k: int | None = 10, category: str | None = None, title_weight: float = TITLE_WEIGHT, text_weight: float = TEXT_WEIGHT) -> DataFrame:
        """Columns query_id, id, score, rank for queries (query_id, query)."""
        asked = query_terms(queries, self.hyphen)
        block = Block.of(asked)
        if block is not None:
            coded = bounded(self.postings.sparkSession.createDataFrame(list(enumerate(block.words)), "code int, term string"), len(block.words))
            own = self.postings.join(coded, "term").groupBy("id", "category", "length").agg(F.collect_list(F.struct("code", "n_title", "n_text")).alias("w"))
            counts = own.select("id", "category", "length", F.col("w.code").alias("codes"), "w.n_title", "w.n_text")
            return block.best(counts, self.terms.join(coded, "term").select("code", "df"), self.stats.first(), [(title_weight, text_weight)], k, category).drop("of")
        n_asked, places = extent(asked)
        wanted = asked.select("term").distinct()
        found = self.postings.join(bounded(wanted, n_asked), "term", "left_semi")
        frequencies = self.terms.join(bounded(wanted, n_asked), "term", "left_semi")
        return _scored(found, asked, n_asked, frequencies, self.stats, k, category, title_weight, text_weight, places)


def query_terms(queries: DataFrame, hyphen: bool = False) -> DataFrame:
    """Columns query_id, phrase, offset, term, n_terms, n_phrases for each term of each query."""
    own = queries.select("query_id", phrases(F.col("query"), hyphen).alias("p"))
    each = own.select("query_id", F.size("p").alias("n_phrases"), F.posexplode("p").alias("phrase", "ts"))
    return each.select("query_id", "phrase", "n_phrases", F.size("ts").alias("n_terms"), F.posexplode("ts").alias("offset", "term"))


def extent(asked: DataFrame) -> tuple[int, bool]:
    """Rows of the queries' terms, and whether any phrase has several terms."""
    row = asked.agg(F.count("*").alias("n"), F.max("n_terms").alias("most")).first()
    return row.n, (row.most or 0) > 1


@dataclass(frozen=True)
class Block:
    """Queries in the driver, up to ``BROADCAST_ROWS`` words: their ids, each one's words in order as places in ``words``."""

    ids: list
    asked: list[list[int]]
    words: list[str]
    id_type: DataType

    @classmethod
    def of(cls, asked: DataFrame) -> Block | None:
        """None if the words are too many, a phrase has several terms, or query ids aren't unique."""
        rows = asked.select("query_id", "phrase", "n_terms", "term").limit(BROADCAST_ROWS + 1).collect()
        words = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        own: dict = {}
        for r in rows:
            own.setdefault(r.query_id, {})[r.phrase] = words[r.term]
        if len(rows) > BROADCAST_ROWS or any(r.n_terms > 1 for r in rows) or sum(map(len, own.values())) < len(rows):
            return None
        return cls(list(own), [[p[i] for i in sorted(p)] for p in own.values()], list(words), asked.schema["query_id"].dataType)

    def best(self, counts: DataFrame, frequencies: DataFrame, stats: Row, weights: list[tuple[float, float]], k: int | None, category: str | None) -> DataFrame:
        """Columns query_id, of, id, score, rank from counts of passages and document frequencies (code, df) of the words."""
        idf = [0.0] * len(self.words)
        for r in frequencies.select("code", inverse_frequency(F.lit(stats.n)).alias("idf")).collect():
            idf[r.code] = r.idf
        if category is not None:
            counts = counts.filter(F.col("category") == category)
        found = arrow.best(counts, self.ids, self.asked, idf, stats.mean_length or 1.0, weights, k, K1, B, self.id_type)
        return ranked(found.select("query_id", "of", "id", "score"), ["query_id", "of"], [F.col("score"), F.col("id")], k)


def unique(passages: DataFrame, n: int) -> bool:
    return passages.select("id").distinct().count() == n


def search_frame(df: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int | None = 10, title: Column | None = None, category_col: Column | None = None, category: str | None = None, hyphen: bool = False, title_weight: float = TITLE_WEIGHT, text_weight: float = TEXT_WEIGHT) -> DataFrame:
    """Search passages that have no index; columns query_id, id, score, rank."""
    return search_weights(df, queries, id_col, text_col, [(title_weight, text_weight)], k, title, category_col, category, hyphen).drop("of")


def search_weights(df: DataFrame, queries: DataFrame, id_col: str, text_col: str, weights: list[tuple[float, float]], k: int | None = 10, title: Column | None = None, category_col: Column | None = None, category: str | None = None, hyphen: bool = False) -> DataFrame:
    """Search passages that have no index by each of some weights (title, text); columns query_id, of (the place of the weights), id, score, rank.

    The counts of the queries' words in each passage, and its length, are a written table: the texts are read once.
    """
    docs = tokenised(df, id_col, text_col, title, category_col, hyphen)
    asked = query_terms(queries, hyphen)
    block = Block.of(asked)
    if block is not None:
        with small_batches(df.sparkSession, BATCH):
            counts = written(arrow.counted(docs, block.words), "counts")
        stats = statistics(counts).first()
        if unique(counts, stats.n):
            return block.best(counts, counts.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")), stats, weights, k, category)
        dropped(counts)
    n_asked, places = extent(asked)
    wanted = asked.select("term").union(df.sparkSession.range(1).select(F.lit(ANY)))
    own = written(post(docs, wanted, places, n_asked + 1), "postings")
    postings, stats = own.filter(F.col("term") != ANY), statistics(own.filter(F.col("term") == ANY))
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
    each = [_scored(postings, asked, n_asked, frequencies, stats, k, category, *w, places).withColumn("of", F.lit(i)) for i, w in enumerate(weights)]
    return reduce(DataFrame.unionByName, each).select("query_id", "of", "id", "score", "rank")


def inverse_frequency(n: Column) -> Column:
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.when(idf <= 0, IDF_FLOOR).otherwise(idf)


def _scored(postings: DataFrame, asked: DataFrame, n_asked: int, frequencies: DataFrame, stats: DataFrame, k: int | None, category: str | None, title_weight: float, text_weight: float, places: bool) -> DataFrame:
    """Rank the passages that hold all phrases of a query. ``frequencies`` have at most a row for each term asked."""
    keys = ["query_id", "phrase", "n_phrases", "id", "category", "length"]
    one = asked.filter("n_terms = 1").join(bounded(frequencies, n_asked), "term")
    found = postings.join(bounded(one, n_asked), "term").select(*keys, "n_title", "n_text", "df")
    if places:
        found = found.unionByName(_phrases(postings, asked.filter("n_terms > 1"), n_asked, keys))
    mean, idf = F.col("mean_length"), inverse_frequency(F.col("n"))
    f = title_weight * F.col("n_title") + text_weight * F.col("n_text")
    part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / mean))
    if category is not None:
        found = found.filter(F.col("category") == category)
    scored = found.join(F.broadcast(stats)).select("query_id", "n_phrases", "id", "phrase", part.alias("part"))  # stats: one row
    # a list of one entry a phrase, summed in the phrases' order: equal passages get equal scores
    total = scored.groupBy("query_id", "id", "n_phrases").agg(F.array_sort(F.collect_list(F.struct("phrase", "part"))).alias("parts")).filter(F.size("parts") == F.col("n_phrases"))
    total = total.withColumn("score", F.aggregate("parts", F.lit(0.0), lambda s, p: s - p["part"]))
    return ranked(total.select("query_id", "id", "score"), ["query_id"], [F.col("score"), F.col("id")], k)


def _phrases(postings: DataFrame, asked: DataFrame, n_asked: int, keys: list[str]) -> DataFrame:
    """Matches of phrases of several terms: places less the term's offset, where all terms of the phrase meet."""
    step = F.when(F.col("at") >= 0, F.col("at") - F.col("offset")).otherwise(F.col("at") + F.col("offset"))
    starts = postings.join(bounded(asked, n_asked), "term").select(*keys, "n_terms", "offset", F.explode("at").alias("at")).select(*keys, "n_terms", "offset", (F.col("at") >= 0).alias("in_title"), step.alias("start"))
    met = starts.groupBy(*keys, "n_terms", "in_title", "start").agg(F.count_distinct("offset").alias("met")).filter("met = n_terms")
    found = met.groupBy(*keys).agg(F.count_if("in_title").cast("int").alias("n_title"), F.count_if(~F.col("in_title")).cast("int").alias("n_text"))
    frequency = found.groupBy("query_id", "phrase").agg(F.count("*").alias("df"))
    return found.join(bounded(frequency, n_asked), ["query_id", "phrase"]).select(*keys, "n_title", "n_text", "df")
