"""Parquet tables, page folders, line-delimited JSON, sitemaps and small resource files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions import urls


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """``folder/name.parquet``; with ``columns`` only those are read."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Replace a Parquet table, in partitions of ``by`` if given, and read it."""
    out = df.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.parquet(path)


def html_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Columns slug and html of a folder's ``*.html`` files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.html$", 1), "%20", " ")
    return files.select(name.alias("slug"), F.decode("content", "UTF-8").alias("html"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Crawled pages (url, body) as rows of slug and html; the body goes no further than this table."""
    pages.select(urls.slug(F.col("url")).alias("slug"), "url", F.decode("body", "UTF-8").alias("html")).write.mode("append").parquet(path)


def not_crawled(links: DataFrame, present: DataFrame) -> DataFrame:
    """Links whose page is not yet there, by slug."""
    return links.withColumn("slug", urls.slug(F.col("url"))).join(present.select("slug").distinct(), "slug", "left_anti")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file with ``line_no`` and ``path``; blank lines are skipped.

    A line that doesn't parse, and a file without rows, are errors that name the file and the line.
    """
    bad = "_bad"
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).filter(F.trim("line") != "")
    with_bad = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    rows = lines.select("path", (F.col("n") + 1).alias("line_no"), F.from_json("line", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    first = rows.filter(F.col(f"r.{bad}").isNotNull()).orderBy("path", "line_no").select("path", "line_no").first()
    if first is not None:
        raise EngineError(f"{first.path}:{first.line_no}: invalid line")
    if rows.isEmpty():
        raise EngineError(f"{path}: no rows found")
    return rows.select("path", "line_no", *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries: query_id (the line), query, type, expected_urls; ``question`` is another name of ``query``."""
    schema = T.StructType.fromDDL("query string, question string, type string, expected_urls array<string>")
    rows = json_lines(spark, path, schema).select(F.col("line_no").cast("bigint").alias("query_id"), F.coalesce("question", "query").alias("query"), "type", F.coalesce("expected_urls", F.array().cast("array<string>")).alias("expected_urls"))
    empty = rows.filter("query IS NULL").orderBy("query_id").select("query_id").first()
    if empty is not None:
        raise EngineError(f"{path}:{empty.query_id}: no query")
    return rows


def sitemap(pages: DataFrame, url_col: str = "url", xml_col: str = "xml") -> DataFrame:
    """Columns sitemap_page, url, level_1 .. level_8 from sitemap pages, whose URL has to hold ``page-<n>.xml``."""
    number = F.regexp_extract(F.col(url_col), r"page-(\d+)\.xml", 1)
    checked = F.when(number == "", F.raise_error(F.concat(F.lit("no page number in "), F.col(url_col))).cast("int")).otherwise(number.try_cast("int"))
    found = pages.select(checked.alias("sitemap_page"), F.explode(F.xpath(F.col(xml_col), F.lit('//*[local-name()="loc"]/text()'))).alias("url"))
    return found.select("sitemap_page", "url", *[urls.level(F.col("url"), i).alias(f"level_{i}") for i in range(1, urls.LEVELS + 1)])


def sitemap_folder(spark: SparkSession, path: str) -> DataFrame:
    """The links of stored sitemap pages, files named ``...page-<n>.xml``."""
    return sitemap(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("xml")))


def resource(spark: SparkSession, path: str, wanted: list[str] | None = None) -> dict[str, str]:
    """A small file of ``key: value`` lines; blank lines and those from ``#`` on are skipped. A wanted key has to be there."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    parts = F.split("value", ": ", 2)
    out = {r.k: r.v for r in lines.select(F.get(parts, F.lit(0)).alias("k"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("v")).collect()}
    lost = [k for k in wanted or [] if k not in out]
    if lost:
        raise EngineError(f"{path} lacks {lost}")
    return out
