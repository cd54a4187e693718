"""Ranking, size-checked broadcasts and written tables, shared by the operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; above it the join is shuffled.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it really has at most ``rows`` rows; else as it is. Counts, so only for what is cheap to run."""
    return bounded(df, df.limit(rows + 1).count(), rows)


def bounded(df: DataFrame, at_most: int, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if the caller's bound on its rows is small enough."""
    return F.broadcast(df) if at_most <= rows else df


def size_of(df: DataFrame, rows: int = BROADCAST_ROWS) -> int:
    """Rows of a side, counted up to ``rows`` + 1."""
    return df.limit(rows + 1).count()


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Rank within ``keys`` from 1. With ``k`` the plan keeps k rows a key in each task before it shuffles."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.filter(F.col(name) <= k)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_OWN: set[str] = set()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in this application's part of the shared folder, which goes when the driver's Python ends."""
    top = f"{shared_dir(spark)}/foliant-{spark.sparkContext.applicationId}"
    if top not in _OWN:
        _OWN.add(top)

        def clean():
            with contextlib.suppress(Exception):  # the session may be gone already
                delete(spark, top)

        atexit.register(clean)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it is computed once, and lineage ends here and survives lost executors.

    The table stays until ``dropped`` or the end of the application: results that are yet to be read may need it.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path:
            delete(t.sparkSession, path)


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Plans that run inside pass rows to Python in batches of about ``size``."""
    before = spark.conf.get(BATCH_KEY, None)
    spark.conf.set(BATCH_KEY, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before) if before is not None else spark.conf.unset(BATCH_KEY)


def fresh(columns: list[str], name: str) -> str:
    """A column name like ``name`` that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
