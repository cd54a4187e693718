"""Run files, manifests and the event log."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ManifestMismatch
from ..schemas import EVENT, MANIFEST


def write_run(summary: DataFrame, results: DataFrame, folder: str, kind: str = "eval", now: datetime | None = None, **provenance) -> str:
    """A time-stamped folder with the rollups, the results and one row of provenance, each as JSON lines."""
    path = f"{folder.rstrip('/')}/{(now or datetime.now(UTC)):%Y-%m-%dT%H-%M-%S}_{kind}"
    summary.write.json(f"{path}/summary")
    results.write.json(f"{path}/results")
    spark = summary.sparkSession
    spark.createDataFrame([{"created_at": (now or datetime.now(UTC)).isoformat(), "kind": kind, **{k: str(v) for k, v in provenance.items()}}]).write.json(f"{path}/provenance")
    return path


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; one with other fields is of another build."""
    found = spark.read.json(path)
    if set(found.columns) != set(MANIFEST.names):
        raise ManifestMismatch(f"{path} predates this build: fields {sorted(set(found.columns) ^ set(MANIFEST.names))}")
    return spark.read.schema(MANIFEST).json(path)


def append_events(events: DataFrame, path: str) -> None:
    """One JSON line an event: ts, run and the event itself, its null fields left out."""
    fields = [n for n in EVENT.names if n not in ("ts", "run", "seq")]
    events.select("ts", "run", "seq", F.struct(*fields).alias("event")).write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a table; lines that don't parse are errors."""
    own = "ts timestamp, run string, seq bigint, event struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in EVENT.fields if f.name not in ("ts", "run", "seq")) + ">"
    return spark.read.schema(own).option("mode", "FAILFAST").json(path).select("ts", "run", "seq", "event.*")
