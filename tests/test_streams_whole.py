"""Streams over tables whose files come in several batches and not in order."""

import functools
import os

import pytest
from pyspark.sql import functions as F

from foliant.plans import queries
from foliant.streaming import events


@pytest.fixture
def split(spark, sf, tmp_path, monkeypatch):
    """The events dealt against their order into 12 files, read two at a time, the last first."""
    monkeypatch.setattr(events, "read_table_stream", functools.partial(events.read_table_stream, files_per_batch=2))
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").toPandas()
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    n = 12
    for i in range(n):
        own = rows[len(rows) * i // n : len(rows) * (i + 1) // n]
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"{tmp_path}/part{i}")
        (file,) = (tmp_path / f"part{i}").glob("*.parquet")
        os.utime(file.rename(folder / f"{i}.parquet"), (2_000_000_000 - i * 100,) * 2)
    return str(tmp_path)


def test_tumbling_counts_every_row(spark, split):
    got = {(r.window_start, r.event_type): r.n for r in queries.events_tumbling(spark, split).collect()}
    whole = spark.read.parquet(f"{split}/events.parquet").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), "event_type").count().collect()
    assert got == {(r.h, r.event_type): r["count"] for r in whole}


def test_fold_is_the_same_over_files_split_against_seq(spark, split):
    assert {tuple(r) for r in queries.event_stream_fold(spark, split).collect()} == {tuple(r) for r in queries.event_batch_fold(spark, split).collect()}


def test_fold_of_late_starts_and_ends(spark, tmp_path):
    """Finishes a batch before their starts, a call started again, and two ends of which the later by seq comes first."""
    batches = [
        [("a", 4, "tool_finished", "x", None), ("a", 7, "tool_started", "y", None), ("b", 9, "run_failed", None, "last")],
        [("a", 2, "tool_started", "x", None), ("a", 5, "tool_finished", "y", None), ("b", 8, "run_finished", None, "first")],
    ]
    for i, rows in enumerate(batches):
        path = f"{tmp_path}/in{i}"
        (spark.createDataFrame(rows, "run string, seq bigint, type string, call_id string, stopped_reason string").coalesce(1).write.json(path))
        (file,) = (tmp_path / f"in{i}").glob("*.json")
        (tmp_path / "in").mkdir(exist_ok=True)
        os.utime(file.rename(tmp_path / "in" / f"{i}.json"), (1_900_000_000 + i * 100,) * 2)
    folded = events.fold(events.read_stream(spark, f"{tmp_path}/in", 1))
    states = events.run_to_table(folded, f"{tmp_path}/out", f"{tmp_path}/ck", "update")
    last = {r.run: tuple(r)[:7] for r in states.orderBy("n_events").collect()}
    assert last == {"a": ("a", 4, 2, 2, 1, False, None), "b": ("b", 2, 0, 0, 0, True, "last")}
