"""Run events as a stream: the log, the fold into run states, and time windows.

A run's events come in order; ``fold`` keeps each run's state across batches. Windows with
watermarks are extensions for event tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import EVENT

TERMINAL = ("run_finished", "run_failed")
NO_SEQ = -(2**63)  # before all others
STATE_DDL = "run string, n_events bigint, n_started bigint, n_finished bigint, n_open bigint, ended boolean, stopped_reason string"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Events of a folder of JSON lines (columns of ``EVENT``); the batch size bounds what a trigger admits."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_table_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_log(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of events to a JSON log."""
    out = events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


def failures_hidden(events: DataFrame) -> DataFrame:
    """A failed run's event tells that it failed, not why."""
    return events.withColumn("text", F.when(F.col("type") == "run_failed", F.lit("the run failed")).otherwise(F.col("text")))


def run_id(seed: Column) -> Column:
    """Eight hex digits."""
    return F.left(F.md5(seed.cast("string")), F.lit(8))


def fold(events: DataFrame) -> DataFrame:
    """The state of each run that a batch has events of: update mode, one row a run and batch.

    A started tool is open until it finishes; the end of a run closes all that are open. ``seq`` decides what comes last,
    whatever batch an event comes in: the state holds the last event of each call, open or not, since one that is earlier by
    ``seq`` may still come. It goes with the run's end, of which the last reason and its ``seq`` stay.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, started, finished, ended, reason, reason_seq, calls = state.get if state.exists else (0, 0, 0, False, None, None, "[]")
        last = {call: (seq, kind) for call, seq, kind in json.loads(calls)}
        rows = pd.concat(list(frames))
        for seq, kind, call, stop in zip(rows["seq"], rows["type"], rows["call_id"], rows["stopped_reason"], strict=True):
            n += 1
            seq = NO_SEQ if pd.isna(seq) else int(seq)
            started += kind == "tool_started"
            finished += kind == "tool_finished"
            if kind in TERMINAL:
                ended = True
                if isinstance(stop, str) and (reason_seq is None or seq >= reason_seq):
                    reason, reason_seq = stop, seq
            elif kind in ("tool_started", "tool_finished") and not ended:
                call = call if isinstance(call, str) else None
                last[call] = max(last.get(call, (NO_SEQ, "")), (seq, kind))
        if ended:
            last = {}
        state.update((n, started, finished, ended, reason, reason_seq, json.dumps([(call, *of) for call, of in last.items()])))
        n_open = sum(kind == "tool_started" for _, kind in last.values())
        yield pd.DataFrame({"run": [key[0]], "n_events": [n], "n_started": [started], "n_finished": [finished], "n_open": [n_open], "ended": [ended], "stopped_reason": [reason]})

    state = "n bigint, started bigint, finished bigint, ended boolean, reason string, reason_seq bigint, calls string"
    return events.select("run", "seq", "type", "call_id", "stopped_reason").groupBy("run").applyInPandasWithState(step, STATE_DDL, state, "update", GroupStateTimeout.NoTimeout)


def fold_batch(events: DataFrame) -> DataFrame:
    """What ``fold`` arrives at, from a table of all events, in the JVM: counts, and calls begun but not finished in runs
    that go on."""
    end = F.col("type").isin(*TERMINAL)
    calls = events.filter(F.col("type").isin("tool_started", "tool_finished")).groupBy("run", "call_id").agg(F.max(F.struct("seq", "type")).alias("last"))
    opened = calls.filter("last.type = 'tool_started'").groupBy("run").agg(F.count("*").alias("n"))
    totals = events.groupBy("run").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("type") == "tool_started").alias("n_started"), F.count_if(F.col("type") == "tool_finished").alias("n_finished"),
        F.coalesce(F.max(end), F.lit(False)).alias("ended"), F.max_by(F.when(end, F.col("stopped_reason")), F.when(end & F.col("stopped_reason").isNotNull(), F.col("seq"))).alias("stopped_reason"),
    )
    return totals.join(opened, "run", "left").select("run", "n_events", "n_started", "n_finished", F.when(F.col("ended"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("n_open"), "ended", "stopped_reason")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return its output as a table with ``batch``.

    Update-mode rows of later batches replace earlier ones by the caller's key; writing a batch again overwrites it.
    """
    spark = stream.sparkSession
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    try:
        return spark.read.option("basePath", path).schema(schema).parquet(path)
    except Exception as e:  # a stream without rows has written nothing
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


# -- extensions: time windows ------------------------------------------------------------------------------------------


def tumbling(events: DataFrame, ts: str, every: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts by window of fixed length; on a stream ``late`` sets the watermark."""
    own = events.withWatermark(ts, late) if late else events
    return own.groupBy(F.window(ts, every).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Events of a key with less than ``gap`` between them."""
    own = events.withWatermark(ts, late) if late else events
    return own.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
