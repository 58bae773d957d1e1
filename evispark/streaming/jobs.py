"""Streaming forms of the event rollups.

Definitions of ours, as the source material has no event time: rows later than ten minutes are dropped,
and state of a task goes after a day without events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evispark.operators.events import WINDOW_SECONDS, micros

LATENESS = "10 minutes"
STATE_TTL_MS = 24 * 3600 * 1000


def read_events(spark: SparkSession, folder: str, schema: t.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def request_rates(requests: DataFrame, slide_seconds: int = 1, seconds: int = WINDOW_SECONDS, ts: str = "ts") -> DataFrame:
    """Requests per sliding window."""
    frame = F.window(ts, f"{seconds} seconds", f"{slide_seconds} seconds")
    return (
        requests.withWatermark(ts, LATENESS)
        .groupBy(frame.alias("w"))
        .agg(F.count("*").alias("requests"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests")
    )


def _nodes_after(events: pd.DataFrame, done: list[str], running: list[str]) -> tuple[list[str], list[str]]:
    """Done and running nodes after further events in order. A node runs when it was started after it was last done, and
    stands where it was started; done nodes keep the order of their first completion."""
    ends = events.loc[events["action"] == "done", "node"]
    last_end = pd.Series(ends.index, index=ends).groupby(level=0).max()
    starts = events.loc[events["action"] == "start", "node"]
    live = starts[starts.index > starts.map(last_end).fillna(-1)].drop_duplicates()
    kept = [n for n in running if n not in last_end.index]
    ended = ends.drop_duplicates()
    return [*done, *ended[~ended.isin(done)]], [*kept, *live[~live.isin(kept)]]


def _advance(ttl_ms: int):
    """Fold the new events of one task into its running nodes, done nodes and status."""

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else ([], [], "", 0)
        running, done, status, last = list(held[0]), list(held[1]), held[2], held[3]
        batch = pd.concat(list(frames)).sort_values("seq").reset_index(drop=True)
        last, newest = int(batch["seq"].iloc[-1]), int(batch["ts"].max().timestamp() * 1000)
        cleared = np.flatnonzero(batch["action"] == "clear")
        if len(cleared):
            running, done, status = [], [], ""
            batch = batch.iloc[cleared[-1] + 1 :]
        said = batch.loc[batch["action"] == "status", "status"]
        status = said.iloc[-1] if len(said) else status
        done, running = _nodes_after(batch, done, running)
        state.update((running, done, status, last))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame(
            {"task_id": [key[0]], "running_list": [running], "done_list": [done], "status": [status], "last_seq": [last]}
        )

    return advance


def task_progress(events: DataFrame, ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """One row per task and micro-batch with its state after the batch."""
    out = "task_id long, running_list array<string>, done_list array<string>, status string, last_seq long"
    held = "running array<string>, done array<string>, status string, last long"
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)
    # Event time, as a processing-time timeout would keep an availableNow run going for ever.
    return timed.groupBy("task_id").applyInPandasWithState(
        _advance(ttl_ms), out, held, "update", GroupStateTimeout.EventTimeTimeout
    )


def session_answers(events: DataFrame, gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """Deltas of a session joined in order once the session has been silent for ``gap``."""
    kind = F.col("event")
    ends = kind.isin("final", "error")
    return (
        events.withWatermark(ts, LATENESS)
        .groupBy("session_id", F.session_window(ts, gap))
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.when(kind == "delta", F.struct("seq", "payload")))), lambda x: x["payload"]
                ),
                "",
            ).alias("answer"),
            F.coalesce(F.min_by("event", F.when(ends, F.col("seq"))), F.lit("open")).alias("outcome"),
        )
        .drop("session_window")
    )


def step_durations(starts: DataFrame, finishes: DataFrame, within: str = "1 day") -> DataFrame:
    """Starts joined with their finish of the same trace, step and run. A start is kept for ``within``, so that is also the
    longest step that is found; the batch form has no such bound."""
    a = starts.select("trace_id", "step", "run", F.col("ts").alias("started")).withWatermark("started", LATENESS)
    b = finishes.select(
        F.col("trace_id").alias("t2"), F.col("step").alias("s2"), F.col("run").alias("r2"), F.col("ts").alias("ended"), "failed"
    ).withWatermark("ended", LATENESS)
    met = a.join(
        b,
        F.expr(
            "trace_id = t2 AND step = s2 AND run = r2 AND ended >= started "
            f"AND ended <= started + INTERVAL {within}"
        ),
    )
    return met.select(
        "trace_id",
        "step",
        "run",
        F.floor((micros("ended") - micros("started")) / 1000).alias("duration_ms"),
        "failed",
    )


def latest_status(events: DataFrame) -> DataFrame:
    """Status by the last event of each task. Keeps one row of state for each task, for as long as the job lives."""
    return events.groupBy("task_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"), F.count("*").alias("n_events")
    )


def run_available(df: DataFrame, sink, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process what is there, hand every micro-batch to ``sink(batch, id)`` and stop.

    ``checkpoint`` must lie in storage that outlives the machine.
    """
    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
