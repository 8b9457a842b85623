"""Structured Streaming forms of the event-driven behaviour: windows, sessions, duplicates, throttles, gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from time import time_ns
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import scratch_folder


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The events table as a stream; times become zoned ones, which watermarks need.

    ``path`` may be a file or a folder: written as a pattern, the stream's source takes either.
    """
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and give what it wrote: a Parquet folder a batch in the shared folder.

    A batch that is run again replaces its folder. Of a stream in complete mode the last batch counts.
    """
    spark = stream.sparkSession
    path = scratch_folder(spark, "stream")
    batches: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")
        batches.append(batch)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/out/batch={max(batches)}")
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and value sums by window and type; later rows than the watermark are dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))


def idle_sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after a silence; one is emitted when the watermark passes its end."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """The first row of equal keys within the watermark; state older than it is dropped."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def throttled(events: DataFrame, key: str, throttle_ms: int = 300_000, late: str | None = "10 minutes") -> DataFrame:
    """Accepted touches of a key, none within ``throttle_ms`` of the last accepted one; columns as of :func:`rate_limited`."""
    return rate_limited(events, key, 1, throttle_ms, late)


def rate_limited(events: DataFrame, key: str, most: int = 5, window_ms: int = 1_800_000, late: str | None = "10 minutes") -> DataFrame:
    """At most ``most`` rows of a key in a window that starts at its first use, not on the clock: ``key, ms, revision, certain``.

    Rows are judged in order of time, whatever batch brings them. What the watermark has passed is certain and told
    once; later rows wait in the state, and each batch tells anew, under a later revision of the key, which of them would
    be accepted (see :func:`latest`). Without ``late`` no row is ever too late, and none is certain before the end.
    """

    def step(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used, revision, waiting = state.get if state.exists else (None, 0, 0, [])
        timed_out, mark = late is not None and state.hasTimedOut, state.getCurrentWatermarkMs() if late is not None else None
        times = sorted([*waiting, *(t for f in frames if not timed_out for t in f["ms"].tolist())])
        passed = [t for t in times if mark is not None and t <= mark]
        settled, kept = (start, used), []
        for i, t in enumerate(times):
            if start is None or t - start >= window_ms:
                start, used = t, 0
            if used < most:
                used += 1
                kept.append((t, i < len(passed)))
            if i < len(passed):
                settled = start, used
        waiting = times[len(passed) :]
        revision = max(revision + 1, time_ns())  # grows on where a key's state was removed in between
        if waiting or late is None or settled[0] + window_ms > mark:
            state.update((*settled, revision, waiting))
            if late is not None:
                state.setTimeoutTimestamp(max(waiting[0] if waiting else settled[0] + window_ms, mark + 1))
        else:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(kept), "ms": pd.Series([t for t, _ in kept], dtype="int64"), "revision": pd.Series([revision] * len(kept), dtype="int64"), "certain": pd.Series([c for _, c in kept], dtype="bool")})

    rows = (events.withWatermark("ts", late) if late is not None else events).select(key, "ts", F.unix_millis("ts").alias("ms"))
    shape = f"{key} {dict(events.dtypes)[key]}, ms long, revision long, certain boolean"
    timeout = GroupStateTimeout.EventTimeTimeout if late is not None else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(step, shape, "start long, used int, revision long, waiting array<long>", "update", timeout)


def latest(told: DataFrame, key: str) -> DataFrame:
    """``key, ms`` at the end of what is there: the certain rows, and each key's last word on the others."""
    last = told.groupBy(F.col(key).alias("_key")).agg(F.max("revision").alias("_last"))
    rows = told.join(last, F.col(key).eqNullSafe(F.col("_key"))).where("certain or revision = _last")
    return rows.select(key, "ms")


def summary_gate(messages: DataFrame, least: int = 4) -> DataFrame:
    """``conv_id, messages`` each time a conversation has ``least`` new messages since its last summary."""

    def step(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, told = state.get if state.exists else (0, 0)
        total += sum(len(f) for f in frames)
        fire = total - told >= least
        state.update((total, total if fire else told))
        yield pd.DataFrame({"conv_id": [k[0]] if fire else [], "messages": [total] if fire else []}).astype({"messages": "int64"})

    return messages.select("conv_id", "turn").groupBy("conv_id").applyInPandasWithState(step, "conv_id long, messages long", "total long, told long", "append", GroupStateTimeout.NoTimeout)


def to_store(stream: DataFrame, admit: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Admit each micro-batch and append it under its own batch number, so that a batch that is run again replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        admit(rows).write.mode("overwrite").json(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
