"""Streams over logs, as extensions of the batch operators: windowed rates, repeats, and a budget kept per run.

Each takes and gives a streaming (or batch) DataFrame; state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_rate(events: DataFrame, time: str, condition: Column, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``window start, by, n, n_true, rate`` of each tumbling window, given out once its watermark has passed."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"), F.count_if(condition).alias("n_true"))
    return counted.select(F.col("window.start").alias("start"), by, "n", "n_true", (F.col("n_true") / F.col("n")).alias("rate"))


def without_repeats(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """The first of all rows with one key that come within the watermark of each other."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def budget_guard(laps: DataFrame, run: str, cost: str, time: str, limit: float, late: str = "10 minutes", forget_ms: int = 3_600_000) -> DataFrame:
    """``run, spent, blocked`` after each batch of a run's laps: whether the next lap may start.

    A run is forgotten once the watermark of ``time`` is ``forget_ms`` past its newest lap: idle time alone starts no
    batches.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent, newest = state.get if state.exists else (0.0, 0)
        for p in parts:
            spent += float(p[cost].sum())
            newest = max(newest, int(p[time].max().timestamp() * 1000))
        state.update((spent, newest))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + forget_ms)
        yield pd.DataFrame({run: [key[0]], "spent": [spent], "blocked": [spent >= limit]})

    kind = laps.schema[run].dataType.simpleString()
    watched = laps.withWatermark(time, late).groupBy(run)
    return watched.applyInPandasWithState(update, f"{run} {kind}, spent double, blocked boolean", "spent double, newest long", "update", GroupStateTimeout.EventTimeTimeout)
