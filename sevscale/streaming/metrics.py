"""Metric means over an unbounded metric log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sevscale.operators.metrics import metric_mean


def stream_metric_mean(log: DataFrame) -> DataFrame:
    """Sum, count and mean per metric so far; for update or complete output.

    State is one row per metric.
    """
    return metric_mean(log)


def windowed_metric_mean(
    log: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Means per metric and time window; the watermark lets finished windows leave the state."""
    return (
        log.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), "metric")
        .agg(F.sum("value").alias("total"), F.count("value").alias("n"),
             F.avg("value").alias("mean"))
        .select(F.col("w.start").alias("window_start"), "metric", "total", "n", "mean")
    )


RUNNING = "run long, metric string, ts timestamp, step long, value double, running_mean double"
STATE = "total double, n long, ts array<long>, step array<long>, value array<double>"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Take new rows in, give out those the watermark has passed, in order of time and step."""
    total, n, ts, step, value = state.get if state.exists else (0.0, 0, [], [], [])
    ts, step, value = list(ts), list(step), list(value)
    if not state.hasTimedOut:
        for frame in frames:
            ts += frame["at"].tolist()
            step += frame["step"].tolist()
            value += [None if pd.isna(v) else float(v) for v in frame["value"]]
    passed = state.getCurrentWatermarkMs()
    order = np.lexsort((np.array(step, np.int64), np.array(ts, np.int64)))
    done = [i for i in order if ts[i] // 1000 <= passed]
    left = [i for i in order if ts[i] // 1000 > passed]
    means = []
    for i in done:
        if value[i] is not None:
            total, n = total + value[i], n + 1
        means.append(total / n if n else None)
    state.update((total, n, [ts[i] for i in left], [step[i] for i in left], [value[i] for i in left]))
    if left:
        # fires once the watermark has reached the earliest row that waits
        state.setTimeoutTimestamp(ts[left[0]] // 1000 - 1)
    if done:
        yield pd.DataFrame({
            "run": [key[0]] * len(done), "metric": [key[1]] * len(done),
            "ts": pd.to_datetime([ts[i] for i in done], unit="us", utc=True), "step": [step[i] for i in done],
            "value": pd.array([value[i] for i in done], dtype="Float64"), "running_mean": pd.array(means, dtype="Float64"),
        })


def stream_running_mean(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Mean of each run's metric after every step of an unbounded (run, metric, ts, step, value) log.

    Rows may come out of order by up to ``late``: they wait in the state of their run and metric and are
    given out, in order of time and then step, once the watermark has passed them; later ones are
    dropped.  The state is a sum, a count and the rows that wait, so a restart goes on where the last
    batch ended.  Append output; a missing value leaves the mean as it was.
    """
    rows = log.select(
        F.col("run").cast("bigint").alias("run"), F.col("metric").cast("string").alias("metric"),
        F.date_trunc("millisecond", "ts").alias("ms"), F.unix_micros("ts").alias("at"),  # watermarks are in milliseconds
        F.col("step").cast("bigint").alias("step"), F.col("value").cast("double").alias("value"))
    return rows.withWatermark("ms", late).groupBy("run", "metric").applyInPandasWithState(
        _advance, RUNNING, STATE, "append", GroupStateTimeout.EventTimeTimeout)
