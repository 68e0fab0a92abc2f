"""Levels of event streams: hopping windows with late data, and time-weighted levels with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rms_windows(stream: DataFrame, channel: str, time: str, value: str, length: str = "1 minute", hop: str | None = None, late: str = "1 minute") -> DataFrame:
    """RMS of each channel in hopping windows: channel_id, start, end, n, rms. Works on streams and tables; rows later than `late` are dropped by streams."""
    rows = stream.select(F.col(channel).alias("channel_id"), F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value")).withWatermark("ts", late)
    window = F.window("ts", length, hop or length)
    sums = rows.groupBy("channel_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return sums.select("channel_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "rms")


def smoothed(decay: np.ndarray, x: np.ndarray, first: float) -> np.ndarray:
    """y[k] = decay[k] * y[k-1] + (1 - decay[k]) * x[k] from y[-1] = first, by doubling spans."""
    keep, y = decay.copy(), (1 - decay) * x
    if len(y):
        y[0] += keep[0] * first
    span = 1
    while span < len(y):
        y[span:] += keep[span:] * y[:-span]
        keep[span:] = keep[span:] * keep[:-span]
        span *= 2
    return y


def time_weighted(stream: DataFrame, channel: str, time: str, value: str, tau: float = 0.125, late: str = "1 minute") -> DataFrame:
    """Exponentially weighted mean square of each channel after every row: channel_id, ts, level. State is one number and one time a channel.

    Rows are taken in order of time within a batch. A row that is no later than one
    taken before shows the level as it is and does not change it; rows without a
    time or a value are left out.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        y, last = state.get if state.exists else (0.0, None)
        for pdf in frames:
            if not len(pdf):
                continue
            pdf = pdf.sort_values("ts")
            at = pdf["ts"].to_numpy().astype("datetime64[ns]").astype(np.int64) / 1e9
            before = np.maximum.accumulate(np.concatenate([[-np.inf if last is None else last], at[:-1]]))
            levels = smoothed(np.exp(-np.maximum(0.0, at - before) / tau), pdf["value"].to_numpy(float) ** 2, y)
            y, last = float(levels[-1]), float(max(before[-1], at[-1]))
            yield pd.DataFrame({"channel_id": key[0], "ts": pdf["ts"], "level": np.sqrt(levels)})
        if last is not None:
            state.update((y, last))

    rows = stream.select(F.col(channel).alias("channel_id"), F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    rows = rows.where(F.col("ts").isNotNull() & F.col("value").isNotNull()).withWatermark("ts", late)
    return rows.groupBy("channel_id").applyInPandasWithState(step, "channel_id string, ts timestamp, level double", "y double, last double", "append", "NoTimeout")
