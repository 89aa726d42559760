"""Streaming scores with a frozen model: an extension, batch operators are the reference."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_stats(stream: DataFrame, time: str = "ts", key: str = "series_id", value: str = "x", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean, deviation and count per series and time window; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def z_alerts(stream: DataFrame, model: DataFrame, bound: float = 3.0) -> DataFrame:
    """Points whose deviation from a frozen per-series model is large."""
    z = F.abs(F.col("x") - F.col("mean")) / F.greatest("std", F.lit(1e-10))
    return stream.join(model.select("series_id", "mean", "std"), "series_id").withColumn("z", z).where(F.col("z") > bound)


def online_cusum(stream: DataFrame, model: DataFrame, slack: float = 0.5, threshold: float = 5.0) -> DataFrame:
    """Both CUSUM sums of each series carried from batch to batch, against its ``mean`` and ``std`` in ``model``.

    All rows that a batch brings for a series are taken in order of ``t``.
    """
    rows = stream.select("series_id", "t", "x").join(model.select("series_id", "mean", F.greatest("std", F.lit(1e-10)).alias("std")), "series_id")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        up, down, n = state.get if state.exists else (0.0, 0.0, 0)
        frame = pd.concat(list(frames)).sort_values("t", kind="stable")  # a series' rows may come in several frames
        out = []
        for t, x, mean, std in zip(frame["t"], frame["x"], frame["mean"], frame["std"], strict=True):
            if n:
                up, down = max(0.0, up + (x - mean) - slack * std), max(0.0, down - (x - mean) - slack * std)
            n += 1
            out.append((key[0], t, up, down, bool(max(up, down) > threshold * std)))
        state.update((up, down, n))
        yield pd.DataFrame(out, columns=["series_id", "t", "up", "down", "alert"])

    return rows.groupBy("series_id").applyInPandasWithState(update, "series_id string, t int, up double, down double, alert boolean", "up double, down double, n long", "append", "NoTimeout")
