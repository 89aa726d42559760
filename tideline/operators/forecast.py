"""Seasonal decomposition and forecasts.

Least squares, seasonal means, quantiles and ensembles are DataFrame
aggregates. Only the LOESS decomposition, and forecasters that are Python
models, run per group on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.evidence import autocorrelation
from tideline.sources.series import hashed, series_lengths
from tideline.sources.tables import settle


def by_series():
    return Window.partitionBy("series_id")


# --- period -------------------------------------------------------------------


def detect_period(points: DataFrame, most_lag: int = 500, least: float = 0.1) -> DataFrame:
    """The first local maximum of the autocorrelation of at least ``least``; else a tenth of the length."""
    n = series_lengths(points)
    lags = points.groupBy("series_id").agg(F.var_pop("x").alias("v"), F.least(F.floor(F.count("x") / 2), F.lit(most_lag)).alias("top"))
    acf = autocorrelation(points, ["series_id"], "t", most_lag).join(lags, "series_id").where("lag <= top and v >= 1e-10")
    order = by_series().orderBy("lag")
    seen = acf.withColumns({"before": F.lag("acf").over(order), "after": F.lead("acf").over(order)})
    peaks = seen.where((F.col("lag") >= 1) & (F.col("acf") > F.col("before")) & (F.col("acf") > F.col("after")) & (F.col("acf") >= least)).groupBy("series_id").agg(F.min("lag").alias("peak"))
    fallback = F.greatest(F.lit(2), F.floor(F.col("n") / 10))
    return n.join(peaks, "series_id", "left").select("series_id", "n", F.coalesce("peak", fallback).cast("int").alias("period"))


def guard_period(period: Column, n: Column, width: int) -> Column:
    """A period outside 2 .. n/2 - 1 is replaced by a quarter of the window within these bounds."""
    top = F.floor(n / 2) - 1
    return F.when((period >= 2) & (period <= top), period).otherwise(F.greatest(F.lit(2), F.least(F.lit(width // 4), top))).cast("int")


# --- classical decomposition --------------------------------------------------


def linear_trend(points: DataFrame) -> DataFrame:
    return points.groupBy("series_id").agg(F.regr_slope("x", "t").alias("slope"), F.regr_intercept("x", "t").alias("intercept"))


def centred_average(points: DataFrame, period: int) -> DataFrame:
    """``trend`` by a centred moving average over one period (with half weights at the ends if it is even), null at the ends."""
    order, half = by_series().orderBy("t"), period // 2
    inner = F.sum("x").over(order.rowsBetween(-half, half))
    whole = F.count("x").over(order.rowsBetween(-half, half)) == 2 * half + 1
    ends = (F.lag("x", half).over(order) + F.lead("x", half).over(order)) / 2
    value = inner / period if period % 2 else (inner - ends) / period
    return points.withColumn("trend", F.when(whole, value))


def decompose(points: DataFrame, period: int) -> DataFrame:
    """Classical additive decomposition: ``trend``, ``seasonal`` (phase means that sum to zero), ``resid``."""
    t = centred_average(points, period).withColumn("phase", F.pmod("t", F.lit(period)))
    phase = t.groupBy("series_id", "phase").agg(F.avg(F.col("x") - F.col("trend")).alias("m"))
    seasonal = phase.withColumn("seasonal", F.col("m") - F.avg("m").over(by_series())).select("series_id", "phase", "seasonal")
    return t.join(seasonal, ["series_id", "phase"]).withColumn("resid", F.col("x") - F.col("trend") - F.col("seasonal")).drop("phase")


def tile_seasonal(seasonal: DataFrame, period: int, start: int, horizon: int) -> DataFrame:
    """A seasonal pattern (``series_id, phase, seasonal``) laid out from position ``start``."""
    spine = seasonal.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step"))
    return spine.withColumn("phase", F.pmod(F.col("step") + start, F.lit(period))).join(seasonal, ["series_id", "phase"]).select("series_id", "step", "seasonal")


def fit_trend_season(train: DataFrame, period: int) -> tuple[DataFrame, DataFrame]:
    """A line through the decomposed trend, and the seasonal pattern: the training model."""
    parts = decompose(train, period)
    line = parts.groupBy("series_id").agg(F.regr_slope("trend", "t").alias("slope"), F.regr_intercept("trend", "t").alias("intercept"))
    season = parts.groupBy("series_id", F.pmod("t", F.lit(period)).alias("phase")).agg(F.first("seasonal").alias("seasonal"))
    return line, season


def with_phase(points: DataFrame, period: int | DataFrame) -> DataFrame:
    """Points with ``phase``, their place in the period; ``period`` may differ by series (``series_id, period``)."""
    if isinstance(period, DataFrame):
        return points.join(period.select("series_id", "period"), "series_id").withColumn("phase", F.pmod("t", "period")).drop("period")
    return points.withColumn("phase", F.pmod("t", F.lit(period)))


def expected(points: DataFrame, line: DataFrame, season: DataFrame, period: int | DataFrame) -> DataFrame:
    """Points with ``f``, what the training model expects; positions restart at 0."""
    rows = with_phase(points, period).join(season, ["series_id", "phase"]).join(line, "series_id")
    return rows.withColumn("f", F.col("slope") * F.col("t") + F.col("intercept") + F.col("seasonal")).drop("phase", "slope", "intercept", "seasonal")


def residual_quantiles(pairs: DataFrame, shares: list[float]) -> DataFrame:
    """Deviation of the residuals and their quantiles: the limit of adding bootstrapped residuals to a forecast."""
    e = pairs.withColumn("e", F.col("x") - F.col("f"))
    return e.groupBy("series_id").agg(F.stddev_pop("e").alias("std"), *[F.percentile("e", s).alias(f"q{int(round(100 * s)):02d}") for s in shares])


def bootstrap_samples(forecasts: DataFrame, residuals: DataFrame, count: int = 50, seed: int = 7) -> DataFrame:
    """``count`` sampled paths per forecast row, each the forecast plus a residual picked by a hash."""
    ranked = residuals.select("series_id", "e", (F.row_number().over(by_series().orderBy("t")) - 1).alias("i"))
    sizes = residuals.groupBy("series_id").agg(F.count("e").alias("size"))
    rows = forecasts.join(sizes, "series_id").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    keys = [c for c in ("series_id", "win", "pos", "step", "t") if c in forecasts.columns]
    pick = F.pmod(hashed(*[F.col(k) for k in (*keys, "s")], F.lit(seed)), F.col("size")).cast("int")
    return rows.withColumn("i", pick).join(ranked, ["series_id", "i"]).withColumn("v", F.col("f") + F.col("e")).drop("i", "size", "e")


def sample_quantiles(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles P01 .. P99 of samples and the uncertainty P90 - P10."""
    shares = {"p01": 0.01, "p10": 0.10, "p50": 0.50, "p90": 0.90, "p99": 0.99}
    out = samples.groupBy(*keys).agg(*[F.percentile("v", s).alias(n) for n, s in shares.items()])
    return out.withColumn("uncertainty", F.col("p90") - F.col("p10"))


def interval(rows: DataFrame, level: float) -> DataFrame:
    """``low`` and ``high`` columns of a confidence level: 0.98, or 0.90 and 0.80, which share their bounds."""
    columns = {0.98: ("p01", "p99"), 0.90: ("p10", "p90"), 0.80: ("p10", "p90")}
    if level not in columns:
        raise ValueError(f"no interval of level {level}")
    low, high = columns[level]
    return rows.withColumns({"low": F.col(low), "high": F.col(high)})


# --- STL ----------------------------------------------------------------------


def _loess(y: np.ndarray, at: np.ndarray, width: int, weights: np.ndarray) -> np.ndarray:
    """Local lines through (0, y[0]), (1, y[1]), ... by tricube weights of the ``width`` nearest, at given places."""
    n = len(y)
    q = min(width, n)
    begin = np.clip(np.floor(at - (q - 1) / 2).astype(int), 0, n - q)
    index = begin[:, None] + np.arange(q)
    distance = np.abs(index - at[:, None])
    reach = distance.max(axis=1, keepdims=True) + max(0, (width - n) // 2)
    w = np.clip(1 - (distance / np.maximum(reach, 1e-12)) ** 3, 0, None) ** 3 * weights[index]
    w[w.sum(axis=1) == 0] = 1.0
    total = w.sum(axis=1)
    mx = (w * index).sum(axis=1) / total
    my = (w * y[index]).sum(axis=1) / total
    dx = index - mx[:, None]
    sxx = (w * dx * dx).sum(axis=1)
    slope = np.where(sxx > 1e-12 * total * max(n, 1) ** 2, (w * dx * y[index]).sum(axis=1) / np.maximum(sxx, 1e-300), 0.0)
    return my + slope * (at - mx)


def _moving(x: np.ndarray, width: int) -> np.ndarray:
    c = np.concatenate(([0.0], np.cumsum(x)))
    return (c[width:] - c[:-width]) / width


def stl(x: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal-trend decomposition by LOESS (Cleveland et al., 1990): seasonal, trend, remainder."""
    n = len(x)
    if trend is None:
        trend = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
        trend += trend % 2 == 0
    low = period + (period % 2 == 0)
    weights, t, s = np.ones(n), np.zeros(n), np.zeros(n)
    inner, outer = (2, 15) if robust else (5, 1)
    for turn in range(outer):
        for _ in range(inner):
            detrended = x - t
            cycle = np.zeros(n + 2 * period)
            for phase in range(period):
                sub = detrended[phase::period]
                cycle[phase::period][: len(sub) + 2] = _loess(sub, np.arange(-1, len(sub) + 1, dtype=float), seasonal, weights[phase::period])
            filtered = _moving(_moving(_moving(cycle, period), period), 3)
            s = cycle[period : period + n] - _loess(filtered, np.arange(n, dtype=float), low, np.ones(n))
            t = _loess(x - s, np.arange(n, dtype=float), trend, weights)
        if robust and turn < outer - 1:
            r = np.abs(x - s - t)
            bound = 6 * np.median(r)
            if bound <= 0:
                break
            weights = np.clip(1 - (r / bound) ** 2, 0, None) ** 2
    return s, t, x - s - t


def stl_decompose(points: DataFrame, period: int | DataFrame, seasonal: int = 7, robust: bool = True, trend: int | None = None) -> DataFrame:
    """STL of each series: ``seasonal, trend, resid``. A series is one group, as the method needs it whole.

    ``period`` may differ by series (``series_id, period``).
    """
    rows = points.select("series_id", "t", "x")
    rows = rows.join(period.select("series_id", "period"), "series_id") if isinstance(period, DataFrame) else rows.withColumn("period", F.lit(period))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        x = group["x"].to_numpy(float)
        own = max(2, min(int(group["period"].iloc[0]), len(x) // 2 - 1))
        s, t, r = stl(x, own, seasonal, trend, robust) if len(x) >= 4 else (np.zeros(len(x)), x, np.zeros(len(x)))
        return pd.DataFrame({"series_id": group["series_id"], "t": group["t"], "x": x, "seasonal": s, "trend": t, "resid": np.nan_to_num(r)})

    return rows.groupBy("series_id").applyInPandas(run, "series_id string, t int, x double, seasonal double, trend double, resid double")


def fit_stl(train: DataFrame, period: int | DataFrame, seasonal: int = 7, robust: bool = True, trend: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The training model by STL: a line through the trend, the mean seasonal pattern, and the remainders ``e``."""
    parts = settle(with_phase(stl_decompose(train, period, seasonal, robust, trend), period), "stl")
    line = parts.groupBy("series_id").agg(F.regr_slope("trend", "t").alias("slope"), F.regr_intercept("trend", "t").alias("intercept"))
    season = parts.groupBy("series_id", "phase").agg(F.avg("seasonal").alias("seasonal"))
    return line, season, parts.select("series_id", "t", F.col("resid").alias("e"))


# --- forecasters --------------------------------------------------------------


class Forecaster(Protocol):
    """A model over one context: sampled paths of shape (samples, horizon)."""

    def forecast(self, context: np.ndarray, horizon: int) -> np.ndarray: ...


class Naive:
    """The last value, with a random walk's spread at fixed quantile levels."""

    levels = np.array([-2.326348, -1.281552, 0.0, 1.281552, 2.326348])

    def forecast(self, context: np.ndarray, horizon: int) -> np.ndarray:
        sd = np.std(np.diff(context)) if len(context) > 1 else 0.0
        return context[-1] + self.levels[:, None] * sd * np.sqrt(np.arange(1, horizon + 1))


class SeasonalNaive:
    """The value one period before."""

    def __init__(self, period: int) -> None:
        self.period = period

    def forecast(self, context: np.ndarray, horizon: int) -> np.ndarray:
        p = min(self.period, len(context))
        base = context[len(context) - p + np.arange(horizon) % p]
        sd = np.std(context[p:] - context[:-p]) if len(context) > p else 0.0
        return base + Naive.levels[:, None] * sd


class Drift:
    """The line through the first and the last value."""

    def forecast(self, context: np.ndarray, horizon: int) -> np.ndarray:
        slope = (context[-1] - context[0]) / (len(context) - 1) if len(context) > 1 else 0.0
        sd = np.std(np.diff(context) - slope) if len(context) > 1 else 0.0
        return context[-1] + slope * np.arange(1, horizon + 1) + Naive.levels[:, None] * sd * np.sqrt(np.arange(1, horizon + 1))


def forecast_windows(windows: DataFrame, model: Forecaster, horizon: int, name: str) -> DataFrame:
    """Forecasts from each window's values: median ``f``, quantiles, and ``error`` where the model failed (then zeros)."""
    schema = "series_id string, win int, step int, model string, f double, p10 double, p90 double, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for series, win, values in zip(batch["series_id"], batch["win"], batch["values"], strict=True):
                try:
                    paths, error = model.forecast(np.asarray(values, float), horizon), None
                    f, low, high = np.median(paths, 0), np.percentile(paths, 10, 0), np.percentile(paths, 90, 0)
                except Exception as failed:  # a window that fails is reported, as a series of zeros
                    f = low = high = np.zeros(horizon)
                    error = str(failed)
                rows.append(pd.DataFrame({"series_id": series, "win": win, "step": range(horizon), "model": name, "f": f, "p10": low, "p90": high, "error": error}))
            if rows:
                yield pd.concat(rows)

    return windows.select("series_id", "win", "values").mapInPandas(run, schema)


def seasonal_naive(points: DataFrame, period: int) -> DataFrame:
    """Points with ``f``, the value one period before, as a plain self-join."""
    past = points.select("series_id", (F.col("t") + period).alias("t"), F.col("x").alias("f"))
    return points.join(past, ["series_id", "t"])


def naive_window_forecast(windows: DataFrame, horizon: int, kind: str) -> DataFrame:
    """The point forecasts of :class:`Naive` and :class:`Drift` as column expressions."""
    v = F.col("values")
    last, first, n = F.element_at(v, -1), F.element_at(v, 1), F.size(v)
    slope = F.when(n > 1, (last - first) / (n - 1)).otherwise(0.0) if kind == "drift" else F.lit(0.0)
    step = F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))
    return windows.select("series_id", "win", last.alias("l"), slope.alias("b"), step.alias("step")).select("series_id", "win", "step", F.lit(kind).alias("model"), (F.col("l") + F.col("b") * (F.col("step") + 1)).alias("f"))


def forecast_paths(windows: DataFrame, model: Forecaster, horizon: int, name: str) -> DataFrame:
    """The sampled values ``v`` of a model's forecasts (``pos``: steps ahead, from 0); a window that fails has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for series, win, values in zip(batch["series_id"], batch["win"], batch["values"], strict=True):
                try:
                    paths = np.asarray(model.forecast(np.asarray(values, float), horizon))
                except Exception:  # reported by forecast_windows
                    continue
                yield pd.DataFrame({"series_id": series, "win": win, "pos": np.tile(np.arange(horizon), len(paths)), "model": name, "v": paths.reshape(-1)})

    return windows.select("series_id", "win", "values").mapInPandas(run, "series_id string, win int, pos int, model string, v double")


def ensemble(forecasts: list[DataFrame], strategy: str = "average") -> DataFrame:
    """Mean of the models' forecasts by window and step; failed ones are left out. A model's name picks that model."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), forecasts)
    if "error" in rows.columns:
        rows = rows.where("error is null")
    if strategy != "average":
        rows = rows.where(F.col("model") == strategy)
    spread = F.stddev_pop("f")
    if {"p10", "p90"} <= set(rows.columns):
        spread = F.coalesce(F.avg(F.col("p90") - F.col("p10")), spread)
    return rows.groupBy("series_id", "win", "step").agg(F.avg("f").alias("f"), F.coalesce(spread, F.lit(0.0)).alias("uncertainty"), F.count("f").alias("n_models"))


def model_agreement(forecasts: list[DataFrame]) -> DataFrame:
    """Mean correlation of the models' forecasts over all pairs, per window; 1 with fewer than two models."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select("series_id", "win", "step", "model", "f") for f in forecasts])
    a, b = rows, rows.select("series_id", "win", "step", F.col("model").alias("m2"), F.col("f").alias("g"))
    pairs = a.join(b, ["series_id", "win", "step"]).where("model < m2").groupBy("series_id", "win", "model", "m2").agg(F.corr("f", "g").alias("r"))
    mean = pairs.groupBy("series_id", "win").agg(F.avg("r").alias("agreement"))
    return rows.select("series_id", "win").distinct().join(mean, ["series_id", "win"], "left").select("series_id", "win", F.coalesce("agreement", F.lit(1.0)).alias("agreement"))


def align_forecasts(windows: DataFrame, forecasts: DataFrame, width: int, step: int, mode: str) -> DataFrame:
    """Actual values beside forecasts (``series_id, win, step, f``).

    ``inside``: a forecast is of its own window. ``ahead``: it is of the window
    that begins where its context ends, which needs the width to be a multiple
    of the step; contexts without such a window drop out.
    """
    f = forecasts.withColumnRenamed("step", "pos")
    if mode == "ahead":
        if width % step:
            raise ValueError("the width must be a multiple of the step")
        f = f.withColumn("win", F.col("win") + width // step)
    elif mode != "inside":
        raise ValueError(mode)
    return windows.join(f, ["series_id", "win", "pos"])
