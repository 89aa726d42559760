"""Points from tables: series definitions, splits, and label segments."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The synthetic benchmark's categories of anomaly.
CATEGORIES = ["point", "trend", "range", "freq", "noisy-point", "noisy-trend", "noisy-freq", "flat-trend"]


def number_points(rows: DataFrame, series: Column, order: list[Column], x: Column, y: Column) -> DataFrame:
    """Points of ordered rows: ``t`` counts from 0 in each series."""
    w = Window.partitionBy("series_id").orderBy(*[f"__o{k}" for k in range(len(order))])
    picked = rows.select(series.alias("series_id"), x.cast("double").alias("x"), y.cast("int").alias("y"), *[o.alias(f"__o{k}") for k, o in enumerate(order)])
    return picked.select("series_id", (F.row_number().over(w) - 1).alias("t"), "x", "y")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per event type; a value over 150 is labelled anomalous."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return number_points(events, F.col("event_type"), [F.col("ts"), F.col("event_id")], F.col("value"), F.col("value") > 150)


def hourly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: the sum of values per hour, with empty hours as 0."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sums = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("x"))
    span = sums.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    spine = span.select(F.posexplode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("t", "hour"))
    return spine.join(sums, "hour", "left").select(F.lit("hourly").alias("series_id"), "t", F.coalesce("x", F.lit(0.0)).alias("x"), F.lit(0).alias("y"))


def daily_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: shipped value per day, with empty days as 0."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sums = items.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("x"))
    span = sums.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = span.select(F.posexplode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("t", "day"))
    return spine.join(sums, "day", "left").select(F.lit("ship_daily").alias("series_id"), "t", F.coalesce("x", F.lit(0.0)).alias("x"), F.lit(0).alias("y"))


def series_lengths(points: DataFrame) -> DataFrame:
    return points.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


def label_points(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Points with label 1 inside half-open segments (``series_id, seg_start, seg_end``) and 0 elsewhere."""
    marked = segments.where("seg_end > seg_start").select("series_id", F.explode(F.sequence(F.col("seg_start"), F.col("seg_end") - 1)).alias("t")).distinct().withColumn("__y", F.lit(1))
    return points.drop("y").join(marked, ["series_id", "t"], "left").select(*[c for c in points.columns if c != "y"], F.coalesce("__y", F.lit(0)).alias("y"))


def split_points(points: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """``split`` and ``n`` columns by position; labels of the training part are 0."""
    sized = points.join(series_lengths(points), "series_id")
    a = F.floor(F.col("n") * train).cast("int")
    b = F.floor(F.col("n") * (train + validation)).cast("int")
    split = F.when(F.col("t") < a, "train").when(F.col("t") < b, "val").otherwise("test")
    return sized.withColumn("split", split).withColumn("y", F.when(F.col("split") == "train", 0).otherwise(F.col("y")))


def load_category(train: DataFrame, evaluation: DataFrame, category: str, by: str = "series") -> DataFrame:
    """A category's points as one dataset: training labels 0, the evaluation part halved into ``val`` and ``test``.

    ``by="series"`` halves each series; ``by="rows"`` all of its rows, series after series in order of their ids.
    """
    lengths = series_lengths(evaluation)
    if by == "series":
        place, half = F.col("t"), F.floor(F.col("n") / 2)
    elif by == "rows":
        # One row per series is put in order, not one per point.
        ahead = Window.orderBy("series_id").rowsBetween(Window.unboundedPreceding, -1)
        total = lengths.agg(F.floor(F.sum("n") / 2).alias("half"))
        lengths = lengths.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).crossJoin(F.broadcast(total))
        place, half = F.col("ahead") + F.col("t"), F.col("half")
    else:
        raise ValueError(by)
    halves = evaluation.join(lengths, "series_id").withColumn("split", F.when(place < half, "val").otherwise("test")).select(*evaluation.columns, "split")
    return train.withColumn("y", F.lit(0)).withColumn("split", F.lit("train")).unionByName(halves).withColumn("category", F.lit(category))


class _ArraysOnly(pickle.Unpickler):
    """Reads arrays, lists, tuples, dicts and numbers; a file that names anything else is refused."""

    def find_class(self, module: str, name: str) -> Any:
        if (module.split(".")[0], name) in {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy", "scalar"), ("numpy", "_reconstruct"), ("numpy", "_frombuffer")}:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def read_published(spark: SparkSession, base: str, category: str, split: str) -> DataFrame:
    """Points of the published layout ``<category>/<split>/data.pkl``: a dict of ``series`` (arrays of points by dimensions) and ``anom`` (half-open segments per dimension).

    A dimension is a series ``<category>/<split>/<number>[/<dimension>]``; a point is labelled if a segment of any dimension holds it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                data = _ArraysOnly(io.BytesIO(raw)).load()
                for number, (values, segments) in enumerate(zip(data["series"], data["anom"], strict=True)):
                    values = np.asarray(values, float).reshape(len(values), -1)
                    y = np.zeros(len(values), np.int32)
                    for start, end in (s for own in segments for s in own):
                        y[int(start) : int(end)] = 1
                    for d in range(values.shape[1]):
                        name = f"{category}/{split}/{number:06d}" + (f"/{d}" if values.shape[1] > 1 else "")
                        yield pd.DataFrame({"series_id": name, "t": np.arange(len(values), dtype=np.int32), "x": values[:, d], "y": y})

    files = spark.read.format("binaryFile").load(f"{base}/{category}/{split}/data.pkl").select("content")
    return files.mapInPandas(run, "series_id string, t int, x double, y int")


def load_series(spark: SparkSession, path: str, category: str, split: str) -> DataFrame:
    """Points of one category and split from a dataset partitioned by both, as :func:`write_series` leaves it."""
    return spark.read.parquet(path).where((F.col("category") == category) & (F.col("split") == split)).drop("category", "split")


def load_all_categories(spark: SparkSession, path: str) -> DataFrame:
    """Points of all known categories that the dataset has."""
    return spark.read.parquet(path).where(F.col("category").isin(CATEGORIES))


def write_series(points: DataFrame, path: str) -> None:
    points.write.partitionBy("category", "split").mode("overwrite").parquet(path)


def few_shot(points: DataFrame, count: int = 5) -> DataFrame:
    """Points of ``count`` series, picked by a hash of their ids."""
    picked = points.select("series_id").distinct().withColumn("h", F.md5(F.col("series_id").cast("string"))).orderBy("h", "series_id").limit(count)
    return points.join(picked.select("series_id"), "series_id", "left_semi")


def head(points: DataFrame, count: int) -> DataFrame:
    return points.where(F.col("t") < count)


def hashed(*key: Column) -> Column:
    """Forty bits of the MD5 digest of some values, which any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 10), 16, 10).cast("long")


def synthetic(spark: SparkSession, n: int = 2000, dims: int = 1, anomaly_ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """A sine per dimension with deterministic noise and planted segments: ``series_id, t, x, y, split``.

    Dimension d has frequency 1 + d / 2 on ten half-turns; n * ratio / 5
    segments of 3 to 9 points are spikes, shifts or trends.
    """

    def unit(*key: Column) -> Column:
        return hashed(*key, F.lit(seed)) / 2.0**40

    count = max(1, int(n * anomaly_ratio / 5))
    base = spark.range(n).select(F.col("id").cast("int").alias("t")).crossJoin(F.broadcast(spark.range(dims).select(F.col("id").cast("int").alias("d"))))
    angle = F.col("t") * (10 * 3.141592653589793 / max(n - 1, 1))
    phase = unit(F.lit("phase"), F.col("d")) * 6.283185307179586
    u = F.greatest(unit(F.lit("u"), F.col("t"), F.col("d")), F.lit(1e-9))
    noise = 0.1 * F.sqrt(-2 * F.ln(u)) * F.cos(6.283185307179586 * unit(F.lit("v"), F.col("t"), F.col("d")))
    clean = base.select("t", "d", (F.sin((1 + 0.5 * F.col("d")) * angle + phase) + noise).alias("x"))
    k = F.col("id")
    segments = spark.range(count).select(
        (unit(F.lit("start"), k) * max(n - 10, 1)).cast("int").alias("a"), (3 + unit(F.lit("length"), k) * 7).cast("int").alias("size"), (unit(F.lit("kind"), k) * 3).cast("int").alias("kind"), (2 + 3 * unit(F.lit("height"), k)).alias("height")
    )
    inside = segments.select(F.explode(F.sequence(F.col("a"), F.least(F.col("a") + F.col("size"), F.lit(n)) - 1)).alias("t"), F.when(F.col("kind") == 0, F.col("height")).when(F.col("kind") == 1, F.col("height") / 2).otherwise(None).alias("jump"), "a", "size", "height")
    lift = inside.groupBy("t").agg(F.sum(F.coalesce("jump", F.col("height") * (F.col("t") - F.col("a")) / F.col("size"))).alias("lift"))
    out = clean.join(lift, "t", "left").select(F.concat(F.lit("dim"), F.col("d").cast("string")).alias("series_id"), "t", (F.col("x") + F.coalesce("lift", F.lit(0.0))).alias("x"), F.col("lift").isNotNull().cast("int").alias("y"))
    return split_points(out).drop("n")


def sine_with_shifts(spark: SparkSession, length: int, positions: list[tuple[int, int]], shift: float = 5.0) -> DataFrame:
    """A sine with level shifts at half-open positions."""
    inside = F.lit(False)
    for a, b in positions:
        inside = inside | ((F.col("t") >= a) & (F.col("t") < b))
    wave = F.sin(F.col("t") * (10 * 3.141592653589793 / max(length - 1, 1)))
    return spark.range(length).select(F.lit("sine").alias("series_id"), F.col("id").cast("int").alias("t")).select("series_id", "t", (wave + F.when(inside, shift).otherwise(0.0)).alias("x"), inside.cast("int").alias("y"))
