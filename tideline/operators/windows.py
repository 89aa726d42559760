"""Sliding windows, scaling and reconstruction.

Windows are rows ``series_id, win, pos, t, x``: a point once for each window
that covers it. They come from an explode on the point itself, so a long
series is spread over tasks by ``(series_id, win)`` and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.sources.series import series_lengths


def window_points(points: DataFrame, width: int, step: int) -> DataFrame:
    """Points by window; the incomplete tail is dropped."""
    sized = points.join(series_lengths(points), "series_id") if "n" not in points.columns else points
    t = F.col("t")
    first = F.greatest(F.lit(0), F.floor((t - width + step) / F.lit(step))).cast("int")
    last = F.least(F.floor(t / F.lit(step)), F.floor((F.col("n") - width) / F.lit(step))).cast("int")
    out = sized.where((last >= first) & (F.col("n") >= width)).withColumn("win", F.explode(F.sequence(first, last)))
    return out.select("series_id", "win", (t - F.col("win") * step).alias("pos"), *[c for c in points.columns if c not in ("series_id", "n")])


def create_windows(points: DataFrame, width: int, step: int) -> DataFrame:
    """One row per window with its values in order."""
    w = window_points(points, width, step).groupBy("series_id", "win").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return w.select("series_id", "win", (F.col("win") * step).alias("start"), F.col("v.x").alias("values"))


def coverage(points: DataFrame, width: int, step: int) -> DataFrame:
    """Points with ``n`` and ``c``, the number of windows that cover each."""
    sized = points.join(series_lengths(points), "series_id")
    t = F.col("t")
    first = F.greatest(F.lit(0), F.floor((t - width + step) / F.lit(step)))
    last = F.least(F.floor(t / F.lit(step)), F.floor((F.col("n") - width) / F.lit(step)))
    return sized.withColumn("c", F.greatest(F.lit(0), last - first + 1).cast("int"))


def fit_scaler(points: DataFrame, width: int, step: int) -> DataFrame:
    """Mean and population deviation over all overlapping windows, per series; a zero deviation scales by 1."""
    c = coverage(points, width, step).where("c > 0")
    sums = c.groupBy("series_id").agg(F.sum("c").alias("w"), F.sum(F.col("c") * F.col("x")).alias("s"))
    centred = c.join(sums.select("series_id", "w", (F.col("s") / F.col("w")).alias("mean")), "series_id")
    return centred.groupBy("series_id").agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("c") * (F.col("x") - F.col("mean")) ** 2) / F.first("w")).alias("std")).withColumn("scale", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def scale(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Standardised values by a scaler's ``mean`` and ``scale``."""
    return rows.join(model.select("series_id", "mean", "scale"), "series_id").withColumn("x", (F.col("x") - F.col("mean")) / F.col("scale")).drop("mean", "scale")


QUANTILES = [0.01, 0.10, 0.25, 0.50, 0.75, 0.90, 0.99]


def train_stats(points: DataFrame, width: int, step: int) -> DataFrame:
    """Mean, deviation (plus 1e-10), extremes and seven quantiles over all overlapping windows."""
    c = coverage(points, width, step).where("c > 0")
    q = F.percentile("x", F.array(*[F.lit(p) for p in QUANTILES]), F.col("c").cast("long"))
    stats = c.groupBy("series_id").agg(q.alias("q"), F.min("x").alias("min"), F.max("x").alias("max"))
    model = fit_scaler(points, width, step).select("series_id", "mean", (F.col("std") + 1e-10).alias("std"))
    return model.join(stats, "series_id").select("series_id", "mean", "std", "min", "max", *[F.col("q")[k].alias(f"p{int(round(p * 100)):02d}") for k, p in enumerate(QUANTILES)])


def standardize(points: DataFrame, stats: DataFrame) -> DataFrame:
    return points.join(stats.select("series_id", "mean", "std"), "series_id").withColumn("x", (F.col("x") - F.col("mean")) / F.col("std")).drop("mean", "std")


def reconstruct(windows: DataFrame, step: int) -> DataFrame:
    """Points from window rows (``win, pos, x``): the mean of overlapping values."""
    return windows.groupBy("series_id", (F.col("win") * step + F.col("pos")).cast("int").alias("t")).agg(F.avg("x").alias("x"))


def fit_length(points: DataFrame, length: int) -> DataFrame:
    """Every series cut or filled with zeros to a length."""
    spine = points.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t"))
    return spine.join(points.select("series_id", "t", "x"), ["series_id", "t"], "left").select("series_id", "t", F.coalesce("x", F.lit(0.0)).alias("x"))


def scale_to_range(points: DataFrame, low: float, high: float, constant: str = "middle") -> DataFrame:
    """Min-max scaling per series; a constant series goes to the middle, or to ``low``."""
    span = points.groupBy("series_id").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    flat = (low + high) / 2 if constant == "middle" else low
    scaled = F.when(F.col("b") > F.col("a"), low + (F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * (high - low)).otherwise(flat)
    return points.join(span, "series_id").withColumn("x", scaled).drop("a", "b")


def pad_to_multiple(values: Column, size: int) -> Column:
    """An array with its first value repeated in front, up to a multiple of a length."""
    missing = F.pmod(-F.size(values), F.lit(size))
    return F.concat(F.array_repeat(F.element_at(values, 1), missing), values)


def top_windows(scores: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The k highest (or lowest) windows of each series; ties go to the earlier window."""
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("win")]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy(*order))).where(F.col("rank") <= k)
