"""Evaluation of predictions and scores against labels, per series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.scoring import at_thresholds, by_series, extract_segments, f1, precision, recall


def confusion(rows: DataFrame) -> DataFrame:
    """``tp, fp, fn, tn`` of rows with ``y`` and ``pred``."""
    y, p = F.col("y") == 1, F.col("pred") == 1
    return rows.groupBy("series_id").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def point_metrics(rows: DataFrame) -> DataFrame:
    """Precision and recall (1 where nothing was to be found or flagged) and F1."""
    c = confusion(rows)
    c = c.withColumns({"precision": precision(F.col("tp"), F.col("fp")), "recall": recall(F.col("tp"), F.col("fn"))})
    return c.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def _runs_hit(rows: DataFrame, flag: str, other: str, n: str, hit: str) -> DataFrame:
    """Per series, the runs of ``flag`` and how many of them hold a point of ``other``."""
    runs = rows.where(F.col(flag) == 1).withColumn("run", F.col("t") - F.row_number().over(by_series().orderBy("t")))
    each = runs.groupBy("series_id", "run").agg(F.max((F.col(other) == 1).cast("int")).alias("hit"))
    return each.groupBy("series_id").agg(F.count(F.lit(1)).alias(n), F.sum("hit").alias(hit))


def segment_f1(rows: DataFrame) -> DataFrame:
    """F1 of segments: true ones that any predicted one overlaps, and predicted ones that any true one overlaps.

    Segments are runs of points and overlap where they share one, so runs are counted, not joined.
    """
    out = rows.select("series_id").distinct()
    for sides in (("y", "pred", "n_true", "found"), ("pred", "y", "n_pred", "right")):
        out = out.join(_runs_hit(rows, *sides), "series_id", "left")
    out = out.na.fill(0)
    score = f1(F.col("right") / F.col("n_pred"), F.col("found") / F.col("n_true"))
    value = F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 1.0).when((F.col("n_true") == 0) | (F.col("n_pred") == 0), 0.0).otherwise(score)
    return out.select("series_id", "n_true", "n_pred", value.alias("pa_f1"))


def pr_area(scored: DataFrame, count: int = 200) -> DataFrame:
    """Area under precision over recall at evenly spaced thresholds, in order of recall, then of falling threshold."""
    span = scored.groupBy("series_id").agg(F.min("score").alias("a"), F.max("score").alias("b"), F.sum("y").alias("p"), F.sum("score").alias("s"))
    steps = span.select("series_id", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))
    value = F.when(F.col("k") == count - 1, F.col("b")).otherwise(F.col("a") + F.col("k") * ((F.col("b") - F.col("a")) / (count - 1)))
    at = at_thresholds(scored, steps.select("series_id", "k", value.alias("threshold")))
    curve = at.select("series_id", "k", precision(F.col("tp"), F.col("fp")).alias("pr"), recall(F.col("tp"), F.col("fn")).alias("re"))
    order = by_series().orderBy("re", F.col("k").desc())
    part = (F.col("re") - F.lag("re").over(order)) * (F.col("pr") + F.lag("pr").over(order)) / 2
    area = curve.withColumn("part", part).groupBy("series_id").agg(F.sum("part").alias("area"))
    out = F.when(F.col("p") == 0, F.when(F.col("s") == 0, 1.0).otherwise(0.0)).when(F.col("a") == F.col("b"), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("area"))))
    return span.join(area, "series_id", "left").select("series_id", out.alias("pr_auc"))


def evaluate(rows: DataFrame) -> DataFrame:
    """All metrics of rows with ``y, pred, score``."""
    return point_metrics(rows).join(segment_f1(rows), "series_id").join(pr_area(rows), "series_id")


def classify_ranges(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Per series, overlap of found ranges with true segments (the true points inside each), and a class for the series."""
    inside = found.where("seg_start < seg_end").select("series_id", F.explode(F.sequence(F.col("seg_start"), F.col("seg_end") - 1)).alias("t"))
    overlap = inside.join(rows.where("y = 1").select("series_id", "t"), ["series_id", "t"]).groupBy("series_id").agg(F.count(F.lit(1)).alias("overlap"))
    out = rows.select("series_id").distinct()
    for df, name in ((found, "n_found"), (extract_segments(rows, "y"), "n_true")):
        out = out.join(df.groupBy("series_id").agg(F.count(F.lit(1)).alias(name)), "series_id", "left")
    out = out.join(overlap, "series_id", "left").na.fill(0)
    kind = F.when((F.col("n_true") == 0) & (F.col("n_found") == 0), "true_negative").when(F.col("n_true") == 0, "false_positive").when(F.col("overlap") > 0, "partial_match").when(F.col("n_found") > 0, "missed").otherwise("no_anomalies")
    return out.withColumn("class", kind)


def signal_diagnostics(signals: DataFrame) -> DataFrame:
    """Greatest CUSUM and where it first is, and mean deviations inside and outside the labels."""
    top = F.max(F.struct(F.col("cusum"), (-F.col("t")).alias("at")))
    return signals.groupBy("series_id").agg(top["cusum"].alias("max_cusum"), (-top["at"]).alias("argmax_cusum"), F.avg(F.when(F.col("y") == 1, F.abs("rmdev"))).alias("mean_rmdev_in"), F.avg(F.when(F.col("y") == 0, F.abs("rmdev"))).alias("mean_rmdev_out"))


def score_profile(scores: DataFrame) -> DataFrame:
    return scores.groupBy("series_id").agg(F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean"), F.countDistinct("score").alias("n_distinct"))


def series_records(rows: DataFrame, segments: DataFrame, window_scores: DataFrame, k: int = 5, most: int = 20, signals: DataFrame | None = None, seconds: float | None = None) -> DataFrame:
    """One nested record per series for a JSON log: metrics, overlap class, first segments, top windows.

    With ``signals`` (of :func:`scoring.derived_signals`, labelled) also the CUSUM diagnostics, with ``seconds`` the time of the run.
    """
    first = segments.withColumn("r", F.row_number().over(by_series().orderBy("seg_start")))
    seg = first.groupBy("series_id").agg(F.sort_array(F.collect_list(F.when(F.col("r") <= most, F.struct("seg_start", "seg_end")))).alias("segments"), (F.count(F.lit(1)) > most).alias("more_segments"))
    ranked = window_scores.withColumn("r", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("score").desc(), "win"))).where(F.col("r") <= k)
    top = ranked.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("r", "win", "score"))).alias("top_windows"))
    out = point_metrics(rows).join(classify_ranges(segments, rows), "series_id").join(seg, "series_id", "left").join(top, "series_id", "left")
    if signals is not None:
        out = out.join(signal_diagnostics(signals), "series_id", "left")
    return out if seconds is None else out.withColumn("seconds", F.lit(float(seconds)))
