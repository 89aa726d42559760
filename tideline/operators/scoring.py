"""Window scores to point scores, thresholds, and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.stats import gaussian_kernel
from tideline.operators.evidence import cusum_paths


def by_series():
    return Window.partitionBy("series_id")


def in_order():
    return by_series().orderBy("t")


def _covering(scores: DataFrame, width: int, step: int) -> DataFrame:
    """Window scores on every point that the window covers."""
    return scores.select("series_id", "score", "win", F.explode(F.sequence(F.col("win") * step, F.col("win") * step + width - 1)).alias("t"))


def _on_points(points: DataFrame, pooled: DataFrame) -> DataFrame:
    return points.select("series_id", "t").join(pooled, ["series_id", "t"], "left").select("series_id", F.col("t").cast("int").alias("t"), F.coalesce("score", F.lit(0.0)).alias("score"))


def pool_max(scores: DataFrame, points: DataFrame, width: int, step: int) -> DataFrame:
    """The greatest score of the covering windows, at least 0; 0 where none covers."""
    pooled = _covering(scores, width, step).groupBy("series_id", "t").agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"))
    return _on_points(points, pooled)


def pool_average(scores: DataFrame, points: DataFrame, width: int, step: int) -> DataFrame:
    """The mean score of the covering windows; 0 where none covers."""
    return _on_points(points, _covering(scores, width, step).groupBy("series_id", "t").agg(F.avg("score").alias("score")))


def pool_gaussian(scores: DataFrame, points: DataFrame, width: int, step: int) -> DataFrame:
    """The mean weighted by a Gaussian about each window's middle, with a deviation of a sixth of its width."""
    d = (F.col("t") - F.col("win") * step - width / 2) / (width / 6)
    rows = _covering(scores, width, step).withColumn("g", F.exp(-0.5 * d * d))
    return _on_points(points, rows.groupBy("series_id", "t").agg((F.sum(F.col("g") * F.col("score")) / F.greatest(F.sum("g"), F.lit(1e-8))).alias("score")))


def smooth_gaussian(point_scores: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Gaussian smoothing with the ends reflected; every value goes to the places that its weight reaches."""
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2
    sized = point_scores.join(point_scores.groupBy("series_id").agg(F.count("score").alias("n")), "series_id")
    weights = F.array(*[F.lit(w) for w in kernel])
    reach = sized.select("series_id", "t", "n", F.posexplode(weights).alias("k", "w"))
    u = F.col("t") + F.col("k") - radius
    period = F.pmod(u, 2 * F.col("n"))
    source = F.when(period < F.col("n"), period).otherwise(2 * F.col("n") - 1 - period)
    asked = reach.select("series_id", F.col("t").alias("at"), source.cast("int").alias("t"), "w")
    return asked.join(point_scores.select("series_id", "t", "score"), ["series_id", "t"]).groupBy("series_id", F.col("at").alias("t")).agg(F.sum(F.col("w") * F.col("score")).alias("score"))


def percent_ranks(scores: DataFrame) -> DataFrame:
    """Window scores with ``percent_rank``, the share of the series' other windows that score less."""
    return scores.withColumn("percent_rank", F.percent_rank().over(by_series().orderBy("score")))


# --- range detection ----------------------------------------------------------


def derived_signals(points: DataFrame, slack: float = 3.0, width: int = 50) -> DataFrame:
    """Points with ``std``, ``cusum`` and ``rmdev``, the trailing mean less the mean."""
    stats = points.groupBy("series_id").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(1e-10)).alias("std"))
    paths = cusum_paths(points.join(stats, "series_id"), F.col("mean"), F.col("std"), slack, ["series_id"], "t")
    trailing = in_order().rowsBetween(-(width - 1), 0)
    return paths.withColumns({"cusum": F.greatest("up", "down"), "rmdev": F.avg("x").over(trailing) - F.col("mean")}).drop("up", "down")


def cusum_gate(signals: DataFrame, bound: float = 2.0) -> DataFrame:
    """Per series, the greatest CUSUM in deviations and whether it is worth a closer look."""
    level = signals.groupBy("series_id").agg((F.max("cusum") / F.max("std")).alias("level"))
    return level.withColumn("passes", F.col("level") >= bound)


def range_cap(lengths: DataFrame, ratio: float, least: int) -> DataFrame:
    return lengths.withColumn("max_ranges", F.greatest(F.lit(least), F.floor(F.col("n") * ratio)).cast("int"))


def _clip(ranges: DataFrame, lengths: DataFrame) -> DataFrame:
    clipped = ranges.join(lengths.select("series_id", "n"), "series_id")
    return clipped.select("series_id", F.greatest(F.lit(0), "seg_start").alias("seg_start"), F.least("n", "seg_end").alias("seg_end"), "n").where("seg_start < seg_end")


def validate_ranges(ranges: DataFrame, signals: DataFrame, lengths: DataFrame, bound: float = 0.5) -> DataFrame:
    """Ranges whose mean deviation of the running mean is large enough."""
    r = _clip(ranges, lengths).select("series_id", "seg_start", "seg_end", F.explode(F.sequence(F.col("seg_start"), F.col("seg_end") - 1)).alias("t"))
    level = r.join(signals, ["series_id", "t"]).groupBy("series_id", "seg_start", "seg_end").agg((F.avg(F.abs("rmdev")) / F.max("std")).alias("level"))
    return level.where(F.col("level") >= bound)


def refine_ranges(ranges: DataFrame, signals: DataFrame, lengths: DataFrame, reach: int = 50, bound: float = 0.5, least: int = 3) -> DataFrame:
    """Each range replaced by the stretch about its nearby peak where the running mean stays deviant."""
    level = signals.select("series_id", "t", (F.abs("rmdev") / F.col("std")).alias("v"))
    r = _clip(ranges, lengths)
    near = r.select("series_id", "seg_start", "seg_end", "n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("seg_start") - reach), F.least(F.col("n"), F.col("seg_end") + reach) - 1)).alias("t"))
    top = near.join(level, ["series_id", "t"]).groupBy("series_id", "seg_start", "seg_end").agg(F.max(F.struct(F.col("v"), (-F.col("t")).alias("at"))).alias("top"))
    peaks = top.select("series_id", "seg_start", "seg_end", (-F.col("top.at")).alias("peak"))
    # A peak's island, or those that end or begin beside it, are met at the peak's own and neighbouring points.
    flagged = level.where(F.col("v") >= bound).withColumn("island", F.col("t") - F.row_number().over(in_order()))
    islands = flagged.groupBy("series_id", "island").agg(F.min("t").alias("a"), (F.max("t") + 1).alias("b"))
    beside = peaks.withColumn("t", F.explode(F.array(F.col("peak") - 1, F.col("peak"), F.col("peak") + 1)))
    touching = beside.join(flagged.select("series_id", "t", "island"), ["series_id", "t"]).join(islands, ["series_id", "island"])
    grown = touching.groupBy("series_id", "seg_start", "seg_end", "peak").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    whole = peaks.join(grown, ["series_id", "seg_start", "seg_end", "peak"], "left")
    out = whole.select("series_id", F.least("peak", F.coalesce("a", "peak")).alias("seg_start"), F.greatest(F.col("peak") + 1, F.coalesce("b", "peak")).alias("seg_end"))
    return out.where(F.col("seg_end") - F.col("seg_start") >= least).distinct()


def ranges_to_scores(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """1 on points inside a range, else 0."""
    inside = ranges.where("seg_end > greatest(seg_start, 0)").select("series_id", F.explode(F.sequence(F.greatest(F.lit(0), "seg_start"), F.col("seg_end") - 1)).alias("t")).distinct().withColumn("score", F.lit(1.0))
    return _on_points(points, inside)


# --- thresholds ---------------------------------------------------------------


def percentile_threshold(scores: DataFrame, percentile: float = 95.0) -> DataFrame:
    return scores.groupBy("series_id").agg(F.percentile("score", percentile / 100).alias("threshold"))


def fixed_threshold(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.select("series_id").distinct().withColumn("threshold", F.lit(float(threshold)))


def deviation_threshold(scores: DataFrame, k: float = 3.0) -> DataFrame:
    """Mean plus k population deviations."""
    return scores.groupBy("series_id").agg((F.avg("score") + k * F.stddev_pop("score")).alias("threshold"))


def counts_above(scored: DataFrame) -> DataFrame:
    """Per distinct score, the true and false positives of predicting every point with at least that score.

    Scores are first counted, so the running sums are over distinct values.
    """
    each = scored.groupBy("series_id", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    above = by_series().orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return each.select("series_id", "score", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"))


def at_thresholds(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``tp, fp, fn`` at each row of ``thresholds`` (``series_id, k, threshold``), by one sorted pass over both."""
    marks = counts_above(scored).select("series_id", F.col("score").alias("v"), F.lit(1).alias("kind"), "tp", "fp", F.lit(None).cast("int").alias("k"))
    asks = thresholds.select("series_id", F.col("threshold").alias("v"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("tp"), F.lit(None).cast("long").alias("fp"), "k")
    # From the greatest value down, a threshold comes after the scores that reach it.
    falling = by_series().orderBy(F.col("v").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = scored.groupBy("series_id").agg(F.sum("y").alias("p"))
    found = marks.unionByName(asks).withColumns({"tp": F.last("tp", True).over(falling), "fp": F.last("fp", True).over(falling)}).where("k is not null")
    return found.join(total, "series_id").select("series_id", "k", F.col("v").alias("threshold"), F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"), (F.col("p") - F.coalesce("tp", F.lit(0))).alias("fn"))


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def f1_threshold(scored: DataFrame, candidates: int = 100, low: float = 80.0, high: float = 99.9, strict: bool = False) -> DataFrame:
    """The percentile of the scores with the best F1; the lowest of equals, and 0 if none has a positive F1.

    ``strict`` gives a null threshold in the latter case, so nothing is flagged.
    """
    shares = [(low + (high - low) * k / (candidates - 1)) / 100 for k in range(candidates)]
    q = scored.groupBy("series_id").agg(F.percentile("score", F.array(*[F.lit(s) for s in shares])).alias("q"))
    tried = at_thresholds(scored, q.select("series_id", F.posexplode("q").alias("k", "threshold")))
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    best = tried.withColumn("f1", f1(p, r)).groupBy("series_id").agg(F.max(F.struct(F.col("f1"), (-F.col("k")).alias("o"), F.col("threshold"))).alias("b"))
    return best.select("series_id", F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(None if strict else 0.0).alias("threshold"), F.col("b.f1").alias("f1"))


def predict(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    return scores.join(thresholds.select("series_id", "threshold"), "series_id").withColumn("pred", F.coalesce((F.col("score") >= F.col("threshold")).cast("int"), F.lit(0)))


# --- segments -----------------------------------------------------------------


def extract_segments(rows: DataFrame, flag: str = "pred") -> DataFrame:
    """Half-open runs of flagged points."""
    island = F.col("t") - F.row_number().over(in_order())
    runs = rows.where(F.col(flag) == 1).withColumn("island", island)
    return runs.groupBy("series_id", "island").agg(F.min("t").alias("seg_start"), (F.max("t") + 1).alias("seg_end")).drop("island")


def drop_short(segments: DataFrame, least: int) -> DataFrame:
    return segments.where(F.col("seg_end") - F.col("seg_start") >= least)


def merge_close(segments: DataFrame, gap: int) -> DataFrame:
    """Segments joined where the next begins at most ``gap`` after the last end."""
    order = by_series().orderBy("seg_start")
    opens = F.when(F.col("seg_start") - F.lag("seg_end").over(order) <= gap, 0).otherwise(1)
    group = segments.withColumn("o", opens).withColumn("g", F.sum("o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return group.groupBy("series_id", "g").agg(F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end")).drop("g")


def postprocess(scores: DataFrame, thresholds: DataFrame, least: int = 1, gap: int = 0) -> DataFrame:
    """Segments of the thresholded scores: short ones dropped first, close ones merged then."""
    segments = extract_segments(predict(scores, thresholds))
    if least > 1:
        segments = drop_short(segments, least)
    return merge_close(segments, gap) if gap > 0 else segments


def segments_to_labels(segments: DataFrame, points: DataFrame) -> DataFrame:
    return ranges_to_scores(segments, points).select("series_id", "t", F.col("score").cast("int").alias("pred"))
