"""Statistical evidence about windows.

Inputs are window rows (``series_id, win, pos, x``) and per-series training
figures; each metric is an aggregate by ``(series_id, win)``. Short windows
give nulls where a metric needs more points.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.stats import grubbs_critical

KEY = ["series_id", "win"]


def by_window():
    return Window.partitionBy(*KEY)


# --- against a forecast -------------------------------------------------------


def forecast_errors(pairs: DataFrame) -> DataFrame:
    """``mae``, ``mse``, ``mape`` of rows with actual ``x`` and forecast ``f``."""
    e = F.col("x") - F.col("f")
    return pairs.groupBy(*KEY).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), (100 * F.avg(F.abs(e / (F.abs("x") + 1e-10)))).alias("mape"))


def quantile_violations(pairs: DataFrame) -> DataFrame:
    """Shares of values outside the bands ``p10``-``p90`` and ``p01``-``p99``."""
    out = F.when(F.col("x") < F.col("p10"), 1).when(F.col("x") > F.col("p90"), 1).otherwise(0)
    far = F.when(F.col("x") < F.col("p01"), 1).when(F.col("x") > F.col("p99"), 1).otherwise(0)
    return pairs.groupBy(*KEY).agg(F.avg(out).alias("violation_ratio"), F.avg(far).alias("extreme_violation_ratio"), (F.max(far) > 0).alias("extreme_violation"))


def surprise_of(pairs: DataFrame, samples: DataFrame, key: list[str]) -> DataFrame:
    """``surprise`` of each actual value among the forecast samples ``v`` of its key."""
    each = pairs.join(samples, key).groupBy(*key).agg(F.avg((F.col("v") <= F.col("x")).cast("int")).alias("rank"), F.stddev_pop("v").alias("sd"))
    return each.select(*key, F.when(F.col("sd") < 1e-10, 0.0).otherwise(-F.ln(1 - 2 * F.abs(F.col("rank") - 0.5) + 1e-10)).alias("surprise"))


def window_surprise(rows: DataFrame) -> DataFrame:
    """Mean and greatest ``surprise`` of a window's rows."""
    return rows.groupBy(*KEY).agg(F.avg("surprise").alias("mean_surprise"), F.max("surprise").alias("max_surprise"))


def surprise(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean and greatest surprise of actual values among forecast samples (``series_id, win, pos, v``)."""
    return window_surprise(surprise_of(pairs, samples, [*KEY, "pos"]))


# --- tests --------------------------------------------------------------------


def z_scores(windows: DataFrame, stats: DataFrame, bound: float = 3.0) -> DataFrame:
    z = F.abs(F.col("x") - F.col("mean")) / F.greatest("std", F.lit(1e-10))
    rows = windows.join(stats.select("series_id", "mean", "std"), "series_id").withColumn("z", z)
    far = F.count_if(F.col("z") > bound)
    return rows.groupBy(*KEY).agg(F.max("z").alias("max_abs_z_score"), F.avg("z").alias("mean_abs_z_score"), far.alias("extreme_z_count"), (far / F.count("z")).alias("extreme_z_ratio"))


def grubbs(windows: DataFrame, width: int, alpha: float = 0.05) -> DataFrame:
    """Grubbs' outlier test; the critical value is a constant of the window width."""
    mean, sd = F.avg("x").over(by_window()), F.stddev_samp("x").over(by_window())
    rows = windows.withColumns({"sd": sd, "dev": F.abs(F.col("x") - mean)})
    g = rows.groupBy(*KEY).agg(F.max("sd").alias("sd"), F.max(F.struct(F.col("dev"), (-F.col("pos")).alias("at"))).alias("top"), F.count("x").alias("n"))
    flat = F.col("sd") < 1e-10
    critical = F.lit(grubbs_critical(width, alpha))
    value = F.when(flat, 0.0).otherwise(F.col("top.dev") / F.col("sd"))
    return g.where("n >= 3").select(*KEY, value.alias("grubbs_statistic"), F.when(flat, 0.0).otherwise(critical).alias("grubbs_critical"), (~flat & (value > critical)).alias("grubbs_is_outlier"), F.when(flat, -1).otherwise(-F.col("top.at")).cast("int").alias("grubbs_outlier_index"))


def cusum_paths(rows: DataFrame, mean: Column, std: Column, slack: float, key: list[str], order: str) -> DataFrame:
    """Both one-sided CUSUM paths ``up`` and ``down``, the first value left out.

    The recursion max(0, S + step) is the prefix sum less its running minimum.
    """
    ordered = Window.partitionBy(*key).orderBy(order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(ordered) == 1
    d = F.col("x") - mean
    steps = rows.withColumns({"su": F.when(first, 0.0).otherwise(d - slack * std), "sd": F.when(first, 0.0).otherwise(-d - slack * std)})
    sums = steps.withColumns({"pu": F.sum("su").over(so_far), "pd": F.sum("sd").over(so_far)})
    return sums.withColumns({"up": F.col("pu") - F.min("pu").over(so_far), "down": F.col("pd") - F.min("pd").over(so_far)}).drop("su", "sd", "pu", "pd")


def cusum(windows: DataFrame, stats: DataFrame, slack: float = 0.5, threshold: float = 5.0) -> DataFrame:
    rows = windows.join(stats.select("series_id", "mean", F.greatest("std", F.lit(1e-10)).alias("std")), "series_id")
    paths = cusum_paths(rows, F.col("mean"), F.col("std"), slack, KEY, "pos")
    top = F.greatest("up", "down")
    over = F.count_if(F.col("up") > threshold * F.col("std")) + F.count_if(F.col("down") > threshold * F.col("std"))
    return paths.groupBy(*KEY).agg(F.max(top).alias("max_cusum"), (over > 0).alias("cusum_has_change_point"), over.alias("cusum_change_point_count"))


# --- distribution -------------------------------------------------------------


#: Parts by value that a series is sorted in.
VALUE_PARTS = 64


def by_value(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Rows with ``part``: which of the training values' quantile ranges ``x`` lies in, so that a series is sorted in parts."""
    shares = F.array(*[F.lit(i / VALUE_PARTS) for i in range(1, VALUE_PARTS)])
    splits = train.groupBy("series_id").agg(F.percentile_approx("x", shares, 1000).alias("splits"))
    return rows.join(splits, "series_id").withColumn("part", F.size(F.filter("splits", lambda s: s < F.col("x")))).drop("splits")


def _before(train: DataFrame) -> DataFrame:
    """Per series and part, how many training values the parts before it hold, and their sum; ``train`` has its parts."""
    each = train.groupBy("series_id", "part").agg(F.count("x").alias("c"), F.sum("x").alias("s"))
    spine = each.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(0), F.lit(VALUE_PARTS - 1))).alias("part"))
    ahead = Window.partitionBy("series_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full = spine.join(each, ["series_id", "part"], "left")
    return full.select("series_id", "part", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("k0"), F.coalesce(F.sum("s").over(ahead), F.lit(0.0)).alias("s0"))


def ranked(train: DataFrame) -> DataFrame:
    """Training values with ``k``, their rank from 1 in the series."""
    parts = by_value(train.select("series_id", "x"), train)
    rank = F.row_number().over(Window.partitionBy("series_id", "part").orderBy("x"))
    return parts.withColumn("r", rank).join(_before(parts), ["series_id", "part"]).select("series_id", "x", (F.col("r") + F.col("k0")).cast("long").alias("k"))


def counted(train: DataFrame, asked: DataFrame, strict: bool) -> DataFrame:
    """``asked`` with ``k`` and ``s``: count and sum of the training values up to ``x`` (below it, if ``strict``)."""
    parts = by_value(train.select("series_id", "x"), train)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in asked.schema.fields if f.name not in ("series_id", "x")]
    rows = parts.select("series_id", "part", "x", *blank, F.lit(0).alias("kind")).unionByName(by_value(asked, train).withColumn("kind", F.lit(-1 if strict else 1)))
    so_far = Window.partitionBy("series_id", "part").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("kind") == 0
    sums = rows.withColumns({"k1": F.count_if(own).over(so_far), "s1": F.sum(F.when(own, F.col("x")).otherwise(0.0)).over(so_far)}).where("kind <> 0").join(_before(parts), ["series_id", "part"])
    return sums.select(*asked.columns, (F.col("k1") + F.col("k0")).alias("k"), (F.col("s1") + F.col("s0")).alias("s"))


def kl_divergence(windows: DataFrame, train: DataFrame, bins: int = 20) -> DataFrame:
    """KL of the training values from each window's, over equal bins of their joint range."""
    spans = windows.groupBy(*KEY).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("x").alias("n")).where("n >= 2")
    own = train.groupBy("series_id").agg(F.min("x").alias("ta"), F.max("x").alias("tb"), F.count("x").alias("tn"))
    edges = spans.join(own, "series_id").select(*KEY, "n", "tn", (F.least("a", "ta") - 1e-10).alias("lo"), (F.greatest("b", "tb") + 1e-10).alias("hi"))
    bin_of = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    test = windows.join(edges, KEY).groupBy(*KEY, bin_of).agg(F.count("x").alias("c"))
    # Training values below the edges of each distinct range (most windows share the training range), by one sorted pass.
    ranges = edges.select("series_id", "lo", "hi", "tn").distinct()
    inner = ranges.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins)
    below = counted(train, inner, True).select("series_id", "lo", "hi", "bin", "k")
    ends = ranges.select("series_id", "lo", "hi", F.lit(0).alias("bin"), F.lit(0).cast("long").alias("k")).unionByName(ranges.select("series_id", "lo", "hi", F.lit(bins).alias("bin"), F.col("tn").alias("k")))
    order = Window.partitionBy("series_id", "lo", "hi").orderBy("bin")
    trained = below.unionByName(ends).withColumn("tc", F.lead("k").over(order) - F.col("k")).where(F.col("bin") < bins).drop("k")
    spine = edges.select(*KEY, "n", "tn", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    joined = spine.join(test, [*KEY, "bin"], "left").join(trained, ["series_id", "lo", "hi", "bin"], "left")
    width = (F.col("hi") - F.col("lo")) / bins
    density = joined.select(*KEY, (F.coalesce("c", F.lit(0)) / F.col("n") / width + 1e-10).alias("q"), (F.coalesce("tc", F.lit(0)) / F.col("tn") / width + 1e-10).alias("p"))
    # sum P ln(P / Q) with P = p / sum p and Q = q / sum q
    sums = density.groupBy(*KEY).agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("s"))
    return sums.select(*KEY, (F.col("s") / F.col("sp") - F.ln(F.col("sp") / F.col("sq"))).alias("kl_divergence"))


def wasserstein(windows: DataFrame, train: DataFrame) -> DataFrame:
    """Wasserstein-1 distance of each window from the training values, and over their deviation.

    The distance is the integral of |F - G|. Between neighbouring values of a
    window F is a constant c, and G passes c at one training quantile, so each
    gap follows from I, the running integral of G, at its ends and at that
    quantile. I(v) needs only how many training values are at most v and their
    sum, which :func:`counted` gives by sorting; windows are never multiplied
    with training values.
    """
    own = train.groupBy("series_id").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.stddev_pop("x").alias("sd"))
    sized = windows.groupBy(*KEY).agg(F.count("x").cast("int").alias("m")).where("m >= 2")
    sizes = sized.select("series_id", "m").distinct().join(own.select("series_id", "n"), "series_id")
    levels = sizes.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).withColumn("k", F.ceil(F.col("i") * F.col("n") / F.col("m")))
    quantiles = levels.join(ranked(train), ["series_id", "k"]).select("series_id", F.lit(None).cast("int").alias("win"), F.col("i").alias("pos"), "m", "x")
    asked = windows.join(sized, KEY).select(*KEY, "pos", "m", "x").unionByName(quantiles)
    known = counted(train, asked, False).join(own, "series_id")
    known = known.withColumn("integral", (F.col("x") * F.col("k") - F.col("s")) / F.col("n"))
    at = known.where("win is null").select("series_id", "m", F.col("pos").alias("i"), F.col("x").alias("q"), F.col("integral").alias("iq"))

    order = by_window().orderBy("x", "pos")
    values = known.where("win is not null").withColumns({"i": F.row_number().over(order), "b": F.lead("x").over(order), "ib": F.lead("integral").over(order)})
    gaps = values.join(at, ["series_id", "m", "i"], "left")
    c = F.col("i") / F.col("m")
    cross = F.greatest("x", F.least("b", "q"))
    middle = F.when(F.col("q") <= F.col("x"), F.col("integral")).when(F.col("q") >= F.col("b"), F.col("ib")).otherwise(F.col("iq"))
    inside = c * (2 * cross - F.col("x") - F.col("b")) + F.col("integral") + F.col("ib") - 2 * middle
    before = F.when(F.col("i") == 1, F.col("integral")).otherwise(0.0)
    beyond = ((F.col("total") - F.col("s")) - F.col("x") * (F.col("n") - F.col("k"))) / F.col("n")
    part = before + F.when(F.col("i") == F.col("m"), beyond).otherwise(inside)
    total = gaps.groupBy(*KEY).agg(F.sum(part).alias("d"), F.first("sd").alias("sd"))
    return total.select(*KEY, F.greatest("d", F.lit(0.0)).alias("wasserstein_distance"), (F.greatest("d", F.lit(0.0)) / F.greatest("sd", F.lit(1e-10))).alias("normalized_wasserstein"))


# --- pattern ------------------------------------------------------------------


#: Lags up to which they are columns of one sorted pass; beyond, stretches of a series are correlated as arrays.
LAG_COLUMNS = 32
#: Points of such a stretch.
STRETCH = 4096


def _lagged_products(rows: DataFrame, key: list[str], lags: int) -> DataFrame:
    """Key, ``lag`` and the sum ``s`` of products of ``d`` with its value that many places later."""
    if lags <= LAG_COLUMNS:
        order = Window.partitionBy(*key).orderBy("i")
        shifted = rows.withColumns({f"d{k}": F.lag("d", k).over(order) for k in range(1, lags + 1)})
        sums = shifted.groupBy(*key).agg(*[F.sum(F.col("d") * F.col(f"d{k}" if k else "d")).alias(f"s{k}") for k in range(lags + 1)])
        told = F.posexplode(F.array(*[F.col(f"s{k}") for k in range(lags + 1)])).alias("lag", "s")
        return sums.select(*key, told).where("s is not null")
    size = max(STRETCH, lags)
    own = rows.withColumn("stretch", F.floor(F.col("i") / size)).withColumn("place", F.col("i") % size)
    # The first points of a stretch are also what comes after the stretch before it.
    ahead = own.where(F.col("place") < lags).withColumns({"stretch": F.col("stretch") - 1, "place": F.col("place") + size})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        d = np.zeros(size + lags)
        d[part["place"].to_numpy()] = part["d"].to_numpy()
        out = pd.DataFrame({"lag": np.arange(lags + 1), "s": np.correlate(d, d[:size], "valid")})
        for c in key:
            out[c] = part[c].iloc[0]
        return out

    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key], "lag int, s double"])
    parts = own.unionByName(ahead).groupBy(*key, "stretch").applyInPandas(run, schema)
    longest = rows.groupBy(*key).agg(F.max("i").alias("last"))
    return parts.groupBy(*key, "lag").agg(F.sum("s").alias("s")).join(longest, key).where(F.col("lag") <= F.col("last")).drop("last")


def autocorrelation(rows: DataFrame, key: list[str], order: str, lags: int) -> DataFrame:
    """Biased autocorrelation at lags 0 .. ``lags``: key, ``lag``, ``acf``. Positions count from 0 without gaps."""
    mean = F.avg("x").over(Window.partitionBy(*key))
    centred = rows.select(*key, F.col(order).alias("i"), (F.col("x") - mean).alias("d"))
    sums = _lagged_products(centred, key, lags)
    zero = sums.where("lag = 0").select(*key, F.col("s").alias("s0"))
    return sums.join(zero, key).select(*key, "lag", (F.col("s") / F.when(F.col("s0") != 0, F.col("s0"))).alias("acf"))


def acf_break(windows: DataFrame, train: DataFrame, width: int, lags: int = 20) -> DataFrame:
    """How the autocorrelation of a window departs from the training series'; the period is the lag of the peak."""
    lags = min(lags, width - 1)
    own = autocorrelation(train, ["series_id"], "t", lags).select("series_id", "lag", F.col("acf").alias("a"))
    test = autocorrelation(windows, KEY, "pos", lags).select(*KEY, "lag", F.col("acf").alias("b"))
    both = test.join(own, ["series_id", "lag"])
    peak = lambda c: F.max(F.when(F.col("lag") >= 1, F.struct(F.col(c), (-F.col("lag")).alias("l"))))["l"]
    d = F.abs(F.col("a") - F.col("b"))
    return both.groupBy(*KEY).agg(F.max(d).alias("max_acf_diff"), F.avg(d).alias("mean_acf_diff"), (peak("a") != peak("b")).alias("period_changed"))


def volatility(windows: DataFrame, stats: DataFrame, width: int = 10) -> DataFrame:
    """Deviation against the training deviation, and the greatest trailing deviation."""
    trailing = by_window().orderBy("pos").rowsBetween(-(width - 1), 0)
    rows = windows.withColumn("r", F.stddev_pop("x").over(trailing))
    ratio = F.col("sd") / F.greatest("std", F.lit(1e-10))
    out = rows.groupBy(*KEY).agg(F.stddev_pop("x").alias("sd"), F.max("r").alias("max_rolling_std")).join(stats.select("series_id", "std"), "series_id")
    return out.select(*KEY, ratio.alias("volatility_ratio"), (ratio > 2).alias("high_volatility"), (ratio > 5).alias("extreme_volatility"), "max_rolling_std")


def trend_break(windows: DataFrame, width: int) -> DataFrame:
    """Least-squares lines of both halves of a window compared."""
    half = width // 2
    first, second = F.col("pos") < half, F.col("pos") >= half
    y1, y2 = F.when(first, F.col("x")), F.when(second, F.col("x"))
    g = windows.groupBy(*KEY).agg(
        F.regr_slope(y1, F.col("pos")).alias("slope_before"), F.regr_slope(y2, F.col("pos")).alias("slope_after"), F.regr_intercept(y1, F.col("pos")).alias("b1"),
        F.regr_intercept(y2, F.col("pos")).alias("b2"), (F.max("x") - F.min("x")).alias("range"), F.count("x").alias("n"),
    )
    slope = F.abs(F.col("slope_after") - F.col("slope_before"))
    bound = F.when(F.col("range") > 0, 0.1 * F.col("range") / F.col("n")).otherwise(0.01)
    return g.select(*KEY, "slope_before", "slope_after", slope.alias("slope_diff"), F.abs(F.col("b2") - F.col("b1")).alias("level_diff"), (slope > bound).alias("trend_break"))


def shape(windows: DataFrame) -> DataFrame:
    """Skewness and excess kurtosis of each window; null for a constant one."""
    finite = lambda c: F.when(F.isnan(c), None).otherwise(c)
    g = windows.groupBy(*KEY).agg(F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis"))
    return g.select(*KEY, *[finite(F.col(c)).alias(c) for c in ("skewness", "kurtosis")])


# --- together -----------------------------------------------------------------

# Weights of the score; they sum to 1.
WEIGHTS = {
    "mae": 0.10, "mse": 0.10, "mape": 0.05, "violation_ratio": 0.08, "mean_surprise": 0.07, "max_abs_z_score": 0.10, "grubbs_statistic": 0.08, "max_cusum": 0.07,
    "kl_divergence": 0.08, "normalized_wasserstein": 0.07, "max_acf_diff": 0.05, "volatility_ratio": 0.08, "slope_diff": 0.07,
}


def baselines(evidence: DataFrame, metrics: list[str]) -> DataFrame:
    """Median, 95th percentile and maximum of metrics over training windows, per series."""
    if not metrics:
        return evidence.select("series_id").distinct()
    return evidence.groupBy("series_id").agg(*[x for m in metrics for x in (F.percentile(m, 0.5).alias(f"{m}_p50"), F.percentile(m, 0.95).alias(f"{m}_p95"), F.max(m).alias(f"{m}_max"))])


def evidence_score(evidence: DataFrame, base: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of the metrics that are present, each over its 95th percentile if it has one, cut to 0 .. 10."""
    weights = {m: w for m, w in (weights or WEIGHTS).items() if m in evidence.columns}
    joined = evidence.join(base, "series_id", "left")
    tops, bottoms = [], []
    for m, w in weights.items():
        value = F.when(F.isnan(m), None).otherwise(F.col(m))
        if f"{m}_p95" in base.columns:
            value = F.when(F.col(f"{m}_p95") > 1e-10, value / F.col(f"{m}_p95")).otherwise(value)
        value = F.least(F.lit(10.0), F.greatest(F.lit(0.0), value))
        there = F.col(m).isNotNull() & ~F.isnan(m)
        tops.append(F.when(there, w * value).otherwise(0.0))
        bottoms.append(F.when(there, w).otherwise(0.0))
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    return joined.select(*KEY, F.when(add(bottoms) > 0, add(tops) / add(bottoms)).otherwise(0.0).alias("score"))


def gather(parts: list[DataFrame]) -> DataFrame:
    """All evidence of a window in one row; what a part lacks is null."""
    return reduce(lambda a, b: a.join(b, KEY, "full"), parts)


def majority(evidence: DataFrame, flags: list[str]) -> DataFrame:
    """Whether more than half of the present boolean signs hold."""
    votes = reduce(lambda a, b: a + b, [F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags])
    present = reduce(lambda a, b: a + b, [F.col(f).isNotNull().cast("int") for f in flags])
    return evidence.select(*KEY, votes.alias("votes"), (2 * votes > present).alias("is_anomaly"))
