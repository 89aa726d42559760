"""Detection pipelines: fit on a training part, predict on points, from components or from a configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import evidence as E
from tideline.operators import forecast as C
from tideline.operators import metrics as M
from tideline.operators import scoring as S
from tideline.operators import windows as W
from tideline.operators.neighbours import knn_scores
from tideline.reasoning.backends import Backend, create_backend
from tideline.reasoning.scoring import range_reasoning, window_reasoning
from tideline.sources.series import series_lengths
from tideline.sources.tables import settle


# Names that configurations use.
PROCESSING = {"RawWindowProcessor": "raw", "STLProcessor": "stl", "FoundationModelProcessor": "foundation"}
DETECTION = {"DistanceBasedDetection": "knn", "EvidenceBasedDetection": "evidence"}
SCORING = {"MaxPoolingScoring": "max", "AveragePoolingScoring": "average", "WeightedAverageScoring": "gaussian", "GaussianSmoothingScoring": "smooth", "LLMReasoningScoring": "llm", "LLMRangeDetectionScoring": "range"}
THRESHOLDS = {"PercentileThreshold": "percentile", "FixedThreshold": "fixed", "F1OptimalThreshold": "f1", "StatisticalThreshold": "deviation"}
CATEGORIES = ("statistical_tests", "distribution_based", "pattern_based")
Step = Callable[..., DataFrame]


@dataclass
class Result:
    """Lazy results of a prediction."""

    window_scores: DataFrame
    point_scores: DataFrame
    thresholds: DataFrame
    segments: DataFrame
    predictions: DataFrame
    evidence: DataFrame | None = None


@dataclass
class Pipeline:
    """Processing, detection, scoring and post-processing of many series at once.

    ``processing``: ``raw``, ``stl`` or ``foundation``; ``detection``: ``knn`` or
    ``evidence``; ``scoring``: ``max``, ``average``, ``gaussian``, ``smooth``,
    ``llm`` or ``range``; ``threshold``: ``percentile``, ``fixed``, ``f1`` or
    ``deviation``. Instead of a name, each may be a function of one's own:
    processing ``(points, pipeline) -> points``, detection ``(points, train,
    pipeline) -> window scores``, scoring ``(window scores, points, pipeline) ->
    point scores``, threshold ``(labelled point scores) -> thresholds``.
    """

    width: int = 100
    step: int = 1
    processing: str | Step = "raw"
    detection: str | Step = "knn"
    scoring: str | Step = "max"
    threshold: str | Step = "percentile"
    k: int = 5
    percentile: float = 95.0
    fixed: float = 0.5
    least: int = 1
    gap: int = 0
    categories: tuple[str, ...] = CATEGORIES
    weights: dict[str, float] | None = None
    #: Seasonal decomposition; without a period each series' own is detected.
    period: int | None = None
    seasonal: int = 7
    trend: int | None = None
    robust: bool = True
    #: Steps that a forecast reaches (all of a window if None), and sampled paths per forecast.
    horizon: int | None = None
    samples: int = 50
    #: Models of foundation processing, by name, and how they are combined.
    models: tuple[str, ...] = ("naive",)
    strategy: str = "average"
    forecasters: dict[str, C.Forecaster] = field(default_factory=dict)
    #: Reasoning: back-end, windows per call, percentile of windows that are asked about, ranges per series.
    backend: dict[str, Any] | Backend = field(default_factory=dict)
    batch: int = 10
    temperature: float = 0.0
    asked_from: float = 80.0
    range_share: float = 0.01
    least_ranges: int = 3
    hints: bool = True
    deseasonalized: bool = True
    model: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, known in (("processing", PROCESSING), ("detection", DETECTION), ("scoring", SCORING), ("threshold", THRESHOLDS)):
            if not callable(getattr(self, name)) and getattr(self, name) not in known.values():
                raise ValueError(f"unknown {name}: {getattr(self, name)}")
        if unknown := set(self.categories) - set(CATEGORIES) - {"forecast_based"}:
            raise ValueError(f"unknown categories: {sorted(unknown)}")

    def _forecasters(self) -> dict[str, C.Forecaster]:
        own = {"naive": C.Naive(), "seasonal": C.SeasonalNaive(self.period or max(2, self.width // 4)), "drift": C.Drift()} | self.forecasters
        if missing := [m for m in self.models if m not in own]:
            raise ValueError(f"no forecaster for {missing}; pass one in forecasters")
        return {m: own[m] for m in self.models}

    def fit(self, train: DataFrame) -> Pipeline:
        """Per-series figures, training windows and metric baselines, as tables for the predictions."""
        if callable(self.processing):
            train = self.processing(train, self)
        train = settle(train, "train")
        self.model |= {"train": train}
        if self.processing == "foundation" and self.detection == "evidence" and "forecast_based" in self.categories:
            self._forecasters()
        if self.processing == "stl":
            periods = series_lengths(train).withColumn("period", F.lit(self.period)) if self.period else C.detect_period(train)
            periods = settle(periods.select("series_id", C.guard_period(F.col("period"), F.col("n"), self.width).alias("period")), "periods")
            line, season, residuals = (settle(x, "model") for x in C.fit_stl(train, periods, self.seasonal, self.robust, self.trend))
            shares = residuals.groupBy("series_id").agg(*[F.percentile("e", q).alias(n) for n, q in (("p01", 0.01), ("p10", 0.10), ("p90", 0.90), ("p99", 0.99))])
            self.model |= {"periods": periods, "line": line, "season": season, "residuals": residuals, "shares": settle(shares, "shares")}
        stats = settle(W.train_stats(train, self.width, self.step), "stats")
        scaled = settle(W.standardize(train, stats), "scaled")
        self.model |= {"stats": stats, "scaled": scaled, "unit": stats.select("series_id", F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"))}
        if self.detection == "knn":
            self.model["scaler"] = W.fit_scaler(train, self.width, self.step)
            self.model["windows"] = settle(W.create_windows(W.scale(train, self.model["scaler"]), self.width, self.step), "windows")
        elif self.detection == "evidence":
            found = settle(self._evidence(scaled, train), "evidence")
            self.model["baselines"] = E.baselines(found, [m for m in ("max_abs_z_score", "max_cusum", "volatility_ratio", "normalized_wasserstein") if m in found.columns])
        return self

    def _forecast_evidence(self, scaled: DataFrame, raw: DataFrame) -> list[DataFrame]:
        """Errors, quantile violations and surprise against what the training model, or the forecasters, expect."""
        reach = min(self.horizon or self.width, self.width)
        if self.processing == "stl":
            rows = settle(C.expected(raw, self.model["line"], self.model["season"], self.model["periods"]), "expected")
            # A point is expected alike by all windows that hold it, so its surprise is found once.
            told = E.surprise_of(rows, C.bootstrap_samples(rows.select("series_id", "t", "f"), self.model["residuals"], self.samples), ["series_id", "t"])
            banded = rows.join(self.model["shares"], "series_id").withColumns({p: F.col("f") + F.col(p) for p in ("p01", "p10", "p90", "p99")})
            pairs = W.window_points(banded.join(told, ["series_id", "t"], "left"), self.width, self.step).where(F.col("pos") < reach)
            return [E.forecast_errors(pairs), E.quantile_violations(pairs), E.window_surprise(pairs)]
        windows, contexts = W.window_points(scaled, self.width, self.step), W.create_windows(scaled, self.width, self.step)
        if self.processing != "foundation":
            return [E.forecast_errors(C.align_forecasts(windows, C.naive_window_forecast(contexts, reach, "naive"), self.width, self.step, "inside"))]
        # Forecasts are of the window that begins where their context ends, where windows fall so.
        mode = "inside" if self.width % self.step else "ahead"
        paths = [C.forecast_paths(contexts, m, reach, name) for name, m in self._forecasters().items() if self.strategy in ("average", name)]
        paths = settle(reduce(DataFrame.unionByName, paths), "paths")
        each = paths.groupBy("series_id", "win", F.col("pos").alias("step"), "model").agg(F.median("v").alias("f"), *[F.percentile("v", q).alias(n) for n, q in (("p01", 0.01), ("p10", 0.10), ("p90", 0.90), ("p99", 0.99))])
        joint = each.groupBy("series_id", "win", "step").agg(*[F.avg(c).alias(c) for c in ("f", "p01", "p10", "p90", "p99")])
        pairs = settle(C.align_forecasts(windows, joint, self.width, self.step, mode), "pairs")
        sampled = C.align_forecasts(windows.select("series_id", "win", "pos"), paths.select("series_id", "win", F.col("pos").alias("step"), "v"), self.width, self.step, mode)
        return [E.forecast_errors(pairs), E.quantile_violations(pairs), E.surprise(pairs, sampled)]

    def _evidence(self, scaled: DataFrame, raw: DataFrame) -> DataFrame:
        windows, unit, train = W.window_points(scaled, self.width, self.step), self.model["unit"], self.model["scaled"]
        parts = self._forecast_evidence(scaled, raw) if "forecast_based" in self.categories else []
        if "statistical_tests" in self.categories:
            parts += [E.z_scores(windows, unit), E.grubbs(windows, self.width), E.cusum(windows, unit)]
        if "distribution_based" in self.categories:
            parts += [E.kl_divergence(windows, train), E.wasserstein(windows, train)]
        if "pattern_based" in self.categories and self.width >= 5:
            parts += [E.acf_break(windows, train, self.width), E.volatility(windows, unit), E.trend_break(windows, self.width)]
        return E.gather(parts)

    def _point_scores(self, points: DataFrame, scores: DataFrame, evidence: DataFrame | None) -> DataFrame:
        pool = {"max": S.pool_max, "average": S.pool_average, "gaussian": S.pool_gaussian}
        if callable(self.scoring):
            return self.scoring(scores, points, self)
        if self.scoring in pool:
            return pool[self.scoring](scores, points, self.width, self.step)
        if self.scoring == "smooth":
            return S.smooth_gaussian(S.pool_average(scores, points, self.width, self.step))
        backend = create_backend(**(self.backend or {"kind": "rule"})) if isinstance(self.backend, dict) else self.backend
        if self.scoring == "llm":
            known = evidence if evidence is not None else scores.select("series_id", "win")
            return window_reasoning(points, scores, known, backend, self.width, self.step, self.asked_from, self.batch, self.temperature)
        series = points
        if self.processing == "stl" and self.deseasonalized:
            parts = C.stl_decompose(points, self.model["periods"], self.seasonal, self.robust, self.trend)
            series = settle(parts.select("series_id", "t", F.col("resid").alias("x")), "residuals")
        return range_reasoning(series, scores if self.hints else None, backend, self.width, self.step, self.range_share, self.least_ranges, self.temperature)

    def predict(self, points: DataFrame) -> Result:
        """Scores and segments; the ``f1`` threshold is tuned on the labels of ``points``."""
        if not self.model:
            raise ValueError("fit the pipeline first")
        points = settle(self.processing(points, self) if callable(self.processing) else points, "points")
        evidence = None
        if callable(self.detection):
            scores = self.detection(points, self.model["train"], self)
        elif self.detection == "knn":
            windows = W.create_windows(W.scale(points, self.model["scaler"]), self.width, self.step)
            scores = knn_scores(windows, self.model["windows"], self.k).select("series_id", "win", "score")
        else:
            evidence = settle(self._evidence(settle(W.standardize(points, self.model["stats"]), "scaled"), points), "evidence")
            scores = E.evidence_score(evidence, self.model["baselines"], self.weights)
        scores = settle(scores, "window-scores")
        point_scores = settle(self._point_scores(points, scores, evidence), "point-scores")
        labelled = point_scores.join(points.select("series_id", "t", "y"), ["series_id", "t"])
        thresholds = self.threshold(labelled) if callable(self.threshold) else {
            "percentile": lambda: S.percentile_threshold(point_scores, self.percentile), "fixed": lambda: S.fixed_threshold(point_scores, self.fixed),
            "f1": lambda: S.f1_threshold(labelled), "deviation": lambda: S.deviation_threshold(point_scores),
        }[self.threshold]()
        thresholds = settle(thresholds, "thresholds")
        segments = settle(S.postprocess(point_scores, thresholds, self.least, self.gap), "segments")
        flagged = S.segments_to_labels(segments, points)
        predictions = settle(labelled.join(flagged, ["series_id", "t"]), "predictions")
        return Result(scores, point_scores, thresholds, segments, predictions, evidence)

    def evaluate(self, result: Result) -> DataFrame:
        return M.evaluate(result.predictions)


def load_config(path: str) -> dict[str, Any]:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


# Parameters that configurations use, by the component they belong to, and the fields that they set.
OPTIONS = {
    "raw": {}, "stl": {"forecast_horizon": "horizon", "num_synthetic_samples": "samples", "period": "period", "robust": "robust", "seasonal": "seasonal", "trend": "trend"},
    "foundation": {"ensemble_strategy": "strategy", "forecast_horizon": "horizon", "models": "models", "num_samples": "samples"},
    "knn": {"k": "k"}, "evidence": {"enabled_categories": "categories", "weights": "weights"},
    "max": {}, "average": {}, "gaussian": {}, "smooth": {},
    "llm": {"batch_size": "batch", "pre_filter_percentile": "asked_from", "temperature": "temperature"},
    "range": {"max_anomaly_ratio": "range_share", "min_anomalies": "least_ranges", "temperature": "temperature", "use_deseasonalized": "deseasonalized", "use_evidence_hints": "hints"},
    "percentile": {"percentile": "percentile"}, "fixed": {"threshold": "fixed"}, "f1": {}, "deviation": {},
}


def build_pipeline(config: dict[str, Any], forecasters: dict[str, C.Forecaster] | None = None, backend: dict[str, Any] | Backend | None = None) -> Pipeline:
    """A pipeline from a configuration with the sections data_processing, detection, scoring, postprocessing.

    Every parameter is honoured or refused. The type of a back-end is kept in
    ``backend``, unless one is given, and needs its endpoint when it is first
    used; names of checkpoints (``chronos_model`` and the like) choose among
    weights that ``forecasters`` holds already, so they are not read.
    """
    fields: dict[str, Any] = {"forecasters": forecasters or {}}

    def named(table: dict[str, str], section: dict[str, Any]) -> str:
        if section["type"] not in table:
            raise ValueError(f"Unknown type: {section['type']}")
        kind = table[section["type"]]
        for option, value in (section.get("params") or {}).items():
            if option in OPTIONS[kind]:
                if value is not None:
                    fields[OPTIONS[kind][option]] = tuple(value) if isinstance(value, list) else value
            elif option == "backend_type" and kind in ("llm", "range"):
                fields["backend"] = {"kind": value}
            elif not (option == "method" and value == "knn" and kind == "knn") and not (kind == "foundation" and option.endswith("_model")):
                raise ValueError(f"{section['type']} has no parameter {option}={value}")
        return kind

    data, post = config["data_processing"], config["postprocessing"]
    fields |= {"width": data.get("window_size", 100), "step": data.get("stride", 1), "least": post.get("min_anomaly_length", 1), "gap": post.get("merge_gap", 0)}
    steps = {"processing": named(PROCESSING, data), "detection": named(DETECTION, config["detection"]), "scoring": named(SCORING, config["scoring"])}
    steps["threshold"] = named(THRESHOLDS, post.get("threshold") or {"type": "PercentileThreshold"})
    if steps["detection"] == "evidence" and not fields.get("categories"):
        fields["categories"] = ("forecast_based", *CATEGORIES)
    return Pipeline(**steps, **(fields | ({"backend": backend} if backend is not None else {})))


def train_and_test(points: DataFrame, share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """The first part of each series, and the rest with positions counted from 0."""
    sized = points.join(series_lengths(points), "series_id").withColumn("cut", F.floor(F.col("n") * share).cast("int"))
    train = sized.where("t < cut").select(*points.columns)
    test = sized.where("t >= cut").withColumn("t", F.col("t") - F.col("cut")).select(*points.columns)
    return train, test
