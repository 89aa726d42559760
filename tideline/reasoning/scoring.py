"""Point scores from model verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.scoring import cusum_gate, derived_signals, pool_average, range_cap, ranges_to_scores, refine_ranges, validate_ranges
from tideline.operators.windows import create_windows, top_windows
from tideline.reasoning.backends import Backend, ask_ranges, ask_windows
from tideline.reasoning.prompts import baseline_averages, batch_prompts, evidence_hints, range_prompts, relative_evidence, window_prompts
from tideline.reasoning.replies import confidences, parse_ranges, parse_windows, range_rows
from tideline.sources.series import series_lengths
from tideline.sources.tables import settle


def suspicious(scores: DataFrame, percentile: float = 80.0) -> DataFrame:
    """Scores with ``suspicious``: at or above the series' percentile."""
    bound = scores.groupBy("series_id").agg(F.percentile("score", percentile / 100).alias("bound"))
    return scores.join(bound, "series_id").withColumn("suspicious", F.col("score") >= F.col("bound")).drop("bound")


def contrast(marked: DataFrame, k: int = 3) -> DataFrame:
    """The k lowest-scored windows that are not suspicious."""
    return top_windows(marked.where("not suspicious"), k, ascending=True).drop("rank")


def merge_verdicts(marked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Confidence for suspicious windows; for the others their score scaled to 0 .. 0.3."""
    span = marked.groupBy("series_id").agg(F.min("score").alias("a"), F.max("score").alias("b"))
    low = F.when(F.col("b") > F.col("a"), (F.col("score") - F.col("a")) / (F.col("b") - F.col("a")) * 0.3).otherwise(0.0)
    joined = marked.join(span, "series_id").join(verdicts, ["series_id", "win"], "left")
    return joined.select("series_id", "win", F.when(F.col("suspicious"), F.coalesce("confidence", F.lit(0.0))).otherwise(low).alias("score"))


def window_reasoning(points: DataFrame, scores: DataFrame, evidence: DataFrame, backend: Backend, width: int, step: int, percentile: float = 80.0, batch: int = 10, temperature: float = 0.0) -> DataFrame:
    """Point scores: the model judges suspicious windows only, beside normal ones for contrast; then average pooling."""
    marked = settle(suspicious(scores, percentile), "marked")
    normal = evidence.join(contrast(marked).select("series_id", "win"), ["series_id", "win"], "left_semi")
    texts = relative_evidence(evidence, baseline_averages(normal))
    asked = create_windows(points, width, step).join(marked.where("suspicious").select("series_id", "win"), ["series_id", "win"], "left_semi")
    replies = settle(ask_windows(batch_prompts(window_prompts(asked, texts), batch), backend, temperature), "replies")  # each call is made once
    verdicts = confidences(asked, parse_windows(replies))
    return pool_average(merge_verdicts(marked, verdicts), points, width, step)


def range_reasoning(points: DataFrame, scores: DataFrame | None, backend: Backend, width: int, step: int, ratio: float = 0.005, least: int = 3, temperature: float = 0.0) -> DataFrame:
    """0/1 point scores: a CUSUM gate, a call per part of each series that passes, then validated and refined ranges."""
    signals = settle(derived_signals(points), "signals")
    lengths = series_lengths(points)
    passed = cusum_gate(signals).where("passes").select("series_id")
    caps = range_cap(lengths, ratio, least).join(passed, "series_id", "left_semi")
    hints = evidence_hints(scores, width, step) if scores is not None else None
    replies = settle(ask_ranges(range_prompts(signals.join(passed, "series_id", "left_semi"), caps, hints), backend, temperature), "replies")
    valid = validate_ranges(range_rows(parse_ranges(replies)), signals, lengths)
    refined = refine_ranges(valid.select("series_id", "seg_start", "seg_end"), derived_signals(points, width=100), lengths)
    return ranges_to_scores(refined, points)
