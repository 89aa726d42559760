"""Replies, back-ends and pipelines."""

import json

import pytest
from pyspark.sql import functions as F

from tideline.operators import scoring as S
from tideline.operators import windows as W
from tideline.plans.detect import Pipeline, build_pipeline
from tideline.reasoning.backends import HttpBackend, RuleBackend, ask, create_backend, generate_with_retry
from tideline.reasoning.replies import parse_ranges, parse_windows


def test_window_replies(spark):
    item = '{"window_index": 2, "is_anomaly": true, "confidence": 1.7, "reasoning": "r", "evidence_cited": ["mae"]}'
    replies = [f'{{"results": [{item}]}}', f'Sure:\n```json\n{{"results": [{item}]}}\n```', f'x {{"results": [{item}]}} y', '{"anomalies": [{"start": 1, "end": 2, "confidence": 0.7}, {"start": 5, "end": 6}]}', "", "nothing", '{"anomalies": []}', None]
    rows = parse_windows(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")).orderBy("i").collect()
    for r in rows[:3]:
        v = r.verdicts[0]
        assert (v.window_index, v.is_anomaly, v.confidence, v.evidence_cited) == (2, True, 1.0, ["mae"])
    assert (rows[3].verdicts[0].is_anomaly, rows[3].verdicts[0].confidence) == (True, 0.7)
    assert [r.parse_error for r in rows] == [False, False, False, False, True, True, False, True]
    assert not rows[6].verdicts[0].is_anomaly


def test_range_replies(spark):
    replies = ['{"anomalies":[{"start":5,"end":5},{"start":9,"end":3}]}', '[{"start": 1, "end": 4}]', "```\n[{\"start\": 2, \"end\": 3}]\n```", "no", None]
    rows = parse_ranges(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")).orderBy("i").collect()
    assert [[(x.start, x.end) for x in r.ranges] for r in rows] == [[(5, 6)], [(1, 4)], [(2, 3)], [], []]


class Flaky:
    def __init__(self, failures):
        self.failures = failures

    def generate(self, system, user, temperature):
        if self.failures:
            self.failures -= 1
            raise RuntimeError("busy")
        return "ok"


def test_retry():
    assert generate_with_retry(Flaky(2), "s", "u", wait=0) == "ok"
    with pytest.raises(RuntimeError):
        generate_with_retry(Flaky(3), "s", "u", wait=0)


def test_backends(spark):
    assert isinstance(create_backend(), RuleBackend)
    body, headers = HttpBackend("http://h", "k", "m", "anthropic").request("s", "u", 0.0)
    assert body["max_tokens"] == 4096 and headers["x-api-key"] == "k"
    assert create_backend("azure_openai", url="u", key="k", model="m").style == "openai"

    class Busy:  # local, so that it travels to the worker by value
        def generate(self, system, user, temperature):
            raise RuntimeError("busy")

    rows = ask(spark.createDataFrame([("a", "p")], "series_id string, prompt string"), Busy(), "s", attempts=1).collect()
    assert rows[0].reply is None and rows[0].error == "busy"


def test_configuration():
    config = {"data_processing": {"type": "STLProcessor", "window_size": 50, "stride": 5}, "detection": {"type": "EvidenceBasedDetection", "params": {"enabled_categories": ["statistical_tests"]}}, "scoring": {"type": "GaussianSmoothingScoring"}, "postprocessing": {"threshold": {"type": "FixedThreshold", "params": {"threshold": 0.7}}, "min_anomaly_length": 3, "merge_gap": 5}}
    p = build_pipeline(config)
    assert (p.width, p.step, p.processing, p.detection, p.scoring, p.threshold, p.fixed, p.least, p.gap, p.categories) == (50, 5, "stl", "evidence", "smooth", "fixed", 0.7, 3, 5, ("statistical_tests",))
    with pytest.raises(ValueError):
        build_pipeline(config | {"scoring": {"type": "Other"}})
    with pytest.raises(ValueError):
        build_pipeline(config | {"detection": {"type": "EvidenceBasedDetection", "params": {"unheard_of": 1}}})
    ranges = {"type": "LLMRangeDetectionScoring", "params": {"backend_type": "azure_openai", "temperature": 0.2, "max_anomaly_ratio": 0.005, "min_anomalies": 2, "use_evidence_hints": False, "use_deseasonalized": False}}
    stl = {"type": "STLProcessor", "window_size": 40, "params": {"forecast_horizon": 16, "num_synthetic_samples": 9, "seasonal": 9, "trend": 31, "robust": False, "period": None}}
    p = build_pipeline(config | {"data_processing": stl, "scoring": ranges, "detection": {"type": "EvidenceBasedDetection"}})
    assert (p.horizon, p.samples, p.seasonal, p.trend, p.robust, p.period, p.categories[0]) == (16, 9, 9, 31, False, None, "forecast_based")
    assert (p.backend, p.temperature, p.range_share, p.least_ranges, p.hints, p.deseasonalized) == ({"kind": "azure_openai"}, 0.2, 0.005, 2, False, False)
    llm = {"type": "LLMReasoningScoring", "params": {"batch_size": 4, "pre_filter_percentile": 90}}
    model = {"type": "FoundationModelProcessor", "params": {"models": ["chronos"], "chronos_model": "tiny", "num_samples": 7, "ensemble_strategy": "average"}}
    p = build_pipeline(config | {"data_processing": model, "scoring": llm})
    assert (p.batch, p.asked_from, p.models, p.samples) == (4, 90, ("chronos",), 7)
    with pytest.raises(ValueError):
        Pipeline().predict(None)
    with pytest.raises(ValueError):
        Pipeline(processing="other")


@pytest.fixture(scope="module")
def seasonal(spark):
    import numpy as np

    r = np.random.default_rng(0)
    rows = []
    for series, period in (("a", 12), ("b", 20)):
        for t in range(400):
            rows.append((series, t, float(5 * np.sin(2 * np.pi * t / period) + 0.3 * r.normal() + (6 if 300 <= t < 310 else 0)), int(300 <= t < 310)))
    points = spark.createDataFrame(rows, "series_id string, t int, x double, y int")
    return points.where("t < 240").cache(), points.where("t >= 240").withColumn("t", F.col("t") - 240).cache()


def test_forecast_evidence_of_stl(spark, seasonal):
    train, test = seasonal
    p = Pipeline(20, 5, processing="stl", detection="evidence", scoring="average", categories=("forecast_based", "statistical_tests"), samples=20).fit(train)
    assert {r.series_id: r.period for r in p.model["periods"].collect()} == {"a": 12, "b": 20}
    found = p.predict(test)
    for r in found.evidence.collect():
        inside = 41 <= r.win * 5 + 20 and r.win * 5 < 70 and max(0, min(70, r.win * 5 + 20) - max(60, r.win * 5)) >= 5
        assert 0 <= r.violation_ratio <= 1 and r.mean_surprise >= 0
        if inside:
            assert r.extreme_violation and r.mae > 1
    scores = {(r.series_id, r.win): r.score for r in found.window_scores.collect()}
    assert all(max(scores[s, w] for w in (11, 12, 13)) > max(scores[s, w] for w in (0, 1, 2, 20, 21)) for s in "ab")


def test_foundation_processing_uses_the_models(spark, seasonal):
    train, test = seasonal

    class Flat:  # local, so that it travels to the worker by value
        def forecast(self, context, horizon):
            return context[-12:][:horizon][None, :] + [[-1.0], [0.0], [1.0]]

    with pytest.raises(ValueError, match="chronos"):
        Pipeline(24, 12, processing="foundation", detection="evidence", categories=("forecast_based",), models=("chronos",)).fit(train)
    p = Pipeline(24, 12, processing="foundation", detection="evidence", categories=("forecast_based",), models=("flat",), forecasters={"flat": Flat()}, horizon=12).fit(train.where("series_id = 'a'"))
    rows = p.predict(test.where("series_id = 'a'")).evidence.orderBy("win").collect()
    # A window is judged by the forecast of the one that ends where it begins.
    assert [r.win for r in rows] == list(range(2, 12))
    assert max(rows, key=lambda r: r.mae).win in (5, 6, 7)
    assert all(r.mean_surprise is not None and r.violation_ratio is not None for r in rows)


def test_own_components(spark, seasonal):
    train, test = seasonal
    p = Pipeline(
        20, 5, processing=lambda points, _: points.withColumn("x", F.abs("x")), detection=lambda points, train, own: W.create_windows(points, own.width, own.step).select("series_id", "win", F.array_max("values").alias("score")),
        scoring=lambda scores, points, own: S.pool_max(scores, points, own.width, own.step), threshold=lambda rows: S.fixed_threshold(rows, 8.0),
    ).fit(train)
    assert p.predict(test).segments.count() > 0


def test_prompts_tell_what_is_high(spark):
    from tideline.reasoning import prompts as P

    rows = [("a", w, float(v), bool(v > 5)) for w, v in enumerate((1, 1, 1.6, 9))]
    evidence = spark.createDataFrame(rows, "series_id string, win int, mae double, trend_break boolean")
    averages = P.baseline_averages(evidence.where("win < 2"))
    texts = {r.win: json.loads(r.evidence_text) for r in P.relative_evidence(evidence, averages).collect()}
    assert [texts[w]["measures"][0]["level"] for w in range(4)] == ["usual", "usual", "raised", "high"]
    assert texts[3]["signs"] == ["trend_break"] and texts[0]["signs"] == []
    windows = spark.createDataFrame([("a", w, [1.0, 2.0]) for w in range(4)], "series_id string, win int, values array<double>")
    told = P.relative_evidence(evidence, averages)
    reply = json.loads(RuleBackend().generate("", P.batch_prompts(P.window_prompts(windows, told)).first().prompt, 0.0))
    assert [(r["window_index"], r["is_anomaly"], r["evidence_cited"]) for r in reply["results"]] == [(0, False, []), (1, False, []), (2, False, []), (3, True, ["mae"])]


def test_long_series_are_asked_about_in_parts(spark):
    from tideline.reasoning import prompts as P
    from tideline.reasoning.backends import ask_ranges

    rows = [("a", t, float(t == 30), 1.0, 8.0 if 25 <= t < 35 else 0.0, 0.0) for t in range(50)]
    signals = spark.createDataFrame(rows, "series_id string, t int, x double, std double, cusum double, rmdev double")
    caps = spark.createDataFrame([("a", 7)], "series_id string, max_ranges int")
    prompts = P.range_prompts(signals, caps, most=30)
    assert prompts.count() == 2

    class Echo:
        def generate(self, system, user, temperature):
            assert "at most 7" in system and temperature == 0.5
            return RuleBackend().generate(system, user, temperature)

    found = [[(r.start, r.end) for r in x.ranges] for x in parse_ranges(ask_ranges(prompts, Echo(), 0.5)).orderBy("part").collect()]
    assert found == [[(25, 30)], [(30, 35)]]


def test_answered_prompts_are_not_asked_again(spark, tmp_path):
    from tideline.reasoning.backends import ask_cached

    calls = str(tmp_path / "calls")

    class Counting:
        def generate(self, system, user, temperature):
            with open(calls, "a") as f:
                f.write(user + "\n")
            if user == "bad":
                raise RuntimeError("busy")
            return user.upper()

    def run(*texts):
        df = spark.createDataFrame(list(enumerate(texts)), "series_id int, prompt string")
        return [(r.prompt, r.reply, r.error) for r in ask_cached(df, Counting(), "s", str(tmp_path / "cache"), attempts=1).orderBy("series_id").collect()]

    assert run("a", "b", "a", "bad") == [("a", "A", None), ("b", "B", None), ("a", "A", None), ("bad", None, "busy")]
    assert run("b", "c", "bad") == [("b", "B", None), ("c", "C", None), ("bad", None, "busy")]
    assert sorted(open(calls).read().split()) == ["a", "b", "bad", "bad", "c"]
