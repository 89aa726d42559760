"""Operators against hand-computed and brute-force results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions.stats import grubbs_critical, student_t_quantile
from tideline.operators import evidence as E
from tideline.operators import metrics as M
from tideline.operators import scoring as S
from tideline.operators import windows as W
from tideline.operators.forecast import stl
from tideline.operators.neighbours import knn_scores, lsh_knn_scores


def points(spark, values, labels=None, series="a"):
    labels = labels or [0] * len(values)
    return spark.createDataFrame([(series, t, float(x), y) for t, (x, y) in enumerate(zip(values, labels, strict=True))], "series_id string, t int, x double, y int")


def window(spark, values):
    return spark.createDataFrame([("a", 0, i, float(x)) for i, x in enumerate(values)], "series_id string, win int, pos int, x double")


def stats(spark, mean=0.0, std=1.0):
    return spark.createDataFrame([("a", mean, std)], "series_id string, mean double, std double")


def test_windows_drop_the_tail(spark):
    w = W.create_windows(points(spark, range(107)), 20, 10).orderBy("win").collect()
    assert [r.start for r in w] == list(range(0, 81, 10))
    assert w[3].values == [float(v) for v in range(30, 50)]
    assert W.create_windows(points(spark, range(5)), 20, 10).count() == 0


def test_scaler_equals_overlapping_windows(spark):
    values = [random.Random(1).gauss(0, 1) for _ in range(57)]
    p = points(spark, values)
    flat = [x for r in W.create_windows(p, 20, 10).collect() for x in r.values]
    mean = sum(flat) / len(flat)
    got = W.fit_scaler(p, 20, 10).first()
    assert got.mean == pytest.approx(mean)
    assert got.std == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in flat) / len(flat)))
    assert W.fit_scaler(points(spark, [2.0] * 30), 20, 10).first().scale == 1.0


def test_pooling_fixture(spark):
    scores = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0)], "series_id string, win int, score double")
    p = points(spark, range(107))
    top = [r.score for r in S.pool_max(scores, p, 50, 25).orderBy("t").collect()]
    mean = [r.score for r in S.pool_average(scores, p, 50, 25).orderBy("t").collect()]
    assert (top[0], top[30], top[60], top[99], top[103]) == (1, 2, 3, 3, 0)
    assert (mean[0], mean[30], mean[60], mean[80], mean[103]) == (1, 1.5, 2.5, 3, 0)


def test_spike_and_step(spark):
    z = E.z_scores(window(spark, [0, 0, 0, 10, 0]), stats(spark)).first()
    assert (z.max_abs_z_score, z.mean_abs_z_score, z.extreme_z_count, z.extreme_z_ratio) == (10, 2, 1, 0.2)
    c = E.cusum(window(spark, [0, 0, 0, 10, 0]), stats(spark)).first()
    assert (c.max_cusum, c.cusum_change_point_count) == (9.5, 2)
    c = E.cusum(window(spark, [0] * 25 + [5] * 25), stats(spark)).first()
    assert c.max_cusum == pytest.approx(112.5) and c.cusum_change_point_count == 24


def test_forecast_pair_and_bands(spark):
    pairs = window(spark, [1, 2, 3, 4, 5]).withColumn("f", F.element_at(F.array(*[F.lit(v) for v in (1.1, 2.2, 2.8, 4.5, 4.7)]), F.col("pos") + 1))
    e = E.forecast_errors(pairs).first()
    assert (e.mae, e.mse, e.mape) == (pytest.approx(0.26), pytest.approx(0.086), pytest.approx(9.033333, abs=1e-5))
    bands = window(spark, [10, 10, 10]).withColumns({"p01": F.lit(0.5), "p10": F.lit(0.8), "p90": F.lit(1.2), "p99": F.lit(1.5)})
    v = E.quantile_violations(bands).first()
    assert (v.violation_ratio, v.extreme_violation_ratio, v.extreme_violation) == (1, 1, True)


def test_grubbs(spark):
    assert student_t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-4)
    assert grubbs_critical(10) == pytest.approx(2.290, abs=1e-3)
    r = random.Random(4)
    values = [r.gauss(0, 1) for _ in range(50)]
    values[25] = 20
    g = E.grubbs(window(spark, values), 50).first()
    assert g.grubbs_is_outlier and g.grubbs_outlier_index == 25
    flat = E.grubbs(window(spark, [1] * 10), 10).first()
    assert (flat.grubbs_statistic, flat.grubbs_outlier_index) == (0, -1)


def test_segments_and_metrics(spark):
    seg = spark.createDataFrame([("a", 0, 2), ("a", 4, 9), ("a", 11, 15)], "series_id string, seg_start int, seg_end int")
    merged = S.merge_close(S.drop_short(seg, 3), 2).collect()
    assert [(r.seg_start, r.seg_end) for r in merged] == [(4, 15)]
    y, p = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0], [0, 0, 1, 1, 0, 0, 1, 1, 1, 0]
    rows = points(spark, p, y).withColumn("pred", F.col("x").cast("int"))
    m = M.point_metrics(rows).first()
    assert (m.tp, m.fp, m.fn, m.f1) == (4, 1, 1, pytest.approx(0.8))
    assert M.segment_f1(rows).first().pa_f1 == 1.0
    none = points(spark, [0, 0]).withColumns({"pred": F.lit(0), "score": F.lit(0.0)})
    e = M.evaluate(none).first()
    assert (e.precision, e.recall, e.f1, e.pa_f1, e.pr_auc) == (1, 1, 1, 1, 1)
    flat = points(spark, [1, 1], [0, 1]).withColumn("score", F.col("x"))
    assert M.pr_area(flat).first().pr_auc == 0.5


def test_pr_area_against_loop(spark):
    r = random.Random(9)
    scores, labels = [r.random() for _ in range(200)], [int(r.random() < 0.2) for _ in range(200)]
    low, high, curve = min(scores), max(scores), []
    for k in range(200):
        at = high if k == 199 else low + k * ((high - low) / 199)
        tp = sum(s >= at and y for s, y in zip(scores, labels, strict=True))
        fp = sum(s >= at and not y for s, y in zip(scores, labels, strict=True))
        curve.append((tp / sum(labels), -k, tp / (tp + fp) if tp + fp else 1.0))
    curve.sort()
    area = sum((b[0] - a[0]) * (a[2] + b[2]) / 2 for a, b in zip(curve[:-1], curve[1:], strict=True))
    got = M.pr_area(points(spark, scores, labels).withColumn("score", F.col("x"))).first().pr_auc
    assert got == pytest.approx(area)


def test_refine_grows_from_the_peak(spark):
    level = [0.0] * 100
    for t in range(40, 60):
        level[t] = 0.6
    level[50] = 2.0
    signals = spark.createDataFrame([("a", t, v, 1.0) for t, v in enumerate(level)], "series_id string, t int, rmdev double, std double")
    ranges = spark.createDataFrame([("a", 48, 49), ("a", 90, 95)], "series_id string, seg_start int, seg_end int")
    lengths = spark.createDataFrame([("a", 100)], "series_id string, n int")
    got = {(r.seg_start, r.seg_end) for r in S.refine_ranges(ranges, signals, lengths, reach=5).collect()}
    assert got == {(40, 60)}


def test_neighbours(spark):
    r = random.Random(2)
    rows = [("a", k, [r.gauss(0, 1) for _ in range(6)]) for k in range(60)]
    df = spark.createDataFrame(rows, "series_id string, win int, values array<double>")
    test, train = df.where("win < 10"), df.where("win >= 10")
    got = {x.win: x.score for x in knn_scores(test, train, 3).collect()}
    for _, k, v in rows[:10]:
        d = sorted(math.dist(v, w) for _, j, w in rows if j >= 10)[:3]
        assert got[k] == pytest.approx(sum(d) / 3)
    near = {x.win: x.score for x in lsh_knn_scores(test, train, 3, width=8.0).collect()}
    assert near.keys() == got.keys() and all(near[k] >= got[k] - 1e-9 for k in got)


def test_stl_recovers_a_season():
    import numpy as np

    t = np.arange(240)
    x = 0.05 * t + 3 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(1).normal(0, 0.1, 240)
    x[100] += 8  # an outlier stays in the remainder
    s, trend, rest = stl(x, 12)
    assert np.allclose(s + trend + rest, x)
    assert rest[100] > 7 and np.abs(np.delete(rest, 100)).max() < 0.6
    assert np.corrcoef(s, np.sin(2 * np.pi * t / 12))[0, 1] > 0.99


def test_nearest_in_blocks(spark, monkeypatch):
    import tideline.operators.neighbours as N

    monkeypatch.setattr(N, "QUERY_BLOCK", 7)
    monkeypatch.setattr(N, "REFERENCE_BLOCK", 9)
    monkeypatch.setattr(N, "PRODUCT_ROWS", 3)
    r = np.random.default_rng(4)
    v = np.round(r.normal(size=(80, 6)), 1) + 1000.0
    v[10:20] = v[0]  # ties
    rows = [("ab"[i % 3 == 0], i, v[i].tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, id int, values array<double>").unionByName(spark.createDataFrame([("a", 900, None)], "g string, id int, values array<double>"))
    for metric in ("euclidean", "cosine"):
        got = {(x.qid, x["rank"]): (x.rid, x.d) for x in N.nearest(df, df, 3, ["g"], "id", "id", metric).collect()}
        for g, i, _ in rows:
            own = [j for h, j, _ in rows if h == g]
            d = np.linalg.norm(v[own] - v[i], axis=1) if metric == "euclidean" else -(v[own] @ v[i]) / np.sqrt((v[own] ** 2).sum(axis=1) * (v[i] ** 2).sum())
            best = sorted(zip(d, own, strict=True))[:3]
            assert [got[i, k + 1][1] for k in range(3)] == pytest.approx([x for x, _ in best], abs=1e-12)
            if metric == "euclidean":
                assert [got[i, k + 1][0] for k in range(3)] == [j for _, j in best]
        assert len(got) == 240


def test_hashed_search_finds_most_neighbours(spark):
    from tideline.operators.neighbours import lsh_knn_scores

    r = np.random.default_rng(6)
    centres = r.normal(size=(20, 8)) * 10
    rows = [("s", i, (centres[i % 20] + 0.3 * r.normal(size=8)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "series_id string, win int, values array<double>")
    test, train = df.where("win % 6 = 0"), df.where("win % 6 <> 0")
    exact = {x.win: x.score for x in knn_scores(test, train, 3).collect()}
    near = {x.win: x.score for x in lsh_knn_scores(test, train, 3, width=4.0).collect()}
    assert np.mean([near[w] <= exact[w] + 1e-9 for w in exact]) >= 0.9


def test_hashed_search_compares_what_shares_a_bucket(spark, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    import tideline.operators.neighbours as N

    monkeypatch.setattr(N, "QUERY_BLOCK", 40)
    monkeypatch.setattr(N, "REFERENCE_BLOCK", 50)
    r = np.random.default_rng(8)
    # Few windows of the first series share a bucket, most of the second do: one is searched by bucket, one as a whole.
    rows = [(s, i, (size * r.normal(size=6)).tolist()) for s, size in (("far", 20.0), ("near", 2.0)) for i in range(400)]
    df = spark.createDataFrame(rows, "series_id string, win int, values array<double>")
    test, train = df.where("win % 4 = 0"), df.where("win % 4 <> 0")
    vectors = df.withColumn("features", array_to_vector("values"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=4.0, numHashTables=2, seed=3).fit(vectors)
    h = {(x.series_id, x.win): [v[0] for v in x.h] for x in model.transform(vectors).collect()}
    values = {(s, i): v for s, i, v in rows}
    got = {(x.series_id, x.win): (x.score, x.k) for x in N.lsh_knn_scores(test, train, 3, width=4.0, tables=2).collect()}
    assert len(got) == 200
    for s, i in got:
        other = [j for t, j in values if t == s and j % 4]
        shared = [j for j in other if any(a == b for a, b in zip(h[s, i], h[s, j], strict=True))]
        d = sorted(math.dist(values[s, i], values[s, j]) for j in (shared if len(shared) >= 3 else other))[:3]
        assert got[s, i] == (pytest.approx(sum(d) / 3), 3)


def test_hashed_search_in_wide_buckets_makes_no_rows_of_pairs(spark):
    from tideline.operators.neighbours import lsh_knn_scores

    r = np.random.default_rng(9)
    rows = [("s", i, r.normal(size=20).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "series_id string, win int, values array<double>")
    test, train = df.where("win % 5 = 0"), df.where("win % 5 <> 0")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    exact = {x.win: x.score for x in knn_scores(test, train, 3).collect()}
    before = written()
    near = {x.win: x.score for x in lsh_knn_scores(test, train, 3, width=1e6).collect()}
    # 1.4 million pairs; the windows themselves are half a megabyte.
    assert written() - before < 20_000_000
    # Windows on either side of 0 may share no bucket, but hardly in all tables.
    assert near.keys() == exact.keys() and np.mean([near[w] <= exact[w] + 1e-9 for w in exact]) >= 0.9


@pytest.mark.parametrize("lags", [5, 40])
def test_autocorrelation_of_stretches(spark, monkeypatch, lags):
    from tideline.operators import evidence

    monkeypatch.setattr(evidence, "STRETCH", 50)
    r = np.random.default_rng(2)
    series = {"a": r.normal(size=333).cumsum(), "b": r.normal(size=20), "c": np.ones(9)}
    df = spark.createDataFrame([(k, t, float(x)) for k, v in series.items() for t, x in enumerate(v)], "series_id string, t int, x double")
    got = {(x.series_id, x.lag): x.acf for x in evidence.autocorrelation(df, ["series_id"], "t", lags).collect()}
    for k, v in series.items():
        d = v - v.mean()
        for lag in range(min(lags, len(v) - 1) + 1):
            if k == "c":
                assert got[k, lag] is None
            else:
                assert got[k, lag] == pytest.approx((d[: len(d) - lag] * d[lag:]).sum() / (d * d).sum(), abs=1e-9)


def test_counts_up_to_a_value(spark):
    from tideline.operators.evidence import counted, ranked

    r = np.random.default_rng(3)
    values = {"a": np.round(r.normal(size=500), 1), "b": np.zeros(30)}
    train = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "series_id string, x double")
    asked = spark.createDataFrame([(k, i, float(x)) for k in "ab" for i, x in enumerate([-9, -0.1, 0, 0.1, 0.55, 9])], "series_id string, i int, x double")
    for strict in (False, True):
        for x in counted(train, asked, strict).collect():
            below = values[x.series_id][values[x.series_id] < x.x] if strict else values[x.series_id][values[x.series_id] <= x.x]
            assert (x.k, x.s) == (len(below), pytest.approx(below.sum()))
    assert [x.x for x in ranked(train).where("series_id = 'a'").orderBy("k").collect()] == sorted(values["a"].tolist())


def test_published_layout(spark, tmp_path):
    import pickle

    from tideline.sources.series import load_category, read_published

    r = np.random.default_rng(1)
    for split, lengths in (("train", (40, 30)), ("eval", (20, 11))):
        (tmp_path / "point" / split).mkdir(parents=True)
        data = {"series": [r.normal(size=(n, 1)) for n in lengths], "anom": [[[(2, 5), (8, 9)]] for _ in lengths]}
        (tmp_path / "point" / split / "data.pkl").write_bytes(pickle.dumps(data))
    train, evaluation = (read_published(spark, str(tmp_path), "point", x) for x in ("train", "eval"))
    assert [x.y for x in train.where("series_id = 'point/train/000001'").orderBy("t").collect()][:10] == [0, 0, 1, 1, 1, 0, 0, 0, 1, 0]
    by_rows = load_category(train, evaluation, "point", "rows").groupBy("split").agg(F.count("t").alias("n"), F.sum("y").alias("y")).collect()
    assert {(x.split, x.n, x.y) for x in by_rows} == {("train", 70, 0), ("val", 15, 4), ("test", 16, 4)}
    assert load_category(train, evaluation, "point").where("split = 'val'").count() == 10 + 5
    (tmp_path / "point" / "eval" / "data.pkl").write_bytes(b"cos\nsystem\n(S'true'\ntR.")
    with pytest.raises(Exception, match="not allowed"):
        evaluation.count()


def test_records_and_summary(spark, tmp_path):
    import json

    from tideline.plans.report import write_summary

    rows = points(spark, [0.0] * 20 + [9.0] * 5, [0] * 18 + [1] * 7).withColumn("pred", (F.col("x") > 5).cast("int"))
    scores = spark.createDataFrame([("a", w, float(w)) for w in range(8)], "series_id string, win int, score double")
    record = M.series_records(rows, S.extract_segments(rows), scores, signals=S.derived_signals(rows, 0.5), seconds=1.5).first()
    assert (record["class"], record.overlap, record.seconds, len(record.top_windows)) == ("partial_match", 5, 1.5, 5)
    assert record.max_cusum > 0 and record.argmax_cusum == 24
    runs = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 1.0), ("b", "x", 0.25)], "config string, category string, f1 double")
    write_summary(runs, ["f1"], str(tmp_path / "s"))
    (part,) = (tmp_path / "s").glob("part-*.json")
    assert json.loads(part.read_text()) == {"n_runs": 3, "n_categories": 2, "configs": [{"config": "a", "n_runs": 2, "f1": 0.75}, {"config": "b", "n_runs": 1, "f1": 0.25}]}
