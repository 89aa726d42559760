"""Registered queries over the driver's tables, each with SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.stats import gaussian_kernel, grubbs_critical
from tideline.operators import evidence as E
from tideline.operators import forecast as C
from tideline.operators import metrics as M
from tideline.operators import scoring as S
from tideline.operators import windows as W
from tideline.operators.neighbours import knn_scores, lsh_knn_scores, retrieve
from tideline.plans import report as R
from tideline.plans.detect import Pipeline, build_pipeline, train_and_test
from tideline.reasoning import prompts as P
from tideline.reasoning import replies as L
from tideline.reasoning.backends import RuleBackend, ask_ranges
from tideline.reasoning.scoring import contrast, merge_verdicts, range_reasoning, suspicious, window_reasoning
from tideline.sources import series as D

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
WIDTH, STEP = 20, 10

# Common table expressions that the SQL texts build on.
_CTES = {
    "pts": "SELECT event_type AS series_id, CAST(ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS INT) AS t, value AS x, CAST(value > 150 AS INT) AS y FROM events",
    "ln": "SELECT series_id, CAST(COUNT(*) AS INT) AS n FROM pts GROUP BY 1",
    "wp": "SELECT series_id, CAST(win AS INT) AS win, CAST(t - win * 10 AS INT) AS pos, t, x, y FROM (SELECT p.series_id, t, x, y, n, unnest(range(greatest(0, (t - 10) // 10), t // 10 + 1)) AS win FROM pts p JOIN ln USING (series_id)) WHERE t - win * 10 BETWEEN 0 AND 19 AND win * 10 + 20 <= n",
    "tr": "SELECT p.series_id, t, x, y FROM pts p JOIN ln USING (series_id) WHERE t < CAST(floor(n * CAST(0.6 AS DOUBLE)) AS INT)",
    "te": "SELECT p.series_id, CAST(t - CAST(floor(n * CAST(0.6 AS DOUBLE)) AS INT) AS INT) AS t, x, y FROM pts p JOIN ln USING (series_id) WHERE t >= CAST(floor(n * CAST(0.6 AS DOUBLE)) AS INT)",
    "st": "SELECT series_id, avg(x) AS mean, stddev_pop(x) AS std FROM tr GROUP BY 1",
    "ws": "SELECT series_id, win, abs(avg(x) - 100) AS score FROM wp GROUP BY 1, 2",
    "sc": "SELECT series_id, t, y, abs(x - 90) AS score FROM pts",
    "pr": "SELECT series_id, t, y, CAST(abs(x - 90) >= 75 AS INT) AS pred, abs(x - 90) AS score FROM pts",
    "fc": "SELECT a.series_id, a.win, a.pos, a.x, b.x AS f FROM wp a JOIN wp b ON a.series_id = b.series_id AND a.win = b.win + 2 AND b.pos = a.pos",
    "sgp": "SELECT series_id, t - ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY t) AS g, t FROM pr WHERE pred = 1",
    "sg": "SELECT series_id, CAST(min(t) AS INT) AS seg_start, CAST(max(t) + 1 AS INT) AS seg_end FROM sgp GROUP BY series_id, g",
    "syp": "SELECT series_id, t - ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY t) AS g, t FROM pr WHERE y = 1",
    "sy": "SELECT series_id, CAST(min(t) AS INT) AS seg_start, CAST(max(t) + 1 AS INT) AS seg_end FROM syp GROUP BY series_id, g",
    "ship": "SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1",
    "daily": "SELECT CAST(date_diff('day', a, d) AS INT) AS t, coalesce(v, CAST(0 AS DOUBLE)) AS x FROM (SELECT a, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT min(day) AS a, max(day) AS b FROM ship)) s LEFT JOIN ship ON ship.day = s.d",
    "dm": "SELECT t, x, CASE WHEN count(x) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 THEN sum(x) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 END AS trend, t % 7 AS phase FROM daily",
    "ds": "SELECT phase, m - avg(m) OVER () AS seasonal FROM (SELECT phase, avg(x - trend) AS m FROM dm GROUP BY 1)",
    "dd": "SELECT t, x, trend, seasonal, x - trend - seasonal AS resid, phase FROM dm JOIN ds USING (phase)",
    "cu1": "SELECT p.series_id, t, x, y, mean, std, CASE WHEN t = 0 THEN CAST(0 AS DOUBLE) ELSE x - mean - 3 * std END AS a, CASE WHEN t = 0 THEN CAST(0 AS DOUBLE) ELSE mean - x - 3 * std END AS b FROM pts p JOIN (SELECT series_id, avg(x) AS mean, greatest(stddev_pop(x), 1e-10) AS std FROM pts GROUP BY 1) USING (series_id)",
    "cu2": "SELECT *, sum(a) OVER w AS pa, sum(b) OVER w AS pb, avg(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) - mean AS rmdev FROM cu1 WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)",
    "sig": "SELECT series_id, t, x, y, std, rmdev, greatest(pa - min(pa) OVER w, pb - min(pb) OVER w) AS cusum FROM cu2 WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)",
    "ev": "SELECT series_id, win, max(abs(x - mean) / greatest(std, 1e-10)) AS z, stddev_pop(x) / greatest(any_value(std), 1e-10) AS v FROM wp JOIN st USING (series_id) GROUP BY 1, 2",
    "runs": "SELECT o_orderpriority AS config, o_orderstatus AS category, CAST(o_totalprice AS DOUBLE) AS f1, CAST(o_orderkey % 97 AS DOUBLE) / 97 AS pa_f1, CAST(o_custkey % 11 AS DOUBLE) AS time_s FROM orders",
    "cand": "SELECT series_id, CAST(unnest(range(0, 100)) AS INT) AS k, unnest(quantile_cont(score, [" + ", ".join(repr((80.0 + (99.9 - 80.0) * k / 99) / 100) for k in range(100)) + "])) AS threshold FROM sc GROUP BY 1",
}
_NEEDS = {
    "ln": ["pts"], "wp": ["ln"], "tr": ["ln"], "te": ["ln"], "st": ["tr"], "ws": ["wp"], "sc": ["pts"], "pr": ["pts"], "fc": ["wp"], "sgp": ["pr"], "sg": ["sgp"], "syp": ["pr"], "sy": ["syp"],
    "daily": ["ship"], "dm": ["daily"], "ds": ["dm"], "dd": ["ds"], "cu1": ["pts"], "cu2": ["cu1"], "sig": ["cu2"], "ev": ["wp", "st"],
}


_ACF_TRAIN = "SELECT a.series_id, b.t - a.t AS lag, sum(a.d * b.d) AS s FROM trd a JOIN trd b ON a.series_id = b.series_id AND b.t BETWEEN a.t AND a.t + 19 GROUP BY 1, 2"
_ACF_WIN = "SELECT a.series_id, a.win, b.pos - a.pos AS lag, sum(a.d * b.d) AS s FROM wpd a JOIN wpd b ON a.series_id = b.series_id AND a.win = b.win AND b.pos >= a.pos GROUP BY 1, 2, 3"
_CTES["ed"] = "SELECT series_id, win, n, tn, least(a, ta) - 1e-10 AS lo, greatest(b, tb) + 1e-10 AS hi FROM (SELECT series_id, win, count(*) AS n, min(x) AS a, max(x) AS b FROM wp GROUP BY 1, 2) JOIN (SELECT series_id, count(*) AS tn, min(x) AS ta, max(x) AS tb FROM tr GROUP BY 1) USING (series_id)"
_CTES |= {
    "trd": "SELECT series_id, t, x - avg(x) OVER (PARTITION BY series_id) AS d FROM tr",
    "wpd": "SELECT series_id, win, pos, x - avg(x) OVER (PARTITION BY series_id, win) AS d FROM wp",
    "act": _ACF_TRAIN, "aw": _ACF_WIN,
    "dmn": "SELECT t, x - avg(x) OVER () AS d FROM daily",
    "da": "SELECT lag, s / first_value(s) OVER (ORDER BY lag) AS acf FROM (SELECT b.t - a.t AS lag, sum(a.d * b.d) AS s FROM dmn a JOIN dmn b ON b.t BETWEEN a.t AND a.t + 500 GROUP BY 1)",
    "ex": "SELECT vec_id AS id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i, (SELECT sum(CAST(u AS DOUBLE) * u) FROM (SELECT unnest(embedding) AS u)) AS n FROM embeddings",
    "lv": "SELECT series_id, t, abs(rmdev) / std AS v FROM sig",
    "isl": "SELECT series_id, min(t) AS a, max(t) + 1 AS b FROM (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM lv WHERE v >= 0.2) GROUP BY series_id, g",
    "lin": "SELECT series_id, k, CASE WHEN k = 199 THEN b ELSE a + k * ((b - a) / 199) END AS threshold FROM (SELECT series_id, min(score) AS a, max(score) AS b FROM sc GROUP BY 1), (SELECT CAST(unnest(range(0, 200)) AS INT) AS k)",
    "trw": "SELECT series_id, CAST(win AS INT) AS win, CAST(t - win * 10 AS INT) AS pos, x FROM (SELECT p.series_id, t, x, n, unnest(range(greatest(0, (t - 10) // 10), t // 10 + 1)) AS win FROM tr p JOIN (SELECT series_id, count(*) AS n FROM tr GROUP BY 1) USING (series_id)) WHERE t - win * 10 BETWEEN 0 AND 19 AND win * 10 + 20 <= n",
    "tew": "SELECT series_id, CAST(win AS INT) AS win, CAST(t - win * 10 AS INT) AS pos, x FROM (SELECT p.series_id, t, x, n, unnest(range(greatest(0, (t - 10) // 10), t // 10 + 1)) AS win FROM te p JOIN (SELECT series_id, count(*) AS n FROM te GROUP BY 1) USING (series_id)) WHERE t - win * 10 BETWEEN 0 AND 19 AND win * 10 + 20 <= n",
    "kn": "SELECT series_id, win, avg(d) AS score FROM (SELECT series_id, win, d, row_number() OVER (PARTITION BY series_id, win ORDER BY d, rid) AS r FROM (SELECT a.series_id, a.win, b.win AS rid, sqrt(sum(power((a.x - b.x) / s, 2))) AS d FROM tew a JOIN trw b ON a.series_id = b.series_id AND a.pos = b.pos JOIN (SELECT series_id, stddev_pop(x) AS s FROM trw GROUP BY 1) z ON z.series_id = a.series_id GROUP BY 1, 2, 3)) WHERE r <= 5 GROUP BY 1, 2",
    "ps": "SELECT p.series_id, p.t, coalesce(greatest(0, max(score)), 0) AS score FROM te p LEFT JOIN kn w ON p.series_id = w.series_id AND p.t BETWEEN w.win * 10 AND w.win * 10 + 19 GROUP BY 1, 2",
}
_NEEDS |= {"trd": ["tr"], "wpd": ["wp"], "act": ["trd"], "aw": ["wpd"], "dmn": ["daily"], "da": ["dmn"], "lv": ["sig"], "isl": ["lv"], "lin": ["sc"], "trw": ["tr"], "tew": ["te"], "kn": ["tew", "trw"], "ps": ["te", "kn"], "cand": ["sc"], "ed": ["wp", "tr"]}


def sql(body: str, *ctes: str) -> str:
    """A query with the common expressions that it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in ctes:
        add(name)
    return ("WITH " + ", ".join(f"{n} AS ({_CTES[n]})" for n in order) + " " if order else "") + body


def r6(value: str) -> str:
    return f"round({value}, 6) + CAST(0 AS DOUBLE)"


def query(name: str, text: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(f"`{n}`"), 6) + 0.0).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in df.dtypes])

        _QUERIES[name] = rounded
        if text is not None:
            _SQL[name] = text
        return f

    return register


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.event_points(spark, sf_dir)


def train_of(p: DataFrame) -> DataFrame:
    return train_and_test(p)[0]


def plain_stats(p: DataFrame) -> DataFrame:
    return train_of(p).groupBy("series_id").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def window_scores(p: DataFrame) -> DataFrame:
    return W.window_points(p, WIDTH, STEP).groupBy("series_id", "win").agg(F.abs(F.avg("x") - 100).alias("score"))


def scored(p: DataFrame) -> DataFrame:
    return p.select("series_id", "t", "y", F.abs(F.col("x") - 90).alias("score"))


def predicted(p: DataFrame) -> DataFrame:
    return scored(p).withColumn("pred", (F.col("score") >= 75).cast("int"))


def ahead(p: DataFrame) -> DataFrame:
    """Each window beside the one two steps before it, as its forecast."""
    w = W.window_points(p, WIDTH, STEP)
    f = w.select("series_id", "win", F.col("pos").alias("step"), F.col("x").alias("f"))
    return C.align_forecasts(w.select("series_id", "win", "pos", "x"), f, WIDTH, STEP, "ahead")


# --- sources, windows, scaling --------------------------------------------------


@query("split", sql("SELECT p.series_id, CASE WHEN t < floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' WHEN t < floor(n * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split, count(*) AS n_points, sum(CASE WHEN t < floor(n * CAST(0.6 AS DOUBLE)) THEN 0 ELSE y END)::BIGINT AS n_labels FROM pts p JOIN ln USING (series_id) GROUP BY 1, 2", "ln"))
def _(s, d):
    return D.split_points(points(s, d)).groupBy("series_id", "split").agg(F.count(F.lit(1)).alias("n_points"), F.sum("y").alias("n_labels"))


@query("load_category", sql("SELECT p.series_id, CASE WHEN t < n // 2 THEN 'val' ELSE 'test' END AS split, count(*) AS n_points, sum(y)::BIGINT AS n_labels, 'point' AS category FROM pts p JOIN ln USING (series_id) GROUP BY 1, 2 UNION ALL SELECT series_id, 'train', count(*), 0, 'point' FROM pts GROUP BY 1", "ln"))
def _(s, d):
    p = points(s, d)
    return D.load_category(p, p, "point").groupBy("series_id", "split", "category").agg(F.count(F.lit(1)).alias("n_points"), F.sum("y").alias("n_labels"))


@query("label_points", sql("SELECT series_id, t, y FROM pr", "pr"))
def _(s, d):
    p = points(s, d)
    return D.label_points(p.drop("y").withColumn("y", F.lit(0)), S.extract_segments(p, "y")).select("series_id", "t", "y")


@query("few_shot", sql("SELECT series_id, count(*) AS n_points FROM pts WHERE series_id IN (SELECT series_id FROM (SELECT DISTINCT series_id FROM pts) ORDER BY md5(series_id), series_id LIMIT 3) GROUP BY 1", "pts"))
def _(s, d):
    return D.few_shot(points(s, d), 3).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_points"))


@query("head_points", sql("SELECT series_id, t, x FROM pts WHERE t < 100", "pts"))
def _(s, d):
    return D.head(points(s, d), 100).select("series_id", "t", "x")


@query("daily_series", sql(f"SELECT t, {r6('x')} AS x FROM daily", "daily"))
def _(s, d):
    return D.daily_shipments(s, d).select("t", "x")


def _hashed(*key: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 10) AS BIGINT)"


def _unit(*key: str) -> str:
    return f"({_hashed(*key, '42')} / 1099511627776.0::DOUBLE)"


_SYNTH = f"""WITH base AS (SELECT CAST(t AS INT) AS t, CAST(d AS INT) AS d FROM range(2000) a(t), range(5) b(d)),
clean AS (SELECT t, d, sin((1 + 0.5::DOUBLE * d) * (t * (10 * 3.141592653589793::DOUBLE / 1999)) + {_unit("'phase'", "d")} * 6.283185307179586::DOUBLE)
  + 0.1::DOUBLE * sqrt(-2 * ln(greatest({_unit("'u'", "t", "d")}, 1e-9::DOUBLE))) * cos(6.283185307179586::DOUBLE * {_unit("'v'", "t", "d")}) AS x FROM base),
seg AS (SELECT CAST(floor({_unit("'start'", "k")} * 1990) AS INT) AS a, CAST(floor(3 + {_unit("'length'", "k")} * 7) AS INT) AS size, CAST(floor({_unit("'kind'", "k")} * 3) AS INT) AS kind, 2 + 3 * {_unit("'height'", "k")} AS height FROM range(20) r(k)),
inside AS (SELECT *, unnest(range(a, least(a + size, 2000))) AS t FROM seg),
lift AS (SELECT t, sum(CASE kind WHEN 0 THEN height WHEN 1 THEN height / 2 ELSE height * (t - a) / size END) AS lift FROM inside GROUP BY t)
SELECT 'dim' || d AS series_id, t, {r6("x + coalesce(lift, 0)")} AS x, CAST(t >= 1200 AND lift IS NOT NULL AS INT) AS y, CASE WHEN t < 1200 THEN 'train' WHEN t < 1600 THEN 'val' ELSE 'test' END AS split FROM clean LEFT JOIN lift USING (t)"""


@query("synth_source", _SYNTH)
def _(s, d):
    return D.synthetic(s, 2000, 5)


@query("win_create", sql(f"SELECT series_id, win, CAST(win * 10 AS INT) AS start, CAST(count(*) AS INT) AS size, {r6('sum(x * (pos + 1))')} AS weighted FROM wp GROUP BY 1, 2", "wp"))
def _(s, d):
    w = W.create_windows(points(s, d), WIDTH, STEP)
    weighted = F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return w.select("series_id", "win", "start", F.size("values").alias("size"), weighted.alias("weighted"))


@query("scale_coverage", sql(f"SELECT series_id, {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS std, {r6('stddev_pop(x)')} AS scale FROM wp GROUP BY 1", "wp"))
def _(s, d):
    return W.fit_scaler(points(s, d), WIDTH, STEP)


@query("scale_apply", sql(f"SELECT p.series_id, t, {r6('(x - m) / s')} AS x FROM pts p JOIN (SELECT series_id, avg(x) AS m, stddev_pop(x) AS s FROM wp GROUP BY 1) USING (series_id)", "wp"))
def _(s, d):
    p = points(s, d)
    return W.scale(p, W.fit_scaler(p, WIDTH, STEP)).select("series_id", "t", "x")


@query("train_stats", sql("SELECT series_id, " + ", ".join([f"{r6('avg(x)')} AS mean", f"{r6('stddev_pop(x) + 1e-10')} AS std", f"{r6('min(x)')} AS min", f"{r6('max(x)')} AS max", *[f"{r6(f'quantile_cont(x, {q})')} AS p{int(round(q * 100)):02d}" for q in W.QUANTILES]]) + " FROM wp GROUP BY 1", "wp"))
def _(s, d):
    return W.train_stats(points(s, d), WIDTH, STEP)


@query("standardize", sql(f"SELECT p.series_id, t, {r6('(x - mean) / std')} AS x FROM pts p JOIN st USING (series_id)", "st"))
def _(s, d):
    p = points(s, d)
    return W.standardize(p, plain_stats(p)).select("series_id", "t", "x")


@query("reconstruct", sql(f"SELECT series_id, t, {r6('avg(x)')} AS x FROM wp GROUP BY 1, 2", "wp"))
def _(s, d):
    return W.reconstruct(W.window_points(points(s, d), WIDTH, STEP), STEP)


@query("fit_length", sql("SELECT s.series_id, CAST(s.t AS INT) AS t, coalesce(x, CAST(0 AS DOUBLE)) AS x FROM (SELECT series_id, unnest(range(0, 2000)) AS t FROM (SELECT DISTINCT series_id FROM pts)) s LEFT JOIN pts p ON p.series_id = s.series_id AND p.t = s.t", "pts"))
def _(s, d):
    return W.fit_length(points(s, d), 2000)


@query("minmax", sql(f"SELECT p.series_id, t, {r6('CASE WHEN b > a THEN (x - a) / (b - a) * 10 ELSE 5 END')} AS x FROM pts p JOIN (SELECT series_id, min(x) AS a, max(x) AS b FROM pts GROUP BY 1) USING (series_id)", "pts"))
def _(s, d):
    return W.scale_to_range(points(s, d), 0.0, 10.0).select("series_id", "t", "x")


@query("pad_patch", sql("SELECT series_id, win, CAST(32 AS INT) AS size, " + r6("12 * max(CASE WHEN pos = 0 THEN x END) + sum(x)") + " AS total FROM wp GROUP BY 1, 2", "wp"))
def _(s, d):
    w = W.create_windows(points(s, d), WIDTH, STEP).withColumn("v", W.pad_to_multiple(F.col("values"), 32))
    return w.select("series_id", "win", F.size("v").alias("size"), F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("topk_windows", sql(f"SELECT series_id, win, {r6('score')} AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, win) AS r FROM ws) WHERE r <= 5", "ws"))
def _(s, d):
    return W.top_windows(window_scores(points(s, d)), 5)


@query("bottomk_windows", sql(f"SELECT series_id, win, {r6('score')} AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score, win) AS r FROM ws) WHERE r <= 3", "ws"))
def _(s, d):
    return W.top_windows(window_scores(points(s, d)), 3, ascending=True)


# --- evidence -------------------------------------------------------------------


@query("mae_mse_mape", sql(f"SELECT series_id, win, {r6('avg(abs(x - f))')} AS mae, {r6('avg((x - f) * (x - f))')} AS mse, {r6('100 * avg(abs((x - f) / (abs(x) + 1e-10)))')} AS mape FROM fc GROUP BY 1, 2", "fc"))
def _(s, d):
    return E.forecast_errors(ahead(points(s, d)))


@query("quantile_violation", sql(f"SELECT series_id, win, {r6('avg(CASE WHEN x < p10 OR x > p90 THEN 1 ELSE 0 END)')} AS violation_ratio, {r6('avg(CASE WHEN x < p01 OR x > p99 THEN 1 ELSE 0 END)')} AS extreme_violation_ratio, max(CASE WHEN x < p01 OR x > p99 THEN 1 ELSE 0 END) > 0 AS extreme_violation FROM wp JOIN (SELECT series_id, quantile_cont(x, 0.01) AS p01, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.99) AS p99 FROM tr GROUP BY 1) USING (series_id) GROUP BY 1, 2", "wp", "tr"))
def _(s, d):
    p = points(s, d)
    q = train_of(p).groupBy("series_id").agg(*[F.percentile("x", v).alias(n) for n, v in (("p01", 0.01), ("p10", 0.1), ("p90", 0.9), ("p99", 0.99))])
    return E.quantile_violations(W.window_points(p, WIDTH, STEP).join(q, "series_id"))


@query("surprise", sql(f"SELECT series_id, win, {r6('avg(v)')} AS mean_surprise, {r6('max(v)')} AS max_surprise FROM (SELECT a.series_id, a.win, a.pos, CASE WHEN stddev_pop(b.x) < 1e-10 THEN CAST(0 AS DOUBLE) ELSE -ln(1 - 2 * abs(avg(CAST(b.x <= a.x AS INT)) - 0.5) + 1e-10) END AS v FROM wp a JOIN wp b ON a.series_id = b.series_id AND b.win BETWEEN a.win - 5 AND a.win - 1 AND a.pos = b.pos GROUP BY 1, 2, 3) GROUP BY 1, 2", "wp"))
def _(s, d):
    w = W.window_points(points(s, d), WIDTH, STEP).select("series_id", "win", "pos", "x")
    samples = w.select("series_id", F.explode(F.sequence(F.col("win") + 1, F.col("win") + 5)).alias("win"), "pos", F.col("x").alias("v"))
    return E.surprise(w, samples)


@query("zscore", sql(f"SELECT series_id, win, {r6('max(z)')} AS max_abs_z_score, {r6('avg(z)')} AS mean_abs_z_score, count(*) FILTER (z > 1.5) AS extreme_z_count, {r6('(count(*) FILTER (z > 1.5)) / count(*)')} AS extreme_z_ratio FROM (SELECT series_id, win, abs(x - mean) / greatest(std, 1e-10) AS z FROM wp JOIN st USING (series_id)) GROUP BY 1, 2", "wp", "st"))
def _(s, d):
    p = points(s, d)
    return E.z_scores(W.window_points(p, WIDTH, STEP), plain_stats(p), 1.5)


@query("grubbs", sql(f"SELECT series_id, win, {r6('g')} AS grubbs_statistic, {r6(f'CAST({grubbs_critical(WIDTH)!r} AS DOUBLE)')} AS grubbs_critical, g > CAST({grubbs_critical(WIDTH)!r} AS DOUBLE) AS grubbs_is_outlier, place AS grubbs_outlier_index FROM (SELECT series_id, win, max(d) / any_value(sd) AS g, CAST(min(CASE WHEN d = m THEN pos END) AS INT) AS place FROM (SELECT *, max(d) OVER (PARTITION BY series_id, win) AS m FROM (SELECT series_id, win, pos, abs(x - avg(x) OVER (PARTITION BY series_id, win)) AS d, stddev_samp(x) OVER (PARTITION BY series_id, win) AS sd FROM wp)) GROUP BY 1, 2)", "wp"))
def _(s, d):
    return E.grubbs(W.window_points(points(s, d), WIDTH, STEP), WIDTH)


_CUSUM = "SELECT series_id, win, pos, std, pa - min(pa) OVER w AS up, pb - min(pb) OVER w AS down FROM (SELECT *, sum(a) OVER v AS pa, sum(b) OVER v AS pb FROM (SELECT series_id, win, pos, std, CASE WHEN pos = 0 THEN CAST(0 AS DOUBLE) ELSE x - mean - 0.5 * std END AS a, CASE WHEN pos = 0 THEN CAST(0 AS DOUBLE) ELSE mean - x - 0.5 * std END AS b FROM wp JOIN st USING (series_id)) WINDOW v AS (PARTITION BY series_id, win ORDER BY pos ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY series_id, win ORDER BY pos ROWS UNBOUNDED PRECEDING)"


@query("cusum", sql(f"SELECT series_id, win, {r6('max(greatest(up, down))')} AS max_cusum, (count(*) FILTER (up > 5 * std) + count(*) FILTER (down > 5 * std)) > 0 AS cusum_has_change_point, (count(*) FILTER (up > 5 * std) + count(*) FILTER (down > 5 * std)) AS cusum_change_point_count FROM ({_CUSUM}) GROUP BY 1, 2", "wp", "st"))
def _(s, d):
    p = points(s, d)
    return E.cusum(W.window_points(p, WIDTH, STEP), plain_stats(p))


@query("kl_div", sql(
    "SELECT series_id, win, " + r6("sum(p / sp * ln((p / sp) / (q / sq)))") + " AS kl_divergence FROM (SELECT *, sum(p) OVER (PARTITION BY series_id, win) AS sp, sum(q) OVER (PARTITION BY series_id, win) AS sq FROM ("
    "SELECT e.series_id, e.win, e.b, coalesce(c, 0) / n / ((hi - lo) / 20) + 1e-10 AS q, coalesce(tc, 0) / tn / ((hi - lo) / 20) + 1e-10 AS p FROM (SELECT *, unnest(range(0, 20)) AS b FROM ed) e "
    "LEFT JOIN (SELECT w.series_id, w.win, least(floor((x - lo) / (hi - lo) * 20), 19) AS b, count(*) AS c FROM wp w JOIN ed USING (series_id, win) GROUP BY 1, 2, 3) a ON a.series_id = e.series_id AND a.win = e.win AND a.b = e.b "
    "LEFT JOIN (SELECT r.series_id, ed.win, least(floor((x - lo) / (hi - lo) * 20), 19) AS b, count(*) AS tc FROM tr r JOIN ed USING (series_id) GROUP BY 1, 2, 3) z ON z.series_id = e.series_id AND z.win = e.win AND z.b = e.b)) GROUP BY 1, 2", "wp", "tr", "ed"))  # fmt: skip
def _(s, d):
    p = points(s, d)
    return E.kl_divergence(W.window_points(p, WIDTH, STEP), train_of(p))


@query("wasserstein", sql(
    "SELECT series_id, win, " + r6("sum(abs(c) * gap)") + " AS wasserstein_distance, " + r6("sum(abs(c) * gap) / any_value(std)") + " AS normalized_wasserstein FROM (SELECT series_id, win, sum(w) OVER (PARTITION BY series_id, win ORDER BY x, kind ROWS UNBOUNDED PRECEDING) AS c, lead(x) OVER (PARTITION BY series_id, win ORDER BY x, kind) - x AS gap FROM ("
    "SELECT series_id, win, x, 1.0::DOUBLE / 20 AS w, 1 AS kind FROM wp UNION ALL SELECT k.series_id, k.win, r.x, -1.0::DOUBLE / tn, 2 FROM (SELECT DISTINCT series_id, win FROM wp) k JOIN tr r USING (series_id) JOIN (SELECT series_id, count(*) AS tn FROM tr GROUP BY 1) USING (series_id))) JOIN st USING (series_id) GROUP BY 1, 2", "wp", "st"))  # fmt: skip
def _(s, d):
    p = points(s, d)
    return E.wasserstein(W.window_points(p, WIDTH, STEP), train_of(p))


@query("acf_break", sql(
    f"SELECT series_id, win, {r6('max(abs(a - b))')} AS max_acf_diff, {r6('avg(abs(a - b))')} AS mean_acf_diff, arg_max(lag, a) FILTER (lag >= 1) <> arg_max(lag, b) FILTER (lag >= 1) AS period_changed FROM "
    f"(SELECT w.series_id, w.win, w.lag, t.s / t0.s AS a, w.s / w0.s AS b FROM aw w JOIN aw w0 ON w.series_id = w0.series_id AND w.win = w0.win AND w0.lag = 0 JOIN act t ON t.series_id = w.series_id AND t.lag = w.lag JOIN act t0 ON t0.series_id = w.series_id AND t0.lag = 0) GROUP BY 1, 2", "aw", "act"))  # fmt: skip
def _(s, d):
    p = points(s, d)
    return E.acf_break(W.window_points(p, WIDTH, STEP), train_of(p), WIDTH)


@query("volatility", sql(f"SELECT series_id, win, {r6('stddev_pop(x) / any_value(std)')} AS volatility_ratio, stddev_pop(x) / any_value(std) > 2 AS high_volatility, stddev_pop(x) / any_value(std) > 5 AS extreme_volatility, {r6('max(r)')} AS max_rolling_std FROM (SELECT series_id, win, x, stddev_pop(x) OVER (PARTITION BY series_id, win ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS r FROM wp) JOIN st USING (series_id) GROUP BY 1, 2", "wp", "st"))
def _(s, d):
    p = points(s, d)
    return E.volatility(W.window_points(p, WIDTH, STEP), plain_stats(p))


@query("trend_break", sql(f"SELECT series_id, win, {r6('s1')} AS slope_before, {r6('s2')} AS slope_after, {r6('abs(s2 - s1)')} AS slope_diff, {r6('abs(b2 - b1)')} AS level_diff, abs(s2 - s1) > CASE WHEN rg > 0 THEN 0.1 * rg / 20 ELSE 0.01 END AS trend_break FROM (SELECT series_id, win, regr_slope(x, pos) FILTER (pos < 10) AS s1, regr_slope(x, pos) FILTER (pos >= 10) AS s2, regr_intercept(x, pos) FILTER (pos < 10) AS b1, regr_intercept(x, pos) FILTER (pos >= 10) AS b2, max(x) - min(x) AS rg FROM wp GROUP BY 1, 2)", "wp"))
def _(s, d):
    return E.trend_break(W.window_points(points(s, d), WIDTH, STEP), WIDTH)


@query("evidence_score", sql(f"SELECT series_id, win, {r6('(0.10 * least(10, z / pz) + 0.08 * least(10, v / pv)) / (CAST(0.10 AS DOUBLE) + 0.08)')} AS score FROM ev JOIN (SELECT series_id, quantile_cont(z, 0.95) AS pz, quantile_cont(v, 0.95) AS pv FROM ev GROUP BY 1) USING (series_id)", "ev"))
def _(s, d):
    p = points(s, d)
    w, stats = W.window_points(p, WIDTH, STEP), plain_stats(p)
    found = E.gather([E.z_scores(w, stats).select("series_id", "win", "max_abs_z_score"), E.volatility(w, stats).select("series_id", "win", "volatility_ratio")])
    return E.evidence_score(found, E.baselines(found, ["max_abs_z_score", "volatility_ratio"]))


@query("evidence_baselines", sql("SELECT series_id, " + ", ".join(f"{r6(f'quantile_cont({c}, 0.5)')} AS {n}_p50, {r6(f'quantile_cont({c}, 0.95)')} AS {n}_p95, {r6(f'max({c})')} AS {n}_max" for c, n in (("z", "max_abs_z_score"), ("v", "volatility_ratio"))) + " FROM ev GROUP BY 1", "ev"))
def _(s, d):
    p = points(s, d)
    w, stats = W.window_points(p, WIDTH, STEP), plain_stats(p)
    found = E.gather([E.z_scores(w, stats), E.volatility(w, stats)])
    return E.baselines(found, ["max_abs_z_score", "volatility_ratio"])


@query("majority_vote", sql("SELECT series_id, win, CAST(CAST(z > 1.9 AS INT) + CAST(v > 1 AS INT) AS INT) AS votes, z > 1.9 AND v > 1 AS is_anomaly FROM ev", "ev"))
def _(s, d):
    p = points(s, d)
    w, stats = W.window_points(p, WIDTH, STEP), plain_stats(p)
    found = E.gather([E.z_scores(w, stats), E.volatility(w, stats)]).select("series_id", "win", (F.col("max_abs_z_score") > 1.9).alias("a"), (F.col("volatility_ratio") > 1).alias("b"))
    return E.majority(found, ["a", "b"])


@query("window_features", sql(f"SELECT series_id, win, {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS std, {r6('min(x)')} AS min, {r6('max(x)')} AS max FROM wp GROUP BY 1, 2", "wp"))
def _(s, d):
    return W.window_points(points(s, d), WIDTH, STEP).groupBy("series_id", "win").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


# --- forecasts ------------------------------------------------------------------

@query("period_acf", sql("SELECT 'ship_daily' AS series_id, CAST(n AS INT) AS n, CAST(coalesce((SELECT min(lag) FROM (SELECT lag, acf, lag(acf) OVER (ORDER BY lag) AS p, lead(acf) OVER (ORDER BY lag) AS q FROM da WHERE lag <= least(n // 2, 500)) WHERE lag >= 1 AND acf > p AND acf > q AND acf >= 0.1), greatest(2, n // 10)) AS INT) AS period FROM (SELECT count(*) AS n FROM daily)", "da"))
def _(s, d):
    return C.detect_period(D.daily_shipments(s, d))


@query("linear_trend", sql(f"SELECT series_id, {r6('regr_slope(x, t)')} AS slope, {r6('regr_intercept(x, t)')} AS intercept FROM pts GROUP BY 1", "pts"))
def _(s, d):
    return C.linear_trend(points(s, d))


@query("classical_decompose", sql(f"SELECT t, {r6('trend')} AS trend, {r6('seasonal')} AS seasonal, {r6('resid')} AS resid FROM dd", "dd"))
def _(s, d):
    return C.decompose(D.daily_shipments(s, d), 7).select("t", "trend", "seasonal", "resid")


@query("seasonal_tile", sql(f"SELECT CAST(step AS INT) AS step, {r6('seasonal')} AS seasonal FROM (SELECT unnest(range(0, 30)) AS step) JOIN ds ON ds.phase = (step + 100) % 7", "ds"))
def _(s, d):
    season = C.decompose(D.daily_shipments(s, d), 7).groupBy("series_id", F.pmod("t", F.lit(7)).alias("phase")).agg(F.first("seasonal").alias("seasonal"))
    return C.tile_seasonal(season, 7, 100, 30).select("step", "seasonal")


@query("expected_series", sql(f"SELECT d.t, {r6('sl * d.t + ic + seasonal')} AS f FROM daily d JOIN ds ON ds.phase = d.t % 7 CROSS JOIN (SELECT regr_slope(trend, t) AS sl, regr_intercept(trend, t) AS ic FROM dm)", "ds"))
def _(s, d):
    p = D.daily_shipments(s, d)
    line, season = C.fit_trend_season(p, 7)
    return C.expected(p, line, season, 7).select("t", "f")


@query("residual_quantiles", sql("SELECT " + ", ".join([f"{r6('stddev_pop(e)')} AS std", *[f"{r6(f'quantile_cont(e, {q})')} AS q{int(q * 100):02d}" for q in (0.01, 0.1, 0.5, 0.9, 0.99)]]) + " FROM (SELECT d.x - (sl * d.t + ic + seasonal) AS e FROM daily d JOIN ds ON ds.phase = d.t % 7 CROSS JOIN (SELECT regr_slope(trend, t) AS sl, regr_intercept(trend, t) AS ic FROM dm))", "ds"))
def _(s, d):
    p = D.daily_shipments(s, d)
    line, season = C.fit_trend_season(p, 7)
    return C.residual_quantiles(C.expected(p, line, season, 7), [0.01, 0.1, 0.5, 0.9, 0.99]).drop("series_id")


@query("stl")
def _(s, d):
    return C.stl_decompose(D.daily_shipments(s, d), 7)


@query("deseasonalised")
def _(s, d):
    return C.stl_decompose(D.hourly_points(s, d), 24).select("series_id", "t", F.col("resid").alias("x"))


_CTES["rs"] = "SELECT d.t, sl * d.t + ic + seasonal AS f, d.x - (sl * d.t + ic + seasonal) AS e FROM daily d JOIN ds ON ds.phase = d.t % 7 CROSS JOIN (SELECT regr_slope(trend, t) AS sl, regr_intercept(trend, t) AS ic FROM dm)"
_NEEDS["rs"] = ["ds"]


@query("bootstrap_quantiles", sql(
    "SELECT 'ship_daily' AS series_id, t, " + ", ".join(f"{r6(f'quantile_cont(v, {q})')} AS {n}" for n, q in (("p01", 0.01), ("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + f", {r6('quantile_cont(v, 0.9) - quantile_cont(v, 0.1)')} AS uncertainty FROM ("
    f"SELECT a.t, a.f + b.e AS v FROM rs a CROSS JOIN range(50) r(s) JOIN (SELECT e, row_number() OVER (ORDER BY t) - 1 AS i FROM rs) b ON b.i = {_hashed(chr(39) + 'ship_daily' + chr(39), 'a.t', 's', '7')} % (SELECT count(*) FROM rs)) GROUP BY t", "rs"))  # fmt: skip
def _(s, d):
    p = D.daily_shipments(s, d)
    line, season = C.fit_trend_season(p, 7)
    e = C.expected(p, line, season, 7)
    samples = C.bootstrap_samples(e.select("series_id", "t", "f"), e.select("series_id", "t", (F.col("x") - F.col("f")).alias("e")))
    return C.sample_quantiles(samples, ["series_id", "t"])


@query("sample_quantiles", sql("SELECT series_id, pos, " + ", ".join(f"{r6(f'quantile_cont(x, {q})')} AS {n}" for n, q in (("p01", 0.01), ("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + f", {r6('quantile_cont(x, 0.9) - quantile_cont(x, 0.1)')} AS uncertainty FROM wp GROUP BY 1, 2", "wp"))
def _(s, d):
    return C.sample_quantiles(W.window_points(points(s, d), WIDTH, STEP).withColumn("v", F.col("x")), ["series_id", "pos"])


@query("interval_lookup", sql(f"SELECT series_id, {r6('quantile_cont(x, 0.1)')} AS low, {r6('quantile_cont(x, 0.9)')} AS high FROM pts GROUP BY 1", "pts"))
def _(s, d):
    return C.interval(C.sample_quantiles(points(s, d).withColumn("v", F.col("x")), ["series_id"]), 0.80).select("series_id", "low", "high")


@query("seasonal_naive_forecast", sql("SELECT a.series_id, a.t, a.x, b.x AS f FROM pts a JOIN pts b ON a.series_id = b.series_id AND a.t = b.t + 24", "pts"))
def _(s, d):
    return C.seasonal_naive(points(s, d), 24).select("series_id", "t", "x", "f")


_NAIVE = "SELECT series_id, win, step, l + b * (step + 1) AS f, l AS g FROM (SELECT series_id, win, max(CASE WHEN pos = 19 THEN x END) AS l, (max(CASE WHEN pos = 19 THEN x END) - max(CASE WHEN pos = 0 THEN x END)) / 19 AS b FROM wp GROUP BY 1, 2), (SELECT CAST(unnest(range(0, 5)) AS INT) AS step)"


def _two_forecasts(s, d):
    w = W.create_windows(points(s, d), WIDTH, STEP)
    return [C.naive_window_forecast(w, 5, "naive"), C.naive_window_forecast(w, 5, "drift")]


@query("ensemble_avg", sql(f"SELECT series_id, win, step, {r6('(f + g) / 2')} AS f, {r6('abs(f - g) / 2')} AS uncertainty, CAST(2 AS BIGINT) AS n_models FROM ({_NAIVE})", "wp"))
def _(s, d):
    return C.ensemble(_two_forecasts(s, d))


@query("ensemble_one", sql(f"SELECT series_id, win, step, {r6('f')} AS f, CAST(0 AS DOUBLE) AS uncertainty, CAST(1 AS BIGINT) AS n_models FROM ({_NAIVE})", "wp"))
def _(s, d):
    return C.ensemble(_two_forecasts(s, d), "drift")


@query("model_agreement", sql("SELECT series_id, a.win, " + r6("corr(a.x, b.x)") + " AS agreement FROM wp a JOIN wp b USING (series_id, pos) WHERE b.win = a.win + 1 GROUP BY 1, 2", "wp"))
def _(s, d):
    w = W.window_points(points(s, d), WIDTH, STEP).select("series_id", "win", F.col("pos").alias("step"), F.col("x").alias("f"))
    a = w.withColumn("model", F.lit("a"))
    b = w.withColumn("win", F.col("win") - 1).withColumn("model", F.lit("b"))
    both = a.join(b.select("series_id", "win").distinct(), ["series_id", "win"], "left_semi")
    return C.model_agreement([both, b.where("win >= 0")])


# Naive, seasonal and drift forecasts of a window; of five levels the tenths lie 0.4 of the way from the outer to the next.
_TENTH = 1.281552 + 0.6 * (2.326348 - 1.281552)
_MODELS = (
    "SELECT series_id, win, arr[20] AS f, (SELECT stddev_pop(arr[i + 1] - arr[i]) FROM range(1, 20) r(i)) AS sd, 1 AS grows, arr, 0 AS m FROM wa "
    "UNION ALL SELECT series_id, win, NULL, (SELECT stddev_pop(arr[i + 10] - arr[i]) FROM range(1, 11) r(i)), 0, arr, 1 FROM wa "
    "UNION ALL SELECT series_id, win, arr[20], (SELECT stddev_pop(arr[i + 1] - arr[i] - (arr[20] - arr[1]) / 19) FROM range(1, 20) r(i)), 1, arr, 2 FROM wa"
)
_CTES["wa"] = "SELECT series_id, win, list(x ORDER BY pos) AS arr FROM wp GROUP BY 1, 2"
_NEEDS["wa"] = ["wp"]


@query("forecast_models", sql(
    f"SELECT series_id, win, CAST(h AS INT) AS step, {r6('avg(CASE m WHEN 1 THEN arr[11 + h] WHEN 2 THEN f + (arr[20] - arr[1]) / 19 * (h + 1) ELSE f END)')} AS f, {r6(f'avg(2 * {_TENTH!r} * sd * (CASE WHEN grows = 1 THEN sqrt(h + 1) ELSE 1 END))')} AS uncertainty, count(*) AS n_models FROM ({_MODELS}), range(5) q(h) GROUP BY ALL", "wa"))
def _(s, d):
    w = W.create_windows(points(s, d), WIDTH, STEP)
    return C.ensemble([C.forecast_windows(w, m, 5, n) for m, n in ((C.Naive(), "naive"), (C.SeasonalNaive(10), "seasonal"), (C.Drift(), "drift"))])


# --- detection ------------------------------------------------------------------


@query("knn_score", sql(f"SELECT series_id, win, {r6('avg(d)')} AS score, count(*) AS k FROM (SELECT series_id, win, d, row_number() OVER (PARTITION BY series_id, win ORDER BY d, rid) AS r FROM (SELECT a.series_id, a.win, b.win AS rid, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM tew a JOIN trw b ON a.series_id = b.series_id AND a.pos = b.pos GROUP BY 1, 2, 3)) WHERE r <= 5 GROUP BY 1, 2", "tew", "trw"))
def _(s, d):
    train, test = train_and_test(points(s, d))
    return knn_scores(W.create_windows(test, WIDTH, STEP), W.create_windows(train, WIDTH, STEP))


@query("knn_score_lsh")
def _(s, d):
    train, test = train_and_test(points(s, d))
    return lsh_knn_scores(W.create_windows(test, WIDTH, STEP), W.create_windows(train, WIDTH, STEP), width=200.0)


_COS = "SELECT q, id, d, CAST(row_number() OVER (PARTITION BY q ORDER BY d DESC, id) AS INT) AS r FROM (SELECT a.id AS q, b.id AS id, CAST(sum(CAST(a.v AS DOUBLE) * b.v) / sqrt(any_value(a.n) * any_value(b.n)) AS DOUBLE) AS d FROM ex a JOIN ex b USING (i) WHERE a.id % 100 = 0 GROUP BY 1, 2)"


@query("vec_topk", sql(f"SELECT q AS query_id, id, r AS rank, {r6('d')} AS similarity FROM ({_COS}) WHERE r <= 5", "ex"))
def _(s, d):
    v = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    return retrieve(v.where("id % 100 = 0"), v, 5)


@query("vec_topk_label", sql(f"SELECT q AS query_id, id, CAST(row_number() OVER (PARTITION BY q ORDER BY d DESC, id) AS INT) AS rank, {r6('d')} AS similarity FROM (SELECT q, c.id, d FROM ({_COS}) c JOIN embeddings a ON a.vec_id = q JOIN embeddings b ON b.vec_id = c.id AND a.label = b.label) QUALIFY rank <= 3", "ex"))
def _(s, d):
    v = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), "label")
    return retrieve(v.where("id % 100 = 0"), v, 3, "label")


@query("align_ahead", sql("SELECT series_id, win, pos, x, f FROM fc", "fc"))
def _(s, d):
    return ahead(points(s, d)).select("series_id", "win", "pos", "x", "f")


@query("hybrid_score", sql(f"SELECT series_id, win, {r6('(1 + (a - la) / (ha - la)) * (1 + (b - lb) / (hb - lb))')} AS score FROM (SELECT *, min(a) OVER w AS la, max(a) OVER w AS ha, min(b) OVER w AS lb, max(b) OVER w AS hb FROM (SELECT series_id, win, avg(abs(x - f)) AS a, avg((x - f) * (x - f)) AS b FROM fc GROUP BY 1, 2) WINDOW w AS (PARTITION BY series_id))", "fc"))
def _(s, d):
    e = E.forecast_errors(ahead(points(s, d)))
    a = W.scale_to_range(e.select("series_id", "win", F.col("mae").alias("x")), 1.0, 2.0, "low").withColumnRenamed("x", "a")
    b = W.scale_to_range(e.select("series_id", "win", F.col("mse").alias("x")), 1.0, 2.0, "low").withColumnRenamed("x", "b")
    return a.join(b, ["series_id", "win"]).select("series_id", "win", (F.col("a") * F.col("b")).alias("score"))


# --- pooling, ranges --------------------------------------------------------------

_COVER = "SELECT p.series_id, p.t, w.score, w.win FROM pts p LEFT JOIN ws w ON p.series_id = w.series_id AND p.t BETWEEN w.win * 10 AND w.win * 10 + 19"


@query("pool_max", sql(f"SELECT series_id, t, {r6('coalesce(greatest(0, max(score)), 0)')} AS score FROM ({_COVER}) GROUP BY 1, 2", "ws"))
def _(s, d):
    p = points(s, d)
    return S.pool_max(window_scores(p), p, WIDTH, STEP)


@query("pool_avg", sql(f"SELECT series_id, t, {r6('coalesce(avg(score), 0)')} AS score FROM ({_COVER}) GROUP BY 1, 2", "ws"))
def _(s, d):
    p = points(s, d)
    return S.pool_average(window_scores(p), p, WIDTH, STEP)


@query("pool_gauss", sql(f"SELECT series_id, t, {r6('coalesce(sum(g * score) / greatest(sum(g), 1e-8), 0)')} AS score FROM (SELECT *, exp(-0.5 * power((t - win * 10 - 10.0) / (CAST(20 AS DOUBLE) / 6), 2)) AS g FROM ({_COVER})) GROUP BY 1, 2", "ws"))
def _(s, d):
    p = points(s, d)
    return S.pool_gaussian(window_scores(p), p, WIDTH, STEP)


_KERNEL = "SELECT * FROM (VALUES " + ", ".join(f"({k - 8}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(gaussian_kernel(2.0))) + ") k(o, w)"


@query("smooth_gauss", sql(f"SELECT a.series_id, a.t, {r6('sum(k.w * b.score)')} AS score FROM (SELECT sc.series_id, sc.t, n FROM sc JOIN ln USING (series_id)) a CROSS JOIN ({_KERNEL}) k JOIN sc b ON b.series_id = a.series_id AND b.t = CASE WHEN a.t + k.o < 0 THEN -(a.t + k.o) - 1 WHEN a.t + k.o >= n THEN 2 * n - 1 - (a.t + k.o) ELSE a.t + k.o END GROUP BY 1, 2", "sc", "ln"))
def _(s, d):
    return S.smooth_gaussian(scored(points(s, d)))


@query("derived_signals", sql(f"SELECT series_id, t, {r6('cusum')} AS cusum, {r6('rmdev')} AS rmdev FROM sig", "sig"))
def _(s, d):
    return S.derived_signals(points(s, d)).select("series_id", "t", "cusum", "rmdev")


@query("cusum_gate", sql(f"SELECT series_id, {r6('max(cusum) / max(std)')} AS level, max(cusum) / max(std) >= 2 AS passes FROM sig GROUP BY 1", "sig"))
def _(s, d):
    return S.cusum_gate(S.derived_signals(points(s, d)))


@query("range_cap", sql("SELECT series_id, n, CAST(greatest(3, floor(n * CAST(0.005 AS DOUBLE))) AS INT) AS max_ranges FROM ln", "ln"))
def _(s, d):
    return S.range_cap(D.series_lengths(points(s, d)), 0.005, 3)


@query("range_validate", sql(f"SELECT series_id, seg_start, seg_end, {r6('level')} AS level FROM (SELECT g.series_id, seg_start, seg_end, avg(abs(rmdev)) / max(std) AS level FROM sg g JOIN sig s ON s.series_id = g.series_id AND s.t >= seg_start AND s.t < seg_end GROUP BY 1, 2, 3) WHERE level >= 0.1", "sg", "sig"))
def _(s, d):
    p = points(s, d)
    return S.validate_ranges(S.extract_segments(predicted(p)), S.derived_signals(p), D.series_lengths(p), 0.1)


@query("range_refine", sql(
    "SELECT DISTINCT series_id, CAST(least(peak, coalesce(a, peak)) AS INT) AS seg_start, CAST(greatest(peak + 1, coalesce(b, peak)) AS INT) AS seg_end FROM (SELECT k.series_id, k.seg_start, k.seg_end, k.peak, min(i.a) AS a, max(i.b) AS b FROM ("
    "SELECT g.series_id, seg_start, seg_end, arg_min(s.t, (-s.v, s.t)) AS peak FROM sg g JOIN lv s ON s.series_id = g.series_id AND s.t >= seg_start - 5 AND s.t < seg_end + 5 GROUP BY 1, 2, 3) k "
    "LEFT JOIN isl i ON i.series_id = k.series_id AND i.a <= k.peak + 1 AND i.b >= k.peak GROUP BY 1, 2, 3, 4) WHERE greatest(peak + 1, coalesce(b, peak)) - least(peak, coalesce(a, peak)) >= 3", "sg", "lv", "isl"))  # fmt: skip
def _(s, d):
    p = points(s, d)
    return S.refine_ranges(S.extract_segments(predicted(p)), S.derived_signals(p), D.series_lengths(p), 5, 0.2)


@query("ranges_to_scores", sql("SELECT series_id, t, CAST(pred AS DOUBLE) AS score FROM pr", "pr"))
def _(s, d):
    p = points(s, d)
    return S.ranges_to_scores(S.extract_segments(predicted(p)), p)


# --- thresholds, segments ---------------------------------------------------------


@query("thr_percentile", sql(f"SELECT series_id, {r6('quantile_cont(score, 0.95)')} AS threshold FROM sc GROUP BY 1", "sc"))
def _(s, d):
    return S.percentile_threshold(scored(points(s, d)))


@query("thr_fixed", sql("SELECT DISTINCT series_id, CAST(0.5 AS DOUBLE) AS threshold FROM sc", "sc"))
def _(s, d):
    return S.fixed_threshold(scored(points(s, d)))


@query("thr_deviation", sql(f"SELECT series_id, {r6('avg(score) + 3 * stddev_pop(score)')} AS threshold FROM sc GROUP BY 1", "sc"))
def _(s, d):
    return S.deviation_threshold(scored(points(s, d)))


_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"
_COUNTED = "SELECT c.series_id, c.k, any_value(c.threshold) AS threshold, CASE WHEN count(*) FILTER (score >= threshold) > 0 THEN (count(*) FILTER (score >= threshold AND y = 1)) / (count(*) FILTER (score >= threshold)) ELSE 1 END AS p, CASE WHEN sum(y) > 0 THEN (count(*) FILTER (score >= threshold AND y = 1)) / sum(y) ELSE 1 END AS r FROM cand c JOIN sc USING (series_id) GROUP BY 1, 2"


@query("thr_f1", sql(f"SELECT series_id, {r6('CASE WHEN f > 0 THEN threshold ELSE 0 END')} AS threshold, {r6('f')} AS f1 FROM (SELECT *, {_F1} AS f FROM ({_COUNTED})) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY f DESC, k) = 1", "sc", "cand"))
def _(s, d):
    return S.f1_threshold(scored(points(s, d)))


@query("predict", sql("SELECT series_id, t, CAST(score >= h AS INT) AS pred FROM sc JOIN (SELECT series_id, quantile_cont(score, 0.95) AS h FROM sc GROUP BY 1) USING (series_id)", "sc"))
def _(s, d):
    p = scored(points(s, d))
    return S.predict(p, S.percentile_threshold(p)).select("series_id", "t", "pred")


@query("segments", sql("SELECT series_id, seg_start, seg_end FROM sg", "sg"))
def _(s, d):
    return S.extract_segments(predicted(points(s, d)))


@query("seg_filter", sql("SELECT series_id, seg_start, seg_end FROM sg WHERE seg_end - seg_start >= 2", "sg"))
def _(s, d):
    return S.drop_short(S.extract_segments(predicted(points(s, d))), 2)


_MERGED = "SELECT series_id, CAST(min(seg_start) AS INT) AS seg_start, CAST(max(seg_end) AS INT) AS seg_end FROM (SELECT *, sum(o) OVER (PARTITION BY series_id ORDER BY seg_start ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN seg_start - lag(seg_end) OVER (PARTITION BY series_id ORDER BY seg_start) <= 3 THEN 0 ELSE 1 END AS o FROM sg WHERE_LENGTH)) GROUP BY series_id, g"


@query("seg_merge", sql(_MERGED.replace(" WHERE_LENGTH", ""), "sg"))
def _(s, d):
    return S.merge_close(S.extract_segments(predicted(points(s, d))), 3)


@query("postprocess", sql(_MERGED.replace("WHERE_LENGTH", "WHERE seg_end - seg_start >= 2"), "sg"))
def _(s, d):
    p = scored(points(s, d))
    return S.postprocess(p, S.fixed_threshold(p, 75.0), 2, 3)


_MOMENTS = "SELECT series_id, win, avg(power(x - mu, 2)) AS m2, avg(power(x - mu, 3)) AS m3, avg(power(x - mu, 4)) AS m4 FROM (SELECT *, avg(x) OVER (PARTITION BY series_id, win) AS mu FROM wp) GROUP BY 1, 2"


@query("window_shape", sql(f"SELECT series_id, win, {r6('m3 / power(m2, 1.5)')} AS skewness, {r6('m4 / (m2 * m2) - 3')} AS kurtosis FROM ({_MOMENTS})", "wp"))
def _(s, d):
    return E.shape(W.window_points(points(s, d), WIDTH, STEP))


@query("score_ranks", sql(f"SELECT series_id, win, score, {r6('percent_rank() OVER (PARTITION BY series_id ORDER BY score)')} AS percent_rank FROM (SELECT series_id, win, {r6('score')} AS score FROM ws)", "ws"))
def _(s, d):
    scores = window_scores(points(s, d))
    return S.percent_ranks(scores.select("series_id", "win", (F.round("score", 6) + 0.0).alias("score")))


_RANKED = "SELECT config, v, rank() OVER (PARTITION BY category ORDER BY v) + (count(*) OVER (PARTITION BY category, v) - 1) / 2.0 AS r FROM (SELECT category, config, avg(f1) AS v FROM runs GROUP BY 1, 2)"


@query("friedman", sql(f"SELECT config, {r6('m')} AS mean_rank, n, {r6('12 * n / 30.0::DOUBLE * sum(power(m - 3, 2)) OVER ()')} AS chi2 FROM (SELECT config, CAST(avg(r) AS DOUBLE) AS m, count(*) AS n FROM ({_RANKED}) GROUP BY 1)", "runs"))
def _(s, d):
    return R.friedman(runs(s, d), "f1")


_SIGNED = "SELECT d, CAST(rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS DOUBLE) AS r FROM (SELECT avg(f1) FILTER (config = '1-URGENT') - avg(f1) FILTER (config = '5-LOW') AS d FROM runs GROUP BY category) WHERE d <> 0"


@query("wilcoxon", sql(f"SELECT n, p AS w_plus, m AS w_minus, {r6('(p - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24)')} AS z FROM (SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS p, coalesce(sum(r) FILTER (d < 0), 0) AS m FROM ({_SIGNED}))", "runs"))
def _(s, d):
    return R.wilcoxon(runs(s, d), "f1", "1-URGENT", "5-LOW")


@query("report_summary", sql("SELECT n_runs, n_categories, c.config, c.n AS config_runs, " + r6("c.f1") + " AS f1 FROM (SELECT count(*) AS n_runs, count(DISTINCT category) AS n_categories FROM runs), (SELECT config, count(*) AS n, avg(f1) AS f1 FROM runs GROUP BY 1) c", "runs"))
def _(s, d):
    one = R.summary(runs(s, d), ["f1"]).select("n_runs", "n_categories", F.explode("configs").alias("c"))
    return one.select("n_runs", "n_categories", "c.config", F.col("c.n_runs").alias("config_runs"), "c.f1")


# --- evaluation -------------------------------------------------------------------

_CONF = "SELECT series_id, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM pr GROUP BY 1"
_PR = f"SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS r FROM ({_CONF})"


@query("confusion_by_series", sql(_CONF, "pr"))
def _(s, d):
    return M.confusion(predicted(points(s, d)))


@query("prec_recall", sql(f"SELECT series_id, {r6('p')} AS precision, {r6('r')} AS recall FROM ({_PR})", "pr"))
def _(s, d):
    return M.point_metrics(predicted(points(s, d))).select("series_id", "precision", "recall")


@query("f1", sql(f"SELECT series_id, {r6(_F1)} AS f1 FROM ({_PR})", "pr"))
def _(s, d):
    return M.point_metrics(predicted(points(s, d))).select("series_id", "f1")


_OVER = "p.series_id = t.series_id AND p.seg_start < t.seg_end AND t.seg_start < p.seg_end"


@query("pa_f1", sql(
    f"SELECT series_id, n_true, n_pred, {r6('CASE WHEN n_true = 0 AND n_pred = 0 THEN 1 WHEN n_true = 0 OR n_pred = 0 THEN 0 ELSE ' + _F1 + ' END')} AS pa_f1 FROM (SELECT *, hit_p / n_pred AS p, hit_t / n_true AS r FROM ("
    f"SELECT series_id, (SELECT count(*) FROM sy t WHERE t.series_id = l.series_id) AS n_true, (SELECT count(*) FROM sg p WHERE p.series_id = l.series_id) AS n_pred, (SELECT count(*) FROM (SELECT DISTINCT t.series_id, t.seg_start FROM sy t JOIN sg p ON {_OVER}) z WHERE z.series_id = l.series_id) AS hit_t, (SELECT count(*) FROM (SELECT DISTINCT p.series_id, p.seg_start FROM sy t JOIN sg p ON {_OVER}) z WHERE z.series_id = l.series_id) AS hit_p FROM (SELECT DISTINCT series_id FROM pr) l))", "sg", "sy"))  # fmt: skip
def _(s, d):
    return M.segment_f1(predicted(points(s, d)))


@query("pr_auc", sql(
    f"SELECT series_id, {r6('least(1, greatest(0, sum((r - pr) * (p + pp) / 2)))')} AS pr_auc FROM (SELECT *, lag(r) OVER w AS pr, lag(p) OVER w AS pp FROM ({_COUNTED.replace('cand c', 'lin c')}) WINDOW w AS (PARTITION BY series_id ORDER BY r, k DESC)) GROUP BY 1", "sc", "lin"))
def _(s, d):
    return M.pr_area(scored(points(s, d)))


@query("overlap_class", sql(
    f"SELECT series_id, n_found, n_true, overlap, CASE WHEN n_true = 0 AND n_found = 0 THEN 'true_negative' WHEN n_true = 0 THEN 'false_positive' WHEN overlap > 0 THEN 'partial_match' WHEN n_found > 0 THEN 'missed' ELSE 'no_anomalies' END AS class FROM (SELECT series_id, (SELECT count(*) FROM sg p WHERE p.series_id = l.series_id) AS n_found, (SELECT count(*) FROM sy t WHERE t.series_id = l.series_id) AS n_true, (SELECT coalesce(sum(least(p.seg_end, t.seg_end) - greatest(p.seg_start, t.seg_start)), 0)::BIGINT FROM sy t JOIN sg p ON {_OVER} WHERE t.series_id = l.series_id) AS overlap FROM (SELECT DISTINCT series_id FROM pr) l)", "sg", "sy"))
def _(s, d):
    p = predicted(points(s, d))
    return M.classify_ranges(S.extract_segments(p), p)


@query("signal_diagnostics", sql(f"SELECT series_id, {r6('max(cusum)')} AS max_cusum, CAST(arg_min(t, (-cusum, t)) AS INT) AS argmax_cusum, {r6('avg(abs(rmdev)) FILTER (y = 1)')} AS mean_rmdev_in, {r6('avg(abs(rmdev)) FILTER (y = 0)')} AS mean_rmdev_out FROM sig GROUP BY 1", "sig"))
def _(s, d):
    return M.signal_diagnostics(S.derived_signals(points(s, d)))


@query("score_profile", sql(f"SELECT series_id, {r6('min(score)')} AS min, {r6('max(score)')} AS max, {r6('avg(score)')} AS mean, count(DISTINCT score) AS n_distinct FROM sc GROUP BY 1", "sc"))
def _(s, d):
    return M.score_profile(scored(points(s, d)))


@query("series_records")
def _(s, d):
    p = points(s, d)
    rows = predicted(p)
    return M.series_records(rows, S.extract_segments(rows), window_scores(p)).select("series_id", F.to_json(F.struct("tp", "fp", "fn", "f1", "segments", "more_segments", "top_windows")).alias("record"))


# --- reports ----------------------------------------------------------------------


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("config"), F.col("o_orderstatus").alias("category"), F.col("o_totalprice").alias("f1"), (F.col("o_orderkey") % 97 / 97).alias("pa_f1"), (F.col("o_custkey") % 11).cast("double").alias("time_s"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("pivot_report", sql("SELECT category, " + ", ".join(f"{r6(f'''avg(f1) FILTER (config = '{c}')''')} AS \"{c}\"" for c in PRIORITIES) + " FROM runs GROUP BY 1", "runs"))
def _(s, d):
    return R.pivot_metric(runs(s, d), "f1", PRIORITIES)


@query("group_report", sql("SELECT config, round(avg(f1), 3) AS f1, round(avg(pa_f1), 3) AS pa_f1, round(sum(time_s), 3) AS time_s, count(*) AS n FROM runs GROUP BY 1", "runs"))
def _(s, d):
    return R.by_config(runs(s, d), ["f1", "pa_f1"])


@query("best_worst", sql(f"SELECT {r6('avg(m)')} AS mean, arg_min(config, (-m, config)) AS best, arg_min(config, (m, config)) AS worst FROM (SELECT config, avg(f1) AS m FROM runs GROUP BY 1)", "runs"))
def _(s, d):
    return R.best_and_worst(runs(s, d).groupBy("config").agg(F.avg("f1").alias("m")), "m", "config")


@query("concat_results", sql("SELECT config, count(*) AS n FROM (SELECT * FROM runs UNION ALL SELECT * FROM runs WHERE config = '5-LOW') GROUP BY 1", "runs"))
def _(s, d):
    r = runs(s, d)
    return R.concat_results([r, R.only_configs(r, ["5-LOW"])]).groupBy("config").agg(F.count(F.lit(1)).alias("n"))


# --- reasoning --------------------------------------------------------------------


@query("prefilter_merge", sql(f"SELECT series_id, win, {r6('CASE WHEN score >= h THEN 0.9 WHEN b > a THEN (score - a) / (b - a) * 0.3 ELSE 0 END')} AS score FROM ws JOIN (SELECT series_id, quantile_cont(score, 0.8) AS h, min(score) AS a, max(score) AS b FROM ws GROUP BY 1) USING (series_id)", "ws"))
def _(s, d):
    marked = suspicious(window_scores(points(s, d)))
    return merge_verdicts(marked, marked.where("suspicious").select("series_id", "win", F.lit(0.9).alias("confidence")))


@query("contrast_windows", sql(f"SELECT series_id, win, {r6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score, win) AS r FROM ws JOIN (SELECT series_id, quantile_cont(score, 0.8) AS h FROM ws GROUP BY 1) USING (series_id) WHERE score < h) WHERE r <= 3", "ws"))
def _(s, d):
    return contrast(suspicious(window_scores(points(s, d)))).select("series_id", "win", "score")


@query("json_parse_windows", "SELECT event_id, CAST(event_id % 4 <> 3 AS INT) AS n_verdicts, CASE WHEN event_id % 4 <> 3 THEN least(CAST(1 AS DOUBLE), CAST(json_extract(props, '$.k') AS DOUBLE) / 50) END AS confidence, event_id % 4 = 3 AS parse_error FROM events")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    body = F.format_string('{"results": [{"window_index": 0, "is_anomaly": true, "confidence": %s, "reasoning": "", "evidence_cited": []}]}', (F.col("k") / 50).cast("string"))
    kind = F.col("event_id") % 4
    reply = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("I think "), body, F.lit(" fits."))).otherwise("no idea")
    out = L.parse_windows(e.select("event_id", reply.alias("reply")))
    return out.select("event_id", F.size("verdicts").alias("n_verdicts"), F.try_element_at("verdicts", F.lit(1))["confidence"].alias("confidence"), "parse_error")


@query("json_parse_ranges", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 1 END AS n_ranges, CASE WHEN event_id % 3 <> 2 THEN CAST(json_extract(props, '$.k') AS INT) END AS start, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS INT) + 1 WHEN event_id % 3 = 1 THEN CAST(json_extract(props, '$.k') AS INT) + 5 END AS end FROM events")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.col("event_id") % 3
    one = F.format_string('{"anomalies": [{"start": %d, "end": %d}]}', "k", "k")
    bare = F.format_string('```\n[{"start": %d, "end": %d}]\n```', "k", F.col("k") + 5)
    gone = F.format_string('{"anomalies": [{"start": %d, "end": %d}]}', F.col("k") + 9, "k")
    out = L.parse_ranges(e.select("event_id", F.when(kind == 0, one).when(kind == 1, bare).otherwise(gone).alias("reply")))
    first = F.try_element_at("ranges", F.lit(1))
    return out.select("event_id", F.size("ranges").alias("n_ranges"), first["start"].alias("start"), first["end"].alias("end"))


@query("baseline_averages", sql(f"SELECT series_id, {r6('greatest(avg(z), 1e-10)')} AS max_abs_z_score_avg, {r6('greatest(avg(v), 1e-10)')} AS volatility_ratio_avg FROM ev GROUP BY 1", "ev"))
def _(s, d):
    p = points(s, d)
    w, stats = W.window_points(p, WIDTH, STEP), plain_stats(p)
    return P.baseline_averages(E.gather([E.z_scores(w, stats), E.volatility(w, stats)]))


@query("channels", sql(f"SELECT s.series_id, t, {r6('(x - a) / (b - a) * 10')} AS r, {r6('least(10, greatest(0, cusum / std))')} AS c, {r6('least(10, greatest(0, 5 + 2.5 * rmdev / std))')} AS m FROM sig s JOIN (SELECT series_id, min(x) AS a, max(x) AS b FROM pts GROUP BY 1) USING (series_id)", "sig"))
def _(s, d):
    return P.channels(S.derived_signals(points(s, d)))


@query("prompt_text", sql("SELECT series_id, win, 'z ' || printf('%.3f', z) || CASE WHEN z > 2 THEN ' high' ELSE '' END AS line FROM ev", "ev"))
def _(s, d):
    p = points(s, d)
    z = E.z_scores(W.window_points(p, WIDTH, STEP), plain_stats(p))
    return z.select("series_id", "win", F.concat(F.lit("z "), P.decimals(F.col("max_abs_z_score"), 3), F.when(F.col("max_abs_z_score") > 2, " high").otherwise("")).alias("line"))


@query("evidence_status", sql("SELECT series_id, win, 'normal' AS forecast_status, CASE WHEN z > 3 THEN 'unusual' ELSE 'normal' END AS test_status, 'similar' AS distribution_status, CASE WHEN v > 5 THEN 'extreme' WHEN v > 2 THEN 'high' ELSE 'normal' END AS pattern_status FROM ev", "ev"))
def _(s, d):
    p = points(s, d)
    w, stats = W.window_points(p, WIDTH, STEP), plain_stats(p)
    return P.status(E.gather([E.z_scores(w, stats), E.volatility(w, stats)]))


@query("window_prompts")
def _(s, d):
    p = points(s, d)
    w, stats = W.window_points(p, WIDTH, STEP), plain_stats(p)
    found = E.gather([E.z_scores(w, stats), E.cusum(w, stats), E.volatility(w, stats)])
    texts = P.relative_evidence(found, P.baseline_averages(found))
    return P.batch_prompts(P.window_prompts(W.create_windows(p, WIDTH, STEP), texts))


@query("range_prompts")
def _(s, d):
    p = points(s, d)
    return P.range_prompts(S.derived_signals(p), S.range_cap(D.series_lengths(p), 0.005, 3), P.evidence_hints(window_scores(p), WIDTH, STEP))


_CTES |= {
    "cv": "SELECT *, CASE WHEN t = 0 THEN CAST(0 AS DOUBLE) ELSE x - mean - 0.5 * std END AS ua, CASE WHEN t = 0 THEN CAST(0 AS DOUBLE) ELSE mean - x - 0.5 * std END AS ub FROM cu1",
    "cw": "SELECT *, sum(ua) OVER w AS va, sum(ub) OVER w AS vb FROM cv WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)",
    "cx": "SELECT series_id, t, round(least(10, greatest(va - min(va) OVER w, vb - min(vb) OVER w) / std), 1) AS c FROM cw WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)",
}
_NEEDS |= {"cv": ["cu1"], "cw": ["cv"], "cx": ["cw"]}


@query("ask_ranges", sql(f"SELECT series_id, CAST(min(t) AS INT) AS seg_start, CAST(max(t) + 1 AS INT) AS seg_end FROM (SELECT series_id, t, t // {P.PROMPT_POINTS} AS part, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM cx WHERE c >= 5) GROUP BY series_id, part, g", "cx"))
def _(s, d):
    p = points(s, d)
    prompts = P.range_prompts(S.derived_signals(p, 0.5), S.range_cap(D.series_lengths(p), 0.005, 3))
    return L.range_rows(L.parse_ranges(ask_ranges(prompts, RuleBackend())))


@query("llm_window_scores")
def _(s, d):
    p = points(s, d)
    w, stats = W.window_points(p, WIDTH, STEP), plain_stats(p)
    return window_reasoning(p, window_scores(p), E.gather([E.z_scores(w, stats), E.volatility(w, stats)]), RuleBackend(), WIDTH, STEP)


@query("llm_range_scores")
def _(s, d):
    p = points(s, d)
    return range_reasoning(p, window_scores(p), RuleBackend(), WIDTH, STEP)


# --- end to end -------------------------------------------------------------------


@query("e2e_knn", sql(
    "SELECT s.series_id, seg_start, seg_end FROM (SELECT series_id, CAST(min(t) AS INT) AS seg_start, CAST(max(t) + 1 AS INT) AS seg_end FROM (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM ps JOIN (SELECT series_id, quantile_cont(score, 0.95) AS h FROM ps GROUP BY 1) USING (series_id) WHERE score >= h) GROUP BY series_id, g) s", "ps"))
def _(s, d):
    """Scale, nearest neighbours, max pooling, 95th percentile, segments."""
    train, test = train_and_test(points(s, d))
    return Pipeline(WIDTH, STEP).fit(train).predict(test).segments


@query("e2e_evidence")
def _(s, d):
    train, test = train_and_test(points(s, d))
    p = Pipeline(WIDTH, STEP, detection="evidence", scoring="average", least=3, gap=5, categories=("forecast_based", "statistical_tests", "pattern_based")).fit(train)
    return p.evaluate(p.predict(test))


def _on_scores(body: str, *ctes: str) -> str:
    """A query on the end-to-end scores instead of the plain ones."""
    return sql(body, "ps", *ctes).replace(f"sc AS ({_CTES['sc']})", "sc AS (SELECT series_id, t, y, score FROM ps JOIN te USING (series_id, t))").replace(
        f"pr AS ({_CTES['pr']})", "pr AS (SELECT s.series_id, s.t, s.y, s.score, CAST(s.score >= h.threshold AS INT) AS pred FROM sc s JOIN bt h USING (series_id))"
    )


_CTES["bt"] = f"SELECT series_id, CASE WHEN f > 0 THEN threshold ELSE 0 END AS threshold FROM (SELECT *, {_F1} AS f FROM ({_COUNTED})) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY f DESC, k) = 1"
_NEEDS["bt"] = ["sc", "cand"]
_EVALUATED = (
    f"SELECT a.series_id, tp, fp, fn, tn, {r6('p')} AS precision, {r6('r')} AS recall, {r6(_F1)} AS f1, n_true, n_pred, pa_f1, pr_auc FROM ({_PR}) a JOIN (" + _SQL["pa_f1"][_SQL["pa_f1"].index("SELECT series_id, n_true, n_pred") :] + ") b USING (series_id) JOIN ("
    + _SQL["pr_auc"][_SQL["pr_auc"].index("SELECT series_id, round(least(1") :] + ") c USING (series_id)"
)


@query("e2e_config", _on_scores(_EVALUATED, "bt", "pr", "sg", "sy", "lin"))
def _(s, d):
    train, test = train_and_test(points(s, d))
    config = {"data_processing": {"type": "RawWindowProcessor", "window_size": 20, "stride": 10}, "detection": {"type": "DistanceBasedDetection", "params": {"k": 5}}, "scoring": {"type": "MaxPoolingScoring"}, "postprocessing": {"threshold": {"type": "F1OptimalThreshold"}, "min_anomaly_length": 1, "merge_gap": 0}}
    p = build_pipeline(config).fit(train)
    return p.evaluate(p.predict(test))


@query("e2e_stl_range")
def _(s, d):
    train, test = train_and_test(D.daily_shipments(s, d))
    p = Pipeline(WIDTH, STEP, processing="stl", detection="evidence", scoring="range", threshold="fixed", least=3, gap=5, period=7, categories=("forecast_based", "statistical_tests")).fit(train)
    return p.predict(test).point_scores


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
