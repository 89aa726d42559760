"""Benchmark reports and result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def concat_results(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pivot_metric(runs: DataFrame, metric: str, configs: list[str]) -> DataFrame:
    """Category by configuration, mean of a metric."""
    return runs.groupBy("category").pivot("config", configs).agg(F.avg(metric))


def by_config(runs: DataFrame, metrics: list[str], digits: int = 3) -> DataFrame:
    means = [F.round(F.avg(m), digits).alias(m) for m in metrics]
    return runs.groupBy("config").agg(*means, F.round(F.sum("time_s"), digits).alias("time_s"), F.count(F.lit(1)).alias("n"))


def best_and_worst(runs: DataFrame, metric: str, label: str) -> DataFrame:
    """Mean of a metric and the labels of its extremes; ties go to the first label."""
    best = F.min_by(label, F.struct(-F.col(metric), F.col(label)))
    worst = F.min_by(label, F.struct(F.col(metric), F.col(label)))
    return runs.agg(F.avg(metric).alias("mean"), best.alias("best"), worst.alias("worst"))


def only_configs(runs: DataFrame, configs: list[str], keep: bool = True) -> DataFrame:
    named = F.col("config").isin(configs)
    return runs.where(named if keep else ~named)


def _average_rank(by: list[str], value: str) -> Column:
    """Ranks from 1 by value; equal values share the mean of their places."""
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def friedman(runs: DataFrame, metric: str) -> DataFrame:
    """Friedman's test over the categories that all configurations ran: mean rank of each, and ``chi2``."""
    cells = runs.groupBy("category", "config").agg(F.avg(metric).alias("v"))
    k = cells.select(F.countDistinct("config").alias("k"))
    full = cells.join(cells.groupBy("category").agg(F.count(F.lit(1)).alias("c")), "category").crossJoin(F.broadcast(k)).where("c = k")
    ranks = full.withColumn("r", _average_rank(["category"], "v")).groupBy("config", "k").agg(F.avg("r").alias("mean_rank"), F.count(F.lit(1)).alias("n"))
    spread = F.sum((F.col("mean_rank") - (F.col("k") + 1) / 2) ** 2).over(Window.partitionBy("k"))
    return ranks.select("config", "mean_rank", "n", (12 * F.col("n") / (F.col("k") * (F.col("k") + 1)) * spread).alias("chi2"))


def wilcoxon(runs: DataFrame, metric: str, first: str, second: str) -> DataFrame:
    """Wilcoxon's signed ranks of two configurations over categories: ``n`` that differ, ``w_plus``, ``w_minus`` and the normal score ``z``."""
    cells = runs.where(F.col("config").isin(first, second)).groupBy("category").pivot("config", [first, second]).agg(F.avg(metric))
    d = cells.select("category", (F.col(f"`{first}`") - F.col(f"`{second}`")).alias("d")).where("d <> 0").withColumn("size", F.abs("d")).withColumn("all", F.lit(0))
    ranked = d.withColumn("r", _average_rank(["all"], "size"))
    sums = ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))
    n = F.col("n")
    return sums.withColumn("z", F.when(n > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object per line."""
    rows.write.mode("overwrite").json(path)


def summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for a summary document: numbers of runs and of categories, and per configuration the means of its metrics."""
    means = runs.groupBy("config").agg(F.count(F.lit(1)).alias("n_runs"), *[F.avg(m).alias(m) for m in metrics])
    each = F.sort_array(F.collect_list(F.struct("config", "n_runs", *metrics))).alias("configs")
    return means.agg(each).crossJoin(F.broadcast(runs.agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct("category").alias("n_categories")))).select("n_runs", "n_categories", "configs")


def write_summary(runs: DataFrame, metrics: list[str], path: str) -> None:
    """The summary as one JSON document."""
    summary(runs, metrics).coalesce(1).write.mode("overwrite").json(path)
