"""Distances to nearest neighbours.

The candidates of a query are the reference rows of its own group (a series).
Exact search is a grid of blocks: the queries and the references of a group are
dealt by hash into blocks of bounded size, and each pair of blocks is a task's
cell, however large the group is. A cell is one matrix product; of what it
leaves near the k-th place the distances are computed anew, so rounding decides
nothing. Each cell keeps its k best per query, and these meet in a second small
step.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.sources.tables import settle

# What a cell calls travels with it, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block of queries and of references, and queries of one matrix product.
QUERY_BLOCK, REFERENCE_BLOCK, PRODUCT_ROWS = 4096, 8192, 512
#: Pairs whose distances are computed anew at once.
_PAIRS = 1 << 18


def squared_distance(a: Column, b: Column) -> Column:
    """Of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one size as rows."""
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(values), -1)


def _exact(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Euclidean distance, or less the cosine, of paired rows."""
    if metric == "euclidean":
        return np.sqrt(((q - r) ** 2).sum(axis=1))
    return -(q * r).sum(axis=1) / np.sqrt((q * q).sum(axis=1) * (r * r).sum(axis=1))


def nearest_in(q: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int, metric: str, hashes: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of ``r`` for each row of ``q`` (ties to the smaller id): row of q, row of r, distance.

    ``hashes``: of both; only rows that agree in some column of them are compared.
    """
    if metric == "euclidean":
        # Distances do not change with the origin, and small numbers round less.
        centre = r.mean(axis=0)
        a, b = q - centre, r - centre
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    else:
        with np.errstate(invalid="ignore", divide="ignore"):
            a, b = (np.nan_to_num(x / np.sqrt((x * x).sum(axis=1, keepdims=True))) for x in (q, r))
        aa, bb = np.zeros(len(q)), np.zeros(len(r))
    out = []
    for low in range(0, len(q), PRODUCT_ROWS):
        some = slice(low, low + PRODUCT_ROWS)
        near = aa[some, None] + bb[None, :] - (2 if metric == "euclidean" else 1) * (a[some] @ b.T)
        spare = 1e-9 * (1 + aa[some, None] + bb.max(initial=0))
        if hashes is not None:
            apart = np.logical_and.reduce([x[some, None] != y[None, :] for x, y in zip(hashes[0].T, hashes[1].T, strict=True)])
            near[apart] = np.inf
        last = np.partition(near, min(k, len(r)) - 1, axis=1)[:, [min(k, len(r)) - 1]]
        qs, rs = np.nonzero((near <= last + spare) & (near < np.inf) if hashes is not None else near <= last + spare)
        d = np.concatenate([_exact(q[low + qs[x : x + _PAIRS]], r[rs[x : x + _PAIRS]], metric) for x in range(0, len(qs), _PAIRS)])
        order = np.lexsort((ids[rs], d, qs))
        qs, rs, d = qs[order], rs[order], d[order]
        first = np.searchsorted(qs, qs)
        best = np.arange(len(qs)) - first < k
        out.append((low + qs[best], rs[best], d[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(queries: DataFrame, references: DataFrame, k: int, group: list[str], query_id: str, reference_id: str, metric: str = "euclidean", hashes: str | None = None) -> DataFrame:
    """The k nearest references (``values``) of each query: group, ``qid``, ``rid``, distance ``d``, ``rank``. Ties go to the smaller reference id.

    ``metric``: ``euclidean``, or ``cosine`` (then ``d`` is less the similarity).
    Vectors of a group have one size; a null vector is left out. ``hashes``: a
    column of arrays; a query is compared only with references that agree with it at some place of them.
    """

    def dealt(rows: DataFrame, key: str, name: str, most: int) -> DataFrame:
        rows = settle(rows.where("values is not null").select(*group, F.col(key).alias(name), "values", *([F.col(hashes).alias("hashes")] if hashes else [])), "vectors")
        sizes = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
        return rows, sizes

    q, q_sizes = dealt(queries, query_id, "qid", QUERY_BLOCK)
    r, r_sizes = dealt(references, reference_id, "rid", REFERENCE_BLOCK)
    grid = settle(q_sizes.withColumnRenamed("blocks", "nq").join(r_sizes.withColumnRenamed("blocks", "nr"), group), "grid")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(grid, group).withColumn("i", F.pmod(F.xxhash64("qid"), "nq").cast("int")).withColumn("j", every("nr")).drop("nq", "nr")
    r = r.join(grid, group).withColumn("j", F.pmod(F.xxhash64("rid"), "nr").cast("int")).withColumn("i", every("nq")).drop("nq", "nr")
    kinds = ", ".join([*[f"`{g}` {queries.schema[g].dataType.simpleString()}" for g in group], f"qid {queries.schema[query_id].dataType.simpleString()}", f"rid {references.schema[reference_id].dataType.simpleString()}", "d double"])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*group, "qid"]
        if not len(left) or not len(right):
            empty = left.slice(0, 0).select(names) if len(left.schema.names) else right.slice(0, 0)
            return empty.append_column("rid", right.slice(0, 0)["rid"]).append_column("d", pa.array([], pa.float64()))
        ids = right["rid"].combine_chunks()
        order = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        agree = tuple(_matrix(x["hashes"]).astype(np.int64) for x in (left, right)) if hashes else None
        qs, rs, d = nearest_in(_matrix(left["values"]), _matrix(right["values"]), order, k, metric, agree)
        return left.select(names).take(pa.array(qs)).append_column("rid", ids.take(pa.array(rs))).append_column("d", pa.array(d))

    cells = [*group, "i", "j"]
    found = q.groupBy(*cells).cogroup(r.groupBy(*cells)).applyInArrow(cell, kinds)
    order = Window.partitionBy(*group, "qid").orderBy("d", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_scores(test: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """Mean Euclidean distance of each test window to its k nearest training windows of the series."""
    found = nearest(test, train, k, ["series_id"], "win", "win")
    return found.groupBy("series_id", F.col("qid").alias("win")).agg(F.avg("d").alias("score"), F.count("d").alias("k"))


def lsh_knn_scores(test: DataFrame, train: DataFrame, k: int = 5, width: float = 4.0, tables: int = 8, seed: int = 3) -> DataFrame:
    """Approximate scores: only windows that share a random-projection bucket in some table are candidates.

    A series is searched bucket by bucket; where its buckets are so wide that
    they hold more pairs than the series, each pair of it is looked at once
    instead, and those without a shared bucket are left out. Pairs are never
    rows, so wide buckets cost no more than the exact search. A query that
    meets fewer than k training windows is searched exactly.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    test, train = (settle(df.where("values is not null").select("series_id", "win", "values"), "windows") for df in (test, train))
    vector = lambda df: df.withColumn("features", array_to_vector("values"))
    if train.isEmpty():
        return knn_scores(test, train, k)
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(vector(train))
    hashed = F.array(*[vector_to_array(F.col("h")[i])[0].cast("long") for i in range(tables)])
    a, b = (settle(model.transform(vector(df)).select("series_id", "win", "values", hashed.alias("hashes")), "hashed") for df in (test, train))

    def sizes(df: DataFrame, name: str) -> DataFrame:
        # The whole series is bucket 0 of table -1.
        every = df.select("series_id", F.posexplode("hashes").alias("table", "b")).unionByName(df.select("series_id", F.lit(-1).alias("table"), F.lit(0).cast("long").alias("b")))
        return every.groupBy("series_id", "table", "b").agg(F.count(F.lit(1)).cast("double").alias(name))

    pairs = sizes(a, "nq").join(sizes(b, "nr"), ["series_id", "table", "b"]).withColumn("n", F.col("nq") * F.col("nr"))
    whole = pairs.groupBy("series_id").agg((F.sum(F.when(F.col("table") >= 0, F.col("n"))) > F.sum(F.when(F.col("table") < 0, F.col("n")))).alias("whole"))
    whole = settle(whole, "whole")

    def dealt(df: DataFrame) -> DataFrame:
        some = df.join(whole, "series_id")
        by_bucket = some.where("not whole").select("series_id", "win", "values", "hashes", F.posexplode("hashes").alias("table", "b"))
        return by_bucket.unionByName(some.where("whole").select("series_id", "win", "values", "hashes", F.lit(-1).alias("table"), F.lit(0).cast("long").alias("b")))

    found = nearest(dealt(a), dealt(b), k, ["series_id", "table", "b"], "win", "win", hashes="hashes")
    # The nearest of all candidates are among the nearest in each of their buckets; a pair may share several.
    d = found.groupBy("series_id", F.col("qid").alias("win"), "rid").agg(F.min("d").alias("d"))
    order = Window.partitionBy("series_id", "win").orderBy("d", "rid")
    near = d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    scores = settle(near.groupBy("series_id", "win").agg(F.avg("d").alias("score"), F.count("d").alias("k")).where(F.col("k") == k), "scores")
    lacking = test.join(scores, ["series_id", "win"], "left_anti")
    return scores.unionByName(knn_scores(lacking, train, k))


def retrieve(queries: DataFrame, library: DataFrame, k: int, label: str | None = None) -> DataFrame:
    """The k library vectors most similar by cosine to each query (``id, values``); only those with equal ``label``, if one is named."""
    group = [label] if label else []
    q = queries if label else queries.withColumn("__all", F.lit(0))
    r = library if label else library.withColumn("__all", F.lit(0))
    found = nearest(q, r, k, group or ["__all"], "id", "id", "cosine")
    return found.select(F.col("qid").alias("query_id"), F.col("rid").alias("id"), "rank", (-F.col("d")).alias("similarity"))
