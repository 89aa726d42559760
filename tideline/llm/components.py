"""Connected components by contracting within tasks, then among the smallest nodes that tasks found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.store import discard, materialize, tidy
from tideline.llm.words import mix

#: Edges that a task holds at once.
MOST_EDGES = 500_000


def stars(u: np.ndarray, v: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, each with the first node of its component: the smallest, or by hash if there is a salt."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    if salt:
        order = np.argsort(mix(nodes.view(np.uint64) ^ np.uint64(salt)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        nodes, at = nodes[order], place[at]
    first, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while True:
        p, q = first[a], first[b]
        apart = p != q
        if not apart.any():
            return nodes, nodes[first]
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(first, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(after := first[first], first):
            first = after


def _contracted(edges: DataFrame, salt: int) -> DataFrame:
    """Each task's edges as stars around its first nodes, which also get a row (``u`` = ``v``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

        def out(rows: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["u", "v"])

        for batch in batches:
            held.append(tuple(x.to_numpy(zero_copy_only=False) for x in batch.columns))
            n += batch.num_rows
            if n >= MOST_EDGES:
                star = stars(*(np.concatenate(x) for x in zip(*held, strict=True)), salt)
                held, n = [star], len(star[0])
                if n >= MOST_EDGES // 2:
                    yield out(star)
                    held, n = [], 0
        if held:
            yield out(stars(*(np.concatenate(x) for x in zip(*held, strict=True)), salt))

    return edges.mapInArrow(tidy(run), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of an edge (``u``, ``v``, both long) that is not itself the smallest of its component.

    A task contracts its edges to stars. A node that is in several tasks' stars
    links their centres; nodes that are no centre are then settled but for
    where their smallest centre belongs. The links among centres, mostly few,
    are contracted the same way, until there are none. Should fewer than half
    of the nodes be settled at once, as in long chains spread over many tasks,
    the next centres are chosen by hash, which settles a share of any chain.
    """
    return _level(edges.select("u", "v").where("u <> v"), 0, False)


def _level(edges: DataFrame, depth: int, by_hash: bool) -> DataFrame:
    # A node's row has as many centres as tasks at most.
    found = _contracted(edges, mix(np.array([depth + 1], np.uint64)).item() if by_hash else 0).groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("centres"))
    found = found.select("u", "m", F.array_remove("centres", F.col("m")).alias("others"), F.array_contains("centres", F.col("u")).alias("centre"))
    found = materialize(found.where("u <> m or size(others) > 0"), "links")
    many = F.size("others") > 0
    n, linked, open_ = found.agg(F.count(F.lit(1)), F.count_if(many), F.count_if(many & F.col("centre"))).first()
    out = found.where("not centre").select(F.col("u").alias("node"), F.col("m").alias("root"))
    if linked:
        core = _level(found.select(F.explode("others").alias("u"), F.col("m").alias("v")), depth + 1, 2 * open_ > n)
        inner = core.select(F.col("node").alias("root"), F.col("root").alias("r"))
        done = out.join(inner, "root", "left").select("node", F.coalesce("r", "root").alias("root")).unionByName(core)
        out = materialize(done, "links")
        discard(found, core)
    else:
        out._tideline_folder = found._tideline_folder
    if not by_hash:
        return out
    # A centre need not be the smallest of its component.
    least = out.groupBy("root").agg(F.least(F.min("node"), "root").alias("r"))
    named = out.join(least, "root").select("node", F.col("r").alias("root")).unionByName(least.select(F.col("root").alias("node"), F.col("r").alias("root")))
    named = materialize(named.where("node <> root"), "links")
    discard(out)
    return named
