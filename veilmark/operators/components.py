"""Connected components of an edge table: union-find within tasks, star contractions between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.operators.skew import join_counted
from veilmark.scratch import cut

#: Edges that one task takes into memory at a time.
TASK_EDGES = 500_000


def _minima(edges: DataFrame) -> DataFrame:
    """Of each u: m, the least of u and its neighbours, and n, its number of edges."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = join_counted(both, cut(_minima(both)), ["u"], 2 * total, "n", "v")
    return found.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = cut(_minima(down))
    found = join_counted(down, least, ["u"], total, "n", "v")
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """The same components as stars around their least nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        else:
            parent[a] = b
    root = np.array(parent, np.int64)
    while not np.array_equal(up := root[root], root):
        root = up
    far = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= 2 * TASK_EDGES:
            t = pa.Table.from_batches(held)
            yield _stars(np.asarray(t["u"]), np.asarray(t["v"]))
            held = []
    if held:
        t = pa.Table.from_batches(held)
        yield _stars(np.asarray(t["u"]), np.asarray(t["v"]))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge between two different nodes; component is the least node reachable.

    Nodes are longs. Each round replaces the edges that a task holds by stars, then contracts stars across tasks with a
    partial aggregate and a join that splits hot nodes. What fits one task is solved by it; else the number of rounds grows with the
    logarithm of the longest path. Nulls, loops and repeated edges are left out; no edges give no rows."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        total = state[0]
        if not total or tuple(state) == seen:
            break
        seen = tuple(state)
        tasks = -(-total // TASK_EDGES)
        e = cut(e.coalesce(tasks).mapInArrow(_contract, "u long, v long"))
        if tasks == 1:
            break
        e = cut(_small_star(cut(_large_star(e, total)), total))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
