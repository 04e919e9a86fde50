"""Embedding near-dedup by a forest of random-projection trees with spill overlap.

1. Equal vectors are folded to one node, so copies cost nothing further on and need not be told apart by any tree.
2. A node of a tree splits along a random direction at the median; vectors within ``SPILL`` of it go both ways. Medians of the
   upper levels are taken on a bounded sample; leaves that are still overfull are split further at medians of all their
   vectors, taken by Spark, so that leaves do not grow with the input. A leaf whose vectors lie within the overlap of any
   split stays as it is: nearly all its pairs are links, which must be counted one by one.
3. Within a leaf, cut into blocks of ``BLOCK`` vectors, each pair of blocks is one task that takes all cosines in double
   precision. A pair that shares several leaves counts in the first of them only, so that links can be summed without
   gathering pairs; what leaves a task are degrees and the edges of a spanning forest.
4. Edges are united to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.operators.components import connected_components
from veilmark.operators.skew import join_counted
from veilmark.scratch import cut

TREES, SPILL, LEAF, BLOCK = 8, 0.01, 512, 1024
#: Vectors on which the medians of the upper levels are taken, and how many of them a sampled node has at least.
SAMPLE, NODE_SAMPLE = 20_000, 16
#: A leaf is split again if it has more than ``OVERFULL`` times ``LEAF`` vectors.
OVERFULL = 4
#: Bits of a leaf's number below its tree's: a leaf's place in a binary tree of up to 54 levels.
_PATH = 55


def unit(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one in double precision, and which rows have one: not null, of the first row's width, finite, not 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    width = int(size[size > 0][0]) if (size > 0).any() else 0
    out, ok = np.zeros((len(size), width)), size == width
    if width:
        flat = column.filter(pa.array(ok)).flatten().cast(pa.float64())
        out[ok] = np.asarray(pc.fill_null(flat, float("nan"))).reshape(-1, width)
    most = np.abs(out).max(axis=1, initial=0)
    ok &= np.isfinite(most) & (most > 0)
    out[~ok] = 0
    out[ok] /= most[ok, None]
    out[ok] /= np.sqrt(np.einsum("ij,ij->i", out[ok], out[ok]))[:, None]
    return out, ok


def direction(seed: int, leaf: int, width: int) -> np.ndarray:
    """The unit direction along which a node of a tree splits."""
    d = np.random.default_rng([seed, leaf]).standard_normal(width)
    return d / np.linalg.norm(d)


class Forest:
    """Directions and medians of the upper levels of all trees; ``leaves`` gives the leaves of vectors in each.

    A leaf's number is its tree and the place of its node in a binary tree, whose root is 1 and whose node k has 2k and 2k + 1."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL, seed: int = 11):
        self.depth, self.trees, self.spill = depth, trees, spill
        width = sample.shape[1] if sample.ndim == 2 else 0
        self.direction = np.zeros((trees, 1 << depth, width))
        self.median = np.zeros((trees, 1 << depth))
        for t in range(trees):
            at = {1: np.arange(len(sample))}
            for _ in range(depth):
                below = {}
                for node, rows in at.items():
                    self.direction[t, node] = direction(seed, t << _PATH | node, width)
                    x = sample[rows] @ self.direction[t, node]
                    self.median[t, node] = m = float(np.median(x)) if len(x) else 0.0
                    below |= {2 * node: rows[x < m], 2 * node + 1: rows[x >= m]}
                at = below

    @staticmethod
    def number(tree: int, node: int) -> int:
        """A leaf's number."""
        return node | tree << _PATH

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row falls into, by row."""
        rows, found = [], []
        for t in range(self.trees):
            at, node = np.arange(len(x)), np.ones(len(x), np.int64)
            for _ in range(self.depth):
                gap = np.einsum("ij,ij->i", x[at], self.direction[t, node]) - self.median[t, node]
                low, high = gap < self.spill, gap >= -self.spill
                at, node = np.concatenate([at[low], at[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
            rows.append(at)
            found.append(node | t << _PATH)
        row, leaf = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def _place(forest) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                some = b.slice(lo, 2048)
                x, _ = unit(some.column("vector"))
                row, leaf = forest.value.leaves(x)
                ends = np.searchsorted(row, np.arange(len(x) + 1))
                yield pa.RecordBatch.from_arrays([some.column("node"), some.column("n"), pa.array([v.tobytes() for v in x], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf))], names=["node", "n", "vector", "leaves"])

    return run


def _gaps(seed: int):
    """(node, leaf, at): where a vector lies along the direction of its leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = np.asarray(b.column("leaf"))
            x = np.frombuffer(b"".join(b.column("vector").to_pylist()), np.float64).reshape(len(leaf), -1)
            used, of = np.unique(leaf, return_inverse=True)
            at = np.empty(len(leaf))
            for i, k in enumerate(used.tolist()):
                at[of == i] = x[of == i] @ direction(seed, k, x.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("leaf"), pa.array(at)], names=["node", "leaf", "at"])

    return run


def split_overfull(placed: DataFrame, leaf: int, spill: float, seed: int) -> DataFrame:
    """``placed`` (node, n, vector, leaves) with leaves of more than ``OVERFULL * leaf`` nodes split until none is left.

    A leaf of which a split would leave more than nine in ten on one side stays. Each round splits all overfull leaves once."""
    stay = None
    #: leaves are looked up by how many rows they have: one that holds a large share of all is in no task as a whole
    found = lambda rows, leaves, total: join_counted(rows, leaves, ["leaf"], total, "_n", "node")
    here = F.lit(True).alias("_here")
    while True:
        pairs = placed.select("node", F.explode("leaves").alias("leaf"))
        full = pairs.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > OVERFULL * leaf)
        if stay is not None:
            full = full.join(stay.hint("merge"), "leaf", "left_anti")
        full = cut(full)
        total = full.agg(F.sum("_n")).first()[0]
        if not total:
            return placed
        inside = found(placed.select("node", "vector", F.explode("leaves").alias("leaf")), full.select("leaf", "_n", here), total).where("_here")
        gaps = cut(inside.select("node", "leaf", "vector").mapInArrow(_gaps(seed), "node long, leaf long, at double"))
        medians = cut(gaps.groupBy("leaf").agg(F.percentile_approx("at", 0.5, 1000).alias("median"), F.count(F.lit(1)).alias("_n")))
        low, high = F.col("at") - F.col("median") < spill, F.col("at") - F.col("median") >= -spill
        aside = found(gaps, medians, total)
        even = aside.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n"), F.count_if(low).alias("lows"), F.count_if(high).alias("highs"))
        even = cut(even.withColumn("ok", (F.greatest("lows", "highs") <= 0.9 * F.col("_n")) & (F.col("leaf").bitwiseAND(F.lit((1 << _PATH) - 1)) < 1 << _PATH - 1)))
        stay = even.where("not ok").select("leaf") if stay is None else cut(stay.unionByName(even.where("not ok").select("leaf")))
        path = F.col("leaf").bitwiseAND(F.lit((1 << _PATH) - 1))
        child = lambda k: F.col("leaf") + path + k
        gone = even.where("ok").select("leaf", "_n", here)
        fresh = found(aside, gone, total).where("_here").select("node", F.explode(F.array_compact(F.array(F.when(low, child(0)), F.when(high, child(1))))).alias("leaf"))
        kept = found(pairs, gone, total).where("_here is null").select("node", "leaf")
        leaves = kept.unionByName(fresh).groupBy("node").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
        placed = cut(placed.drop("leaves").join(leaves.hint("merge"), "node"))


def _shared_before(leaf: int, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Of pairs of rows of leaf tables (slot), padded by -1 and -2: whether they share a leaf that comes before ``leaf``."""
    met = np.zeros(len(mine), bool)
    for k in range(mine.shape[1]):
        a = mine[:, k]
        early = (a >= 0) & (a < leaf)
        if early.any():
            met[early] |= (a[early, None] == theirs[early]).any(axis=1)
    return met


def _slots(column: pa.ChunkedArray, pad: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.list_value_length(lists), np.int64)
    out = np.full((len(size), int(size.max(initial=1))), pad, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.asarray(lists.flatten())
    return out


def _block_links(threshold: float):
    """(node, other, n): of one pair of blocks, how many links each node has (other null), and edges that span them."""

    def run(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        ids, side, times = (np.asarray(table.column(c)) for c in ("node", "side", "n"))
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)
        mine, theirs = _slots(table.column("leaves"), -1), _slots(table.column("leaves"), -2)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        degree, group, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        for lo in range(0, len(left), 256):
            some = left[lo : lo + 256]
            i, j = np.nonzero(x[some] @ x[right].T >= threshold)
            i, j = some[i], right[j]
            ok = (ids[i] != ids[j]) & ((side[i] != 2) | (i < j))
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 1 << 16):
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                new = ~_shared_before(leaf, mine[a], theirs[b])
                degree += np.bincount(a[new], times[b[new]], len(ids)).astype(np.int64) + np.bincount(b[new], times[a[new]], len(ids)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
            for lo_, hi_ in zip(starts.tolist(), np.append(starts[1:], len(i)).tolist()):
                met = np.unique(group[j[lo_:hi_]])  # a node is joined once to each group that it isn't in
                met = met[met != group[i[lo_]]]
                if len(met):
                    edges += [(ids[i[lo_]], ids[m]) for m in met.tolist()]
                    group[np.isin(group, met)] = group[i[lo_]]
        found = np.flatnonzero(degree)
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"node": pa.array(np.concatenate([ids[found], e[:, 0]])), "other": pa.array([None] * len(found) + e[:, 1].tolist(), pa.int64()), "n": pa.array(np.concatenate([degree[found], np.zeros(len(e), np.int64)]))})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept): of each row, how many other rows it links with and its group's least id.

    Vectors link at a cosine of ``threshold``. Null, zero and non-finite vectors, those with null components or of another
    width than most, link with nothing. Rows that repeat an id are rows of their own, each with its own vector's links, and
    rows of equal vectors link with each other; a row without an id takes part and gets the least id of its group, or null
    and is kept. An empty table gives no rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sane = F.col("vector").isNotNull() & ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("vector", lambda c: c != 0)
    good = rows.where(sane)
    counted = good.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    n_rows, width = (counted["count"], counted["width"]) if counted else (0, 0)
    good = good.where(F.size("vector") == width)
    # 1. a node for each distinct vector; adding 0 makes -0.0 and 0.0 alike
    even = F.transform("vector", lambda c: c + F.lit(0.0))
    folded = good.groupBy(even.alias("vector")).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = cut(folded.withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    # 2. leaves; ``sample`` vectors at most are collected, the least of a hash
    chosen = nodes.orderBy(F.xxhash64("vector"), "node").limit(sample).select("vector").toArrow().column("vector")
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    depth = min(depth, max(0, int(math.log2(max(1, len(chosen)) / NODE_SAMPLE))) if len(chosen) else 0)
    forest = spark.sparkContext.broadcast(Forest(unit(chosen)[0], depth, trees, spill, seed))  # at most sample / NODE_SAMPLE directions a tree
    placed = cut(nodes.select("node", "n", "vector").mapInArrow(_place(forest), "node long, n long, vector binary, leaves array<long>"))
    placed = split_overfull(placed, leaf, spill, seed)
    # 3. tiles
    at_leaf = placed.withColumn("leaf", F.explode("leaves"))
    sizes = cut(at_leaf.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"))).withColumn("blocks", F.ceil(F.col("rows") / block).cast("int"))
    #: leaves of one block need no look-up; larger ones have over ``block`` rows each
    larger = sizes.where("blocks > 1").select("leaf", "blocks", "rows")
    dealt = join_counted(at_leaf, cut(larger), ["leaf"], n, "rows", "node").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    s = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(s, o).alias("lo"), F.greatest(s, o).alias("hi"), F.when(s == o, 2).when(s < o, 0).otherwise(1).alias("side")))
    dealt = dealt.withColumn("t", F.explode(tiles)).select("leaf", "t.lo", "t.hi", "t.side", "node", "n", "vector", "leaves")
    found = cut(dealt.groupBy("leaf", "lo", "hi").applyInArrow(_block_links(threshold), "node long, other long, n long"))
    # 4. groups
    degrees = found.where("other is null").groupBy("node").agg(F.sum("n").alias("links"))
    groups = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.select("node", "vector", "least", "n").join(degrees.hint("merge"), "node", "left").join(groups.hint("merge"), "node", "left")
    known = cut(known.select("vector", "least", "n", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    heads = known.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("weight"))
    known = cut(join_counted(known.withColumnRenamed("vector", "_v"), cut(heads), ["component"], n_rows, "weight", "least").select("_v", "n", "n_links", "component_id"))
    # rows that link with nothing need no look-up
    linked = F.coalesce(sane & (F.size("vector") == width), F.lit(False))
    keyed = rows.where(linked).select("id", even.alias("_v"), F.monotonically_increasing_id().alias("_at"))
    digest = lambda df: df.withColumn("_k", F.xxhash64("_v"))
    found = join_counted(digest(keyed), digest(known), ["_k", "_v"], n_rows, "n", "_at").select("id", "n_links", "component_id")
    alone = rows.where(~linked).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = found.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
