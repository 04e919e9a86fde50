"""Approximate nearest neighbours by a forest of random-projection trees.

1. Equal vectors are folded to one node, which keeps its ``k + 1`` least ids: copies answer and are answered together.
2. A tree's node splits along a random direction at the median of a bounded sample; every vector is put in one leaf of each tree.
3. A query searches all trees through one priority queue: the next leaf, of whichever tree, is that with the least sum of
   squared distances to the splits on whose far side it lies. It stops after a number of leaves that is measured: at most
   ``TUNED_ON`` queries are compared with every vector, and the leaves they would have needed for a share ``recall`` of their
   true neighbours are what all queries visit. Clustered vectors need few; random ones, which no tree can part, need many.
4. Queries and vectors meet by leaf, in blocks, and cosines are taken exactly in double precision; each query keeps its best.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.embedding_dedup import Forest, unit
from veilmark.operators.skew import join_counted
from veilmark.scratch import cut

TREES, LEAF, BLOCK = 8, 512, 4096
#: Vectors on which medians are taken, how many of them a node has at least, and queries that are compared with all vectors.
SAMPLE, NODE_SAMPLE, TUNED_ON = 20_000, 16, 200
#: Cosines this near to the last one kept are taken exactly before any is left out.
_NEAR = 1e-9


def penalties(forest: Forest, x: np.ndarray) -> np.ndarray:
    """(row, tree, leaf from the left): how far each leaf lies behind the splits that part it from a row."""
    out = np.zeros((len(x), forest.trees, 1 << forest.depth))
    for t in range(forest.trees):
        far = np.zeros((len(x), 1))
        for level in range(forest.depth):
            at = slice(1 << level, 2 << level)
            gap = x @ forest.direction[t, at].T - forest.median[t, at]
            away = gap * gap
            far = np.stack([far + np.where(gap < 0, 0, away), far + np.where(gap < 0, away, 0)], axis=2).reshape(len(x), -1)
        out[:, t] = far
    return out


def visits(forest: Forest, x: np.ndarray, most: int) -> Iterator[list[int]]:
    """For each row the numbers of the ``most`` nearest leaves, taken from all trees through one priority queue."""
    first = 1 << forest.depth
    gaps = [x @ forest.direction[t].T - forest.median[t] for t in range(forest.trees)]
    for i in range(len(x)):
        gap = [g[i].tolist() for g in gaps]
        queue = [(0.0, t, 1) for t in range(forest.trees)]
        found: list[int] = []
        while queue and len(found) < most:
            far, t, node = heapq.heappop(queue)
            while node < first:  # down the near side; the far side waits
                g = gap[t][node]
                near = 2 * node + (g >= 0)
                heapq.heappush(queue, (far + g * g, t, near ^ 1))
                node = near
            found.append(forest.number(t, node))
        yield found


def _numbers(column: pa.Array) -> np.ndarray:
    """Packed vectors as rows of a matrix; packed are doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` and the same row of ``b``, in double precision."""

    def tame(x: np.ndarray) -> np.ndarray:  # powers of two, so that squares neither overflow nor vanish
        return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])

    a, b = tame(a), tame(b)
    return np.clip((a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))), -1.0, 1.0)


def best(queries: np.ndarray, raw: np.ndarray, others: np.ndarray, others_raw: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, cosine): of each row of ``queries`` the ``k`` rows of ``others`` with the largest cosine, ties to ``least``.

    ``queries`` and ``others`` have length one and find who is near; cosines are of the original vectors."""
    rows, found, score = [], [], []
    for lo in range(0, len(queries), 256):
        about = queries[lo : lo + 256] @ others.T
        last = np.partition(about, -k, axis=1)[:, -k] if about.shape[1] > k else about.min(axis=1, initial=1)
        i, j = np.nonzero(about >= last[:, None] - _NEAR)
        exact = cosines(raw[lo + i], others_raw[j])
        order = np.lexsort((least[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        begins = np.searchsorted(i, np.arange(len(about)))
        ok = np.arange(len(i)) - begins[i] < k
        rows.append(lo + i[ok])
        found.append(j[ok])
        score.append(exact[ok])
    return (np.concatenate(rows), np.concatenate(found), np.concatenate(score)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _place(forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                some = b.slice(lo, 2048)
                x, _ = unit(some.column("vector"))
                _, leaf = forest.value.leaves(x)
                raw = np.asarray(some.column("vector").flatten().cast(pa.float64())).reshape(len(x), -1)
                leaves = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * forest.value.trees, pa.int32()), pa.array(leaf))
                yield pa.RecordBatch.from_arrays([some.column("node"), some.column("least"), some.column("n_queries"), pa.array([v.tobytes() for v in raw], pa.binary()), leaves], names=["node", "least", "n_queries", "raw", "leaves"])

    return run


def _against_all(asked, k: int):
    """(query, node, least, score, leaves): the nearest of a partition's vectors to each of a few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = asked.value
        x, held = _length_one(raw), None
        for b in batches:
            if not b.num_rows:
                continue
            part = pa.Table.from_batches([b.select(["node", "least", "raw", "leaves"])])
            theirs = _numbers(part.column("raw"))
            i, j, score = best(x, raw, _length_one(theirs), theirs, _least(part.column("least")), k)
            got = part.select(["node", "least", "leaves"]).take(pa.array(j))
            got = got.add_column(0, "query", pa.array(ids[i])).add_column(3, "score", pa.array(score))
            held = got if held is None else pa.concat_tables([held, got])
            if held.num_rows > 64 * k * len(ids):
                held = _kept(held, k)
        if held is not None:
            yield from _kept(held, k).combine_chunks().to_batches()

    return run


def _kept(table: pa.Table, k: int) -> pa.Table:
    q = np.asarray(table.column("query"))
    order = np.lexsort((_least(table.column("least")), -np.asarray(table.column("score")), q))
    begins = np.searchsorted(q[order], q[order])
    return table.take(pa.array(order[np.arange(len(q)) - begins < k]))


def _least(column) -> np.ndarray:
    """Least ids to order by; none comes last."""
    return np.asarray(pc.fill_null(column, np.iinfo(np.int64).max))


def _length_one(raw: np.ndarray) -> np.ndarray:
    x = raw / np.abs(raw).max(axis=1, initial=0)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _ask(forest, most: int):
    """(leaf, query, raw): the leaves each query visits, its own among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                raw = _numbers(some.column("raw"))
                found = [sorted({*own, *seen}) for own, seen in zip(some.column("leaves").to_pylist(), visits(forest.value, _length_one(raw), most))]
                of = np.repeat(np.arange(some.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), some.column("node").take(pa.array(of)), some.column("raw").take(pa.array(of))], names=["leaf", "query", "raw"])

    return run


def _meet(k: int):
    """(query, node, least, score): of the vectors of a leaf, the nearest to each query that visits it."""

    def run(theirs: pa.Table, mine: pa.Table) -> pa.Table:
        raw, asked = _numbers(theirs.column("raw")), _numbers(mine.column("raw"))
        if not len(raw) or not len(asked):
            i, j, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        else:
            i, j, score = best(_length_one(asked), asked, _length_one(raw), raw, _least(theirs.column("least")), k)
        got = theirs.select(["node", "least"]).take(pa.array(j))
        return got.add_column(0, "query", mine.column("query").take(pa.array(i))).append_column("score", pa.array(score))

    return run


def leaves_needed(forest: Forest, x: np.ndarray, of: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """How many leaves a search from row ``of`` of ``x`` visits until it is in one of ``leaves`` (one of each tree)."""
    far = penalties(forest, x).reshape(len(x), -1)
    place = leaves & ((1 << forest.depth) - 1)
    at = np.arange(forest.trees) * (1 << forest.depth) + place
    nearest = np.take_along_axis(far[of], at, axis=1).min(axis=1)
    ordered = np.sort(far, axis=1)
    return np.array([np.searchsorted(ordered[i], v, side="right") for i, v in zip(of.tolist(), nearest.tolist())], np.int64)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, recall: float = 0.98, sample: int = SAMPLE, tuned_on: int = TUNED_ON, block: int = BLOCK, seed: int = 13) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows by cosine to each row of ``is_query``, nearest first.

    Ties go to the smaller id, null ids last. A row is no answer to itself; others that have its id are, and queries that repeat
    an id are answered one by one. Vectors that are null, zero, non-finite, with null components or of another width than most take
    no part; fewer candidates than ``k`` give fewer rows. Two searches of the same rows visit the same leaves. Work grows with
    the queries times the share of leaves that ``recall`` takes; with ``leaf`` vectors or fewer, all are compared."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = rows.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("vector", lambda c: c != 0))
    counted = good.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    good = good.where(F.size("vector") == (counted["width"] if counted else 0)).withColumn("vector", F.transform("vector", lambda c: c + F.lit(0.0)))
    # 1. nodes; of a vector's copies each map task sends k + 1 ids at most
    asked = good.where("asks").select("id", "vector")
    times = asked.groupBy("vector").agg(F.count(F.lit(1)).alias("n_queries"))
    by_id = Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last())
    few = good.select("vector", "id", F.row_number().over(by_id).alias("place")).where(F.col("place") <= k + 1)
    nodes = few.groupBy("vector").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))), lambda s: s["id"]).alias("ids"))
    nodes = nodes.join(times.hint("merge"), "vector", "left").withColumn("n_queries", F.coalesce("n_queries", F.lit(0)))
    nodes = cut(nodes.select("vector", "ids", F.col("ids")[0].alias("least"), "n_queries", F.monotonically_increasing_id().alias("node")))
    n = nodes.count()
    # 2. the forest, fitted on the ``sample`` vectors of least hash
    chosen = nodes.orderBy(F.xxhash64("vector"), "least").limit(sample).select("vector").toArrow().column("vector")
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    depth = min(depth, max(0, int(math.log2(max(1, len(chosen)) / NODE_SAMPLE))))
    grown = Forest(unit(chosen)[0], depth, trees if depth else 1, 0.0, seed)
    forest = spark.sparkContext.broadcast(grown)  # at most sample / NODE_SAMPLE directions a tree
    placed = cut(nodes.select("node", "least", "n_queries", "vector").mapInArrow(_place(forest), "node long, least long, n_queries long, raw binary, leaves array<long>"))
    # 3. how many leaves to visit
    most = grown.trees << depth
    if depth:
        tried = placed.where("n_queries > 0").orderBy(F.xxhash64("raw"), "node").limit(tuned_on).select("node", "raw").toArrow()
        few_asked = (np.asarray(tried.column("node")), _numbers(tried.column("raw"))) if tried.num_rows else None
        if few_asked:
            true = placed.mapInArrow(_against_all(spark.sparkContext.broadcast(few_asked), k + 1), "query long, node long, least long, score double, leaves array<long>")
            at = Window.partitionBy("query").orderBy(F.desc("score"), F.col("least").asc_nulls_last(), "node")
            true = true.where("query <> node").withColumn("place", F.row_number().over(at)).where(F.col("place") <= k).toArrow()  # tuned_on * k rows at most
            order = np.argsort(few_asked[0])
            of = order[np.searchsorted(few_asked[0], np.asarray(true.column("query")), sorter=order)]
            need = leaves_needed(grown, _length_one(few_asked[1]), of, np.array(true.column("leaves").to_pylist(), np.int64).reshape(len(of), -1))
            most = min(most, int(np.quantile(need, recall, method="higher"))) if len(need) else most
    asks = cut(placed.where("n_queries > 0").repartition("node").select("node", "raw", "leaves").mapInArrow(_ask(forest, most), "leaf long, query long, raw binary"))
    # 4. queries and vectors meet; leaves are at most trees * sample / NODE_SAMPLE
    here = placed.select("node", "least", "raw", F.explode("leaves").alias("leaf"))
    sizes = here.groupBy("leaf").agg(F.count(F.lit(1)).alias("members")).join(asks.groupBy("leaf").agg(F.count(F.lit(1)).alias("asking")).hint("merge"), "leaf")
    blocks = F.broadcast(cut(sizes.select("leaf", F.ceil(F.col("members") / block).cast("int").alias("m"), F.ceil(F.col("asking") / block).cast("int").alias("q"))))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = here.join(blocks, "leaf").withColumn("mb", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")).withColumn("qb", each("q"))
    right = asks.join(blocks, "leaf").withColumn("qb", F.pmod(F.xxhash64("query"), F.col("q")).cast("int")).withColumn("mb", each("m"))
    met = left.select("leaf", "mb", "qb", "node", "least", "raw").groupBy("leaf", "mb", "qb").cogroup(right.select("leaf", "mb", "qb", "query", "raw").groupBy("leaf", "mb", "qb"))
    found = met.applyInArrow(_meet(k + 1), "query long, node long, least long, score double")
    found = found.groupBy("query", "node", "least").agg(F.max("score").alias("score"))
    at = Window.partitionBy("query").orderBy(F.desc("score"), F.col("least").asc_nulls_last(), "node")
    top = cut(found.withColumn("place", F.row_number().over(at)).where(F.col("place") <= k + 1).select("query", "node", "score"))
    # every copy of the nearest vectors, then of these the k + 1 first; a query's own row is among them
    copies = top.join(nodes.select("node", "ids").hint("merge"), "node").select("query", F.transform("ids", lambda i: F.struct((-F.col("score")).alias("near"), i.isNull().alias("none"), i.alias("id"), (F.col("query") == F.col("node")).alias("alike"))).alias("some"))
    answers = copies.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, k + 1).alias("near"))
    answers = cut(nodes.where("n_queries > 0").select(F.col("node").alias("query"), "vector", "n_queries").join(answers.hint("merge"), "query").select(F.xxhash64("vector").alias("_k"), F.col("vector").alias("_v"), "near", "n_queries"))
    total = answers.agg(F.sum("n_queries")).first()[0] or 0
    keyed = asked.select("id", F.xxhash64("vector").alias("_k"), F.col("vector").alias("_v"), F.monotonically_increasing_id().alias("_at"))
    got = join_counted(keyed, answers, ["_k", "_v"], total, "n_queries", "_at")
    own = F.array_position(F.transform("near", lambda s: s["alike"] & s["id"].eqNullSafe(F.col("id"))), True)
    got = got.withColumn("_own", own - 1)
    got = got.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda s, i: i != F.col("_own")), 1, k)).alias("at", "s"))
    return got.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("s.id").alias("vec_id"), (-F.col("s.near")).alias("score"))
