"""Joins against one-row-per-key lookups that survive keys holding a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.scratch import cut

#: A key is hot above one part in this many of all rows, so there are fewer hot keys than this.
HOT_PARTS = 1000


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` dealt by the hash of ``key`` to partitions of about ``rows`` rows, at least as many as tasks can run at once.

    For rows that are few megabytes and much work each: a scan would put them into one task. What groups by ``key`` afterwards
    needs no other shuffle."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


def join_counted(rows: DataFrame, lookup: DataFrame, keys: list[str], total: int, weight: str, spread: str) -> DataFrame:
    """Left join ``rows`` with ``lookup``, which has one row a key and in ``weight`` how many of the ``total`` rows have it.

    Keys above ``total / HOT_PARTS`` rows, at most ``HOT_PARTS`` of them whatever the input, are looked up in a broadcast;
    their rows then go through the shuffle join without a key, dealt by ``spread``. Keys must not be null in ``lookup``;
    rows with a null key find nothing. ``lookup`` should be materialised: it is read twice. ``weight`` is left out.
    """
    values = [c for c in lookup.columns if c not in keys and c != weight]
    hot = lookup.where(F.col(weight) * F.lit(HOT_PARTS) > F.lit(total)).drop(weight)
    cold = lookup.where(F.col(weight) * F.lit(HOT_PARTS) <= F.lit(total)).drop(weight)
    hot = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(v).alias(f"_h_{v}") for v in values], F.lit(True).alias("_hot"))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_h_{k}") for k in keys])
    marked = rows.join(F.broadcast(hot), on, "left")
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    marked = marked.withColumns(
        {f"_k_{k}": F.when(~is_hot, F.col(k)) for k in keys} | {"_side": F.when(is_hot, F.xxhash64(F.col(spread))).otherwise(F.lit(0).cast("long"))}
    )
    cold = cold.select(*[F.col(k).alias(f"_c_{k}") for k in keys], *[F.col(v).alias(f"_c_{v}") for v in values], F.lit(0).cast("long").alias("_c_side"))
    on = reduce(lambda a, b: a & b, [F.col(f"_k_{k}") == F.col(f"_c_{k}") for k in keys], F.col("_side") == F.col("_c_side"))
    joined = marked.join(cold.hint("merge"), on, "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[F.when(is_hot, F.col(f"_h_{v}")).otherwise(F.col(f"_c_{v}")).alias(v) for v in values])


def look_up(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, spread: str) -> DataFrame:
    """``join_counted`` with a look-up made of the rows themselves, so that its weights add up to them all."""
    lookup = cut(lookup)
    return join_counted(rows, lookup, keys, lookup.agg(F.sum(weight)).first()[0] or 0, weight, spread)


def first_of_key(df: DataFrame, key: Column, order: list[Column], out: str) -> DataFrame:
    """``df`` with whether a row is the first of its key by ``order``; null keys are a key.

    How often each order occurs, then each key's least order with its times, come from partial aggregates; rows look up the
    latter, so a key that holds a large share of the rows is in no task as a whole. Where rows are alike in key and order, one
    of them is first."""
    rows = df.withColumns({"_key": F.struct(key.alias("k")), "_order": F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])})

    def least(rows: DataFrame) -> DataFrame:
        times = rows.groupBy("_key", "_order").agg(F.count(F.lit(1)).alias("_times"))
        found = times.groupBy("_key").agg(F.min(F.struct("_order", "_times")).alias("_l"), F.sum("_times").alias("_n"))
        return cut(found.select("_key", F.col("_l._order").alias("_least"), F.col("_l._times").alias("_times"), "_n"))

    firsts = least(rows)
    total, tied = firsts.agg(F.sum("_n"), F.max("_times")).first()
    if (tied or 0) > 1:
        rows = cut(rows.withColumn("_order", F.struct(F.col("_order").alias("by"), F.monotonically_increasing_id().alias("row"))))
        firsts = least(rows)
    found = join_counted(rows, firsts.drop("_times"), ["_key"], total or 0, "_n", "_order")
    return found.withColumn(out, F.col("_order") == F.col("_least")).drop("_key", "_order", "_least")
