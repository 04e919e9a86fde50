"""Cutting lineage through storage that every executor shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_INFER = "spark.sql.constraintPropagation.enabled"
#: Bytes that Spark takes a table for of which it knows nothing.
_UNKNOWN = (1 << 63) - 1


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder. Where it names none, a temporary one serves a single-process session; others are refused,
    as their executors would not see it."""
    sc = spark.sparkContext
    if (there := sc.getCheckpointDir()) is not None:
        return there
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written for the time being, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sized(df: DataFrame) -> DataFrame:
    """``df``, just checkpointed, without its estimated size where that is more than a table of unknown size has.

    A join's estimate is the product of both sides', and a checkpoint hands it on as a number of any length: in a loop its
    digits multiply with each round, until they fill the driver's memory."""
    plan = df._jdf.queryExecution().logical()
    try:
        fits = plan.stats().sizeInBytes() <= _UNKNOWN
    except ValueError:  # more digits than Python converts
        fits = False
    if fits:
        return df
    spark, session = df.sparkSession, df._jdf.sparkSession()
    none, sql = spark._jvm.scala.Option.empty(), spark._jvm.org.apache.spark.sql
    bare = sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, none, none)
    return DataFrame(sql.classic.Dataset.ofRows(session, bare), spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and go on from the files.

    The files are dropped by Spark's cleaner once nothing refers to them. What is inferred about the rows is not carried
    over, nor are estimates beyond any size: in loops both would grow with every round, and with them the time to plan."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    known = spark.conf.get(_INFER, "true")
    spark.conf.set(_INFER, "false")
    try:
        return _sized(df.checkpoint(eager=True))
    finally:
        spark.conf.set(_INFER, known)
