"""Scans and sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that are held at once.
CHUNK = 8 << 20


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped and bad ones fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def first_source(spark: SparkSession, candidates: list[tuple[str, str]], schema: str | None = None, synthetic: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """The first readable of (provenance, path), tagged with source_mode; then ``synthetic``, if given; else an error.

    A source that is missing, empty or damaged is passed over. With ``whole`` all its rows are parsed first, so that damage
    anywhere counts; without, its first rows."""
    for mode, path in candidates:
        try:
            df = read_jsonl(spark, path, schema) if schema else spark.read.parquet(path)
            if whole:
                rows = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first()[0]
            if rows if whole else not df.isEmpty():
                return df.withColumn("source_mode", F.lit(mode))
        except (PySparkException, Py4JJavaError):
            continue
    if synthetic is None:
        raise FileNotFoundError("no source has rows and no fallback is allowed")
    return synthetic.withColumn("source_mode", F.lit("synthetic_fallback"))


def _streamed(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                sha, size = hashlib.sha256(), 0
                with store.open_input_stream(at, buffer_size=0, compression=None) as f:
                    while part := f.read(chunk):
                        sha.update(part)
                        size += len(part)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([sha.hexdigest()])], names=["path", "size", "sha256"])

    return run


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, size) of all files below a path or pattern, empty ones too, as the store names them; hidden ones are left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in store.globStatus(at) or ():
        files = store.listFiles(status.getPath(), True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName()[0] not in "._":
                found.append((f.getPath().toUri().toString(), f.getLen()))
    return found


def file_digests(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(path, size, sha256) of all files below ``path``: one task a file, which reads ``chunk`` bytes at a time.

    The driver lists names and sizes only. Stores that Arrow cannot open are read by Spark, up to 2 GB a file."""
    from pyarrow import fs

    found = _listed(spark, path)
    try:
        for p, _ in found[:1]:
            store, at = fs.FileSystem.from_uri(p)
            store.get_file_info(at)
    except (pa.ArrowException, OSError, ImportError):
        none = spark.createDataFrame([(p, 0, hashlib.sha256().hexdigest()) for p, n in found if n == 0], "path string, size long, sha256 string")
        if not any(n for _, n in found):
            return none
        some = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([p for p, n in found if n])
        return some.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).unionByName(none)
    rows = spark.createDataFrame([(p,) for p, _ in found], "path string").repartition(max(1, len(found)))
    return rows.mapInArrow(_streamed(chunk), "path string, size long, sha256 string")


def file_checks(spark: SparkSession, path: str, pinned: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """(name, path, size, status) of each pinned name: ``ok``, ``changed`` or ``missing``."""
    want = spark.createDataFrame(list(pinned.items()), "name string, pinned string")
    have = file_digests(spark, path, chunk).withColumn("_name", F.element_at(F.split("path", "/"), -1))
    j = F.broadcast(want).join(have, F.col("name") == F.col("_name"), "left")
    return j.select("name", "path", "size", F.when(F.col("path").isNull(), "missing").when(F.col("sha256") != F.col("pinned"), "changed").otherwise("ok").alias("status"))


def checked_files(spark: SparkSession, path: str, pinned: dict[str, str], chunk: int = CHUNK) -> list[str]:
    """Paths below ``path`` whose names are pinned; refuses one whose SHA-256 differs or is missing."""
    found = file_checks(spark, path, pinned, chunk).collect()  # as many rows as there are pins
    if bad := [r["name"] for r in found if r["status"] != "ok"]:
        raise ValueError(f"checksums differ: {sorted(bad)}")
    return [r["path"] for r in found]


def flat_text(df: DataFrame, path: str) -> Column:
    """The text at a dotted path of a nested column, whatever lies on the way; nothing there is the empty text.

    The schema says what to do: a structure is entered, an array (of arrays, of structures) is gone through in order and its
    texts are joined by one space, nulls left out."""

    def texts(c: Column, kind: T.DataType, names: list[str]) -> tuple[Column, bool]:
        """The column at ``names``, and whether it is an array of texts."""
        if isinstance(kind, T.ArrayType):
            inner = texts(F.lit(None).cast(kind.elementType), kind.elementType, names)[1]
            parts = F.transform(c, lambda x: texts(x, kind.elementType, names)[0])
            return (F.flatten(F.filter(parts, lambda x: x.isNotNull())) if inner else parts), True
        if names:
            if not isinstance(kind, T.StructType):
                raise ValueError(f"{path} enters {kind.simpleString()}")
            return texts(c[names[0]], kind[names[0]].dataType, names[1:])
        return c.cast("string"), False

    head, *rest = path.split(".")
    column, many = texts(F.col(head), df.schema[head].dataType, rest)
    return F.coalesce(F.array_join(column, " ") if many else column, F.lit(""))


def adapt_nested(df: DataFrame, query: list[str], context: list[str], source: str, domain: str) -> DataFrame:
    """(query_text, context_text, source_dataset, domain): the first non-empty of ``query``'s paths; ``context``'s joined by a space."""
    first = F.coalesce(*[F.nullif(flat_text(df, p), F.lit("")) for p in query], F.lit(""))
    joined = reduce(lambda a, b: F.concat(a, F.lit(" "), b), [flat_text(df, p) for p in context]) if context else F.lit("")
    return df.select("*", first.alias("query_text"), joined.alias("context_text"), F.lit(source).alias("source_dataset"), F.lit(domain).alias("domain"))


def write_splits(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)
