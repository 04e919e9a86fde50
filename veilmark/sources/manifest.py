"""Order-free fingerprints of tables, and a manifest of stages: a chain of rows, each bound to its parent's."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "seq long, stage string, path string, fingerprint string, config string, parent_stage string, parent string, link string"


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in sorted(df.columns)])


def fingerprint(df: DataFrame) -> str:
    """Count, sum and xor of row hashes: the same for any order and partitioning of the rows."""
    h = row_hash(df)
    n, s, x = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return f"{n}:{int(s or 0) & (2**64 - 1):016x}:{(x or 0) & (2**64 - 1):016x}"


def digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def _link(row: dict) -> str:
    """A row's digest, its parent's link included, so that it stands for all its ancestors too."""
    return digest({k: row[k] for k in ("seq", "stage", "path", "fingerprint", "config", "parent_stage", "parent")})


def chain(spark: SparkSession, manifest: str) -> list[dict]:
    """The manifest's rows by number: one for each time that a stage was written."""
    return sorted((r.asDict() for r in spark.read.schema(_ROW).parquet(manifest).collect()), key=lambda r: r["seq"])


def _latest(rows: list[dict], stage: str) -> dict:
    found = [r for r in rows if r["stage"] == stage]
    if not found:
        raise ValueError(f"no stage {stage}")
    return found[-1]


def write_stage(df: DataFrame, path: str, manifest: str, stage: str, config: dict, parent: str = "") -> None:
    """Writes a stage's table and adds its row to the manifest, bound to the latest row of the stage ``parent``. One writer at a time."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    try:
        rows = chain(spark, manifest)
    except Exception as e:  # noqa: BLE001  the first stage finds no manifest
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    row = {"seq": rows[-1]["seq"] + 1 if rows else 0, "stage": stage, "path": path, "fingerprint": fingerprint(spark.read.parquet(path)), "config": digest(config), "parent_stage": parent, "parent": _latest(rows, parent)["link"] if parent else ""}
    row["link"] = _link(row)
    spark.createDataFrame([row], _ROW).coalesce(1).write.mode("append").parquet(manifest)


def verify_stage(spark: SparkSession, manifest: str, stage: str, config: dict, configs: dict[str, dict] | None = None) -> DataFrame:
    """The stage's table, once it and all its ancestors have been verified to the root.

    The latest row of each stage counts. Refused: another configuration of the stage, or of an ancestor named in ``configs``;
    a manifest row that was altered; a parent that was written again after the child was made; a table, of the stage or of
    any ancestor, whose rows have changed."""
    rows = chain(spark, manifest)
    expected = {stage: config} | (configs or {})
    at, child, first = stage, None, None
    while at:
        row = _latest(rows, at)
        if row["link"] != _link(row):
            raise ValueError(f"the manifest's row of {at} was altered")
        if child is not None and row["link"] != child["parent"]:
            raise ValueError(f"stage {at} was written again after {child['stage']} was made from it")
        if at in expected and row["config"] != digest(expected[at]):
            raise ValueError(f"stage {at} was made with another configuration")
        df = spark.read.parquet(row["path"])
        if fingerprint(df) != row["fingerprint"]:
            raise ValueError(f"stage {at} has changed")
        first = df if first is None else first
        at, child = row["parent_stage"], row
    return first


def refuse_sealed(df: DataFrame, split: str = "split", sealed: str = "test") -> DataFrame:
    """``df``; refuses rows of the sealed split where a model is fitted."""
    if not df.where(F.col(split) == sealed).isEmpty():
        raise ValueError(f"the {sealed} split is sealed")
    return df
