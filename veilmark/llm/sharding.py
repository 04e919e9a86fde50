"""Contiguous balanced shards from global prefix sums.

Rows are sorted by text digest and id over range partitions; each partition sums its own sizes, the partitions' totals give
every partition its offset, and the line of all bytes is cut at equal targets. Rows with equal texts lie side by side and
take the shard of the first of them, so that a group is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.scratch import cut

_KINDS = {"doc_id": pa.int64(), "size": pa.int64(), "text_crc32": pa.int64(), "key": pa.binary(), "part": pa.int32(), "row": pa.int64(), "bytes": pa.int64(), "group_at": pa.int64()}


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part, row (from 0), bytes (before the row) and group_at: bytes before the row's group, -1 in the partition's first group."""
    part, rows, total, last, began, firsts = TaskContext.get().partitionId(), 0, 0, None, -1, True
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(b.column("size"))
        before = total + np.cumsum(size) - size
        keys = b.column("key").to_pylist()
        new = np.array([k != p for k, p in zip(keys, [last, *keys[:-1]])])
        groups = np.empty(len(keys), np.int64)
        for i in range(len(keys)):
            if new[i]:
                firsts = last is None and i == 0
                began = -1 if firsts else int(before[i])
            groups[i] = began
        n = len(keys)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("size"), b.column("text_crc32"), b.column("key"), pa.array(np.full(n, part), pa.int32()), pa.array(rows + np.arange(n)), pa.array(before), pa.array(groups)], names=list(_KINDS)
        )
        rows, total, last = rows + n, total + int(size.sum()), keys[-1]


def shards(docs: DataFrame, n_shards: int = 16, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot) of every row.

    ``law="bytes"``: sizes, UTF-8 bytes plus 1, are near equal; equal texts share a shard, so a shard is off by one group of
    copies at most. ``law="rows"``: counts are at most one apart and groups may be split. Slots count from 0 within a shard
    without gaps. Nulls: a null text has size 1 and is a group with the empty ones; a null id sorts first. Rows that repeat
    id and text take slots of their own. An empty table gives no rows."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"law must be bytes or rows, not {law!r}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))
    kinds = "doc_id long, size long, text_crc32 long, key binary, part int, row long, bytes long, group_at long"
    local = cut(rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").mapInArrow(_local, kinds))
    #: one row a partition goes to the driver
    ends = F.max_by(F.struct("key", "group_at"), "row").alias("end")
    parts = sorted(local.groupBy("part").agg((F.max("row") + 1).alias("rows"), F.max(F.col("bytes") + F.col("size")).alias("bytes"), F.min_by("key", "row").alias("key"), ends).collect(), key=lambda r: r["part"])
    offsets: dict[int, tuple[int, int, int]] = {}
    at_row = at_byte = began = 0
    last = None
    for p in parts:
        if p["key"] != last:
            began = at_byte
        offsets[p["part"]] = (at_row, at_byte, began)  # began: where the partition's first group begins
        if p["end"]["group_at"] >= 0:
            began = at_byte + p["end"]["group_at"]
        last, at_row, at_byte = p["end"]["key"], at_row + p["rows"], at_byte + p["bytes"]
    n_rows, n_bytes = at_row, at_byte

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = np.array([offsets[p] for p in np.asarray(b.column("part"))], np.int64).reshape(-1, 3)
            row, group = np.asarray(b.column("row")) + base[:, 0], np.asarray(b.column("group_at"))
            byte = np.where(group < 0, base[:, 2], group + base[:, 1])
            shard = [x * n_shards // n_bytes for x in byte.tolist()] if law == "bytes" else [x * n_shards // n_rows for x in row.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(shard, pa.int32()), pa.array(row)], names=["doc_id", "size", "text_crc32", "shard", "row"])

    placed = local.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, row long")
    #: n_shards rows
    begins = placed.groupBy("shard").agg(F.min("row").alias("begins"))
    slot = (F.col("row") - F.col("begins")).alias("slot")
    return placed.join(F.broadcast(begins), "shard").select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", slot)
