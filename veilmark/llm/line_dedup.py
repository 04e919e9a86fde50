"""Line dedup: which lines of a corpus repeat, as one compressed bitmap for each document that loses any.

Line keys are hashed (128-bit) and range-partitioned by hash and document; each partition streams its sorted rows once,
holding no more than ``HELD`` rows of the run at hand that is still below the threshold. A key may span partitions: only the
first and last run of a partition can, so they add two rows a partition to a small table that settles them, as do runs that
were too long to be held, of lines that few documents have very often.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.worker import claim
from veilmark.scratch import cut

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DROP, _PENDING, _RUN = 0, 1, 2
#: Rows of a run that are held until it is settled, and runs that are broadcast, once counted.
HELD, FEW = 1000, 10_000
_FOUND = "kind int, doc long, same long, pos int, h binary, n long, part int, first boolean"


def pack(drop: np.ndarray) -> bytes:
    """The keep bitmap of a document that loses the lines at ``drop``; lines past its end stay."""
    keep = np.ones(int(drop.max()) + 1 if len(drop) else 0, np.uint8)
    keep[drop] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes() + len(keep).to_bytes(8, "little"))


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    """Which of ``n`` lines stay."""
    raw = zlib.decompress(bitmap)
    keep = np.ones(n, bool)
    size = min(n, int.from_bytes(raw[-8:], "little"))
    keep[:size] = np.unpackbits(np.frombuffer(raw[:-8], np.uint8), bitorder="little")[:size].astype(bool)
    return keep


class _Runs:
    """Streams sorted rows (h, doc, same, pos) and says which of them go."""

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.part = TaskContext.get().partitionId()
        self.key: bytes | None = None  # of the run at hand
        self.docs = 0  # documents of it so far
        self.last: tuple = ()  # its last document
        self.rows: list[tuple] = []  # its rows that aren't settled
        self.begun = False  # its first row has gone by
        self.long = False  # some of its rows are pending already
        self.edge = True  # the run at hand is the partition's first
        self.out: list[tuple] = []

    def add(self, key: bytes, doc: int | None, same: int, pos: int) -> None:
        if key != self.key:
            self.end(False)
            self.key, self.docs, self.last, self.rows, self.begun, self.long = key, 0, (), [], False, False
        if (doc,) != self.last:
            self.docs, self.last = self.docs + 1, (doc,)
        self.rows.append((doc, same, pos, not self.begun))
        self.begun = True
        if self.docs >= self.min_docs and not self.keep_first:
            self.out += [(_DROP, d, s, p, None, 0, 0, False) for d, s, p, _ in self.rows]
            self.rows = []
        elif self.docs >= self.min_docs and not self.edge:
            self.out += [(_DROP, d, s, p, None, 0, 0, False) for d, s, p, f in self.rows if not f]
            self.rows = []
        elif len(self.rows) > HELD:
            self.pend()
            self.long = True

    def pend(self) -> None:
        self.out += [(_PENDING, d, s, p, self.key, 0, self.part, f) for d, s, p, f in self.rows]
        self.rows = []

    def end(self, last: bool) -> None:
        """The run at hand is over; ``last``: it may go on in the next partition."""
        if self.key is not None:
            if self.edge or last or self.long:
                self.pend()
                self.out.append((_RUN, None, 0, 0, self.key, self.docs, self.part, False))
            self.edge = False


def _stream(min_docs: int, keep_first: bool):
    schema = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("same", pa.int64()), ("pos", pa.int32()), ("h", pa.binary()), ("n", pa.int64()), ("part", pa.int32()), ("first", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lines")
        runs = _Runs(min_docs, keep_first)

        def flush() -> pa.RecordBatch:
            rows, runs.out = runs.out, []
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                runs.add(*row)
            if len(runs.out) > 20_000:
                yield flush()
        runs.end(True)
        if runs.out:
            yield flush()

    return run


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """(doc, same, n_dropped, keep_bitmap): the documents that lose lines.

    A line's key is the line stripped of blanks and with A-Z lower-cased. Of keys of at least ``min_chars`` code points in at
    least ``min_docs`` documents, all lines go (``keep="none"``) or all but the first by document and position
    (``keep="first"``). ``same`` is a hash of the text: rows that repeat an id with another text are told apart by it, rows
    that repeat both get the same bitmap and count as one document, and rows without an id count as one document together.
    A null text is one empty line. An empty table gives no rows."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep!r}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("same"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(_BLANK)), _UPPER, _LOWER)
    keyed = lines.withColumn("key", key).where(F.length("key") >= min_chars).select(F.unhex(F.md5("key")).alias("h"), "doc", "same", "pos")
    ranged = keyed.repartitionByRange("h", "doc").sortWithinPartitions("h", "doc", "same", "pos")
    found = cut(ranged.mapInArrow(_stream(min_docs, keep == "first"), _FOUND))
    #: at most two rows a partition, and one for each long run
    runs = cut(found.where(F.col("kind") == _RUN).groupBy("h").agg(F.sum("n").alias("docs"), F.min("part").alias("begins")).where(F.col("docs") >= min_docs))
    runs = F.broadcast(runs) if runs.count() <= FEW else runs.hint("merge")
    settled = (
        found.where(F.col("kind") == _PENDING)
        .select("h", "doc", "same", "pos", "part", "first")
        .join(runs, "h")
        .where(F.lit(keep == "none") | ~(F.col("first") & (F.col("part") == F.col("begins"))))
    )
    drops = found.where(F.col("kind") == _DROP).select("doc", "same", "pos").unionByName(settled.select("doc", "same", "pos"))
    lists = drops.groupBy("doc", "same").agg(F.array_sort(F.collect_set("pos")).alias("pos"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = [np.asarray(x.values) for x in b.column("pos")]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("same"), pa.array([len(g) for g in gone], pa.int32()), pa.array([pack(g) for g in gone], pa.binary())], names=["doc", "same", "n_dropped", "keep_bitmap"])

    return lists.mapInArrow(packed, "doc long, same long, n_dropped int, keep_bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text cut to the lines that stay, and ``n_lines`` (before), ``n_dropped``. A null text stays null."""
    b = bitmaps.select(F.col("doc").alias("_doc"), F.col("same").alias("_same"), F.col("keep_bitmap").alias("_keep"))
    same = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.withColumn("_id_same", same).join(b.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("_doc")) & (F.col("_id_same") == F.col("_same")), "left")
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]

    def cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lines")
        for batch in batches:
            text, keep = batch.column(text_col), batch.column("_keep")
            n = np.asarray(pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 1), np.int64)
            gone = np.zeros(len(n), np.int64)
            at = np.flatnonzero(np.asarray(pc.is_valid(keep)))
            new = []
            for i in at:
                lines = text[i].as_py().split("\n")
                stay = unpack(keep[i].as_py(), len(lines))
                gone[i] = len(lines) - stay.sum()
                new.append("\n".join(x for x, s in zip(lines, stay) if s))
            if len(at):
                text = pc.replace_with_mask(text, pc.is_valid(keep), pa.array(new, text.type))
            yield pa.RecordBatch.from_arrays([text if c == text_col else batch.column(c) for c in cols] + [pa.array(n), pa.array(gone)], names=[*cols, "n_lines", "n_dropped"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return joined.select(*cols, "_keep").mapInArrow(cut_lines, f"{kinds}, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``apply_bitmaps`` of ``keep_bitmaps``: each row of ``docs`` once, other columns untouched."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, **how), id_col, text_col)
