"""WARC archives as a Spark data source ("warc"), and archives of pages with revisit records.

Writing: every task writes files of its own, rolled by size, one gzip member a record; a member's "sl" extra field has its
compressed and full length, so that a reader can step over it. Only files of tasks that were committed are listed in the
manifest, so retried tasks leave no second copies. Reading: files are planned into partitions by size; a record's header is
inflated first, and when its type or a header is not wanted, or payloads are not, the rest is skipped. Archives lie wherever
``pyarrow.fs`` can reach from every executor.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from veilmark.operators.skew import join_counted
from veilmark.scratch import checkpoint_dir, cut

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, header_digest string, payload_length long, payload_digest string, payload binary, headers map<string,string>"
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}
_ARROW = pa.schema([*((n, pa.string()) for n in ("record_id", "record_type", "target_uri", "date", "refers_to", "header_digest")), ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("headers", pa.map_(pa.string(), pa.string()))])
#: Bytes of records that go on together.
BATCH_BYTES = 4 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, as WARC headers write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field "sl" has its own length and that of ``data``."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff"
    extra = b"sl" + struct.pack("<HII", 8, len(head) + 2 + 12 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str, date: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response with its payload, or a revisit that has the response's HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {_REVISIT}"] if refers_to else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Member:
    """A record being read: the header is inflated first, the rest only on demand."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at
        file.seek(at)
        head = file.read(12)
        self.gz = head[:2] == b"\x1f\x8b"
        self.size = None
        self.tail = b""
        if self.gz:
            extra = file.read(struct.unpack("<H", head[10:12])[0]) if head[3] & 4 else b""
            if extra[:2] == b"sl":
                self.size = struct.unpack("<I", extra[4:8])[0]
            self.z = zlib.decompressobj(31)
            file.seek(at)
        else:
            file.seek(at)

    def more(self, most: int) -> bytes:
        """Up to ``most`` more bytes of the record."""
        if not self.gz:
            return self.file.read(most)
        while not self.z.eof:
            raw = self.z.unconsumed_tail or self.file.read(1 << 14)
            if not raw:
                break
            if out := self.z.decompress(raw, most):
                return out
        return b""

    def header(self) -> tuple[dict[str, str], bytes]:
        data = b""
        while b"\r\n\r\n" not in data:
            if not (x := self.more(2048 if self.gz else 512)):
                break
            data += x
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        self.start = len(head) + 4
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, rest

    def block(self, rest: bytes, size: int) -> bytes:
        parts = [rest]
        got = len(rest)
        while got < size:
            if not (x := self.more(size - got)):
                break
            parts.append(x)
            got += len(x)
        return b"".join(parts)[:size]

    def next_at(self, size: int) -> int:
        """Where the next record begins; a member without "sl" has to be inflated to its end."""
        if not self.gz:
            return self.at + self.start + size + 4
        if self.size:
            return self.at + self.size
        while self.more(1 << 16):
            pass
        return self.file.tell() - len(self.z.unused_data)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.payload = options.get("payload", "true").lower()
        if self.payload not in ("true", "digest", "false"):
            raise ValueError(f"payload must be true, digest or false, not {self.payload}")
        self.target = int(options.get("maxPartitionBytes", 64 << 20))
        self.least = int(options.get("minPartitions", 1))
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in _HEADERS:
                self.wanted.append((_HEADERS[column], frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, root = _open(self.root)
        found = {x.path: x.size for x in where.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and re.search(r"\.warc(\.gz)?$", x.path)} if where.get_file_info(root).type == fs.FileType.Directory else {root: where.get_file_info(root).size}
        manifests = [x.path for x in where.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("_manifest")] if where.get_file_info(root).type == fs.FileType.Directory else []
        if manifests:
            listed = {f"{root.rstrip('/')}/{n}" for m in manifests for n in json.loads(where.open_input_stream(m).read())}
            found = {p: s for p, s in found.items() if p in listed}
        target = min(self.target, -(-sum(found.values()) // max(1, self.least)))
        out: list[InputPartition] = []
        group, size = [], 0
        for p, s in sorted(found.items()):
            if group and size + s > target:
                out.append(_Files(group))
                group, size = [], 0
            group.append(p)
            size += s
        return [*out, _Files(group)] if group or not out else out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        where, _ = _open(self.root)
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            total, at = where.get_file_info(path).size, 0
            with where.open_input_file(path) as file:
                while at < total:
                    m = _Member(file, at)
                    head, rest = m.header()
                    size = int(head.get("content-length", 0))
                    if all(head.get(name) in values for name, values in self.wanted):
                        rows.append(self.row(m, head, rest, size))
                        held += len(rows[-1][8] or b"") + 512
                        if held > BATCH_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                    at = m.next_at(size)
        if rows:
            yield _batch(rows)

    def row(self, m: _Member, head: dict, rest: bytes, size: int) -> tuple:
        length = payload = computed = None
        http = head.get("content-type", "").startswith("application/http")
        if self.payload != "false" or (http and head.get("warc-type") == "revisit"):
            block = m.block(rest, size)
            top, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
            if head.get("warc-type") == "revisit":
                found = re.search(rb"(?i)^content-length:\s*(\d+)", top, re.M)
                length = int(found[1]) if found else None
            elif self.payload != "false":
                length, computed = len(body), digest(body)
                payload = body if self.payload == "true" else None
        return (head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-refers-to"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None, length, computed, payload, list(head.items()))


class _Wrote(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Writer(DataSourceArrowWriter):
    """Rows (record_id, record_type, target_uri, date, refers_to, payload)."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.roll = int(options.get("rollBytes", 32 << 20))
        self.level = int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, root = _open(self.root)
        where.create_dir(root)
        files, out, size = [], None, 0
        for b in iterator:
            for row in b.to_pylist():
                if out is None or size >= self.roll:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = where.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                data = member(record(row["record_type"], row["record_id"], row["target_uri"], row["date"], row["payload"] or b"", row["refers_to"]), self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Wrote(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _open(self.root)
        where.create_dir(root)
        with where.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _open(self.root)
        for f in (f for m in messages if m for f in m.files):
            where.delete_file(f"{root}/{f}")


class WarcDataSource(DataSource):
    """Options: path, payload ("digest": inflated for length and digest but not returned; "false": not inflated),
    maxPartitionBytes, minPartitions (as many if there are files enough), rollBytes, level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    """Makes format "warc" known to the session and lets it have filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one record a row: of equal payloads of at least ``min_bytes``, rows with the smallest id are responses and the
    others revisit it; shorter payloads are all responses.

    A null html is an empty payload, a null url an empty URI; control characters in URLs are percent-encoded. Rows without an
    id are responses, with id "none". Rows that repeat an id and payload are alike. An empty table writes no records."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.when((F.octet_length("html") >= min_bytes) & F.col("id").isNotNull(), F.unhex(F.sha2("html", 256))))
    groups = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = join_counted(rows, cut(groups), ["key"], pages.count(), "n", "id")
    revisit = F.col("first").isNotNull() & (F.col("id") > F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    joined.select(
        name(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20").alias("target_uri"),
        F.lit(date).alias("date"),
        F.when(revisit, name(F.col("first"))).alias("refers_to"),
        F.encode("html", "UTF-8").alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_records(spark: SparkSession, path: str, payload: bool | str = True) -> DataFrame:
    """All records below ``path``; filters on record_type, record_id, target_uri, date and refers_to are answered from headers.

    ``payload``: True, False (not inflated, so no length or digest of responses) or "digest" (both, without the payload)."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("minPartitions", spark.sparkContext.defaultParallelism).load(path)


def archive(pages: DataFrame, path: str | None = None, payload: bool | str = True, **how) -> DataFrame:
    """Writes ``pages`` below ``path`` (default: a new folder in the shared checkpoint folder) and reads them back.

    The archives stay where they are: what is returned reads them when it is used, and they are the caller's to delete."""
    spark = pages.sparkSession
    register(spark)
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path, **how)
    return read_records(spark, path, payload)
