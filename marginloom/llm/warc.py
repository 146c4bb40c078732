"""A PySpark data source for WARC archives.

Reading: files are planned into partitions of about ``partition_bytes``. Filters on record
type and header fields are pushed into the reader, which parses a record's headers first
and seeks over the payloads of records that fail them, or of all records where the schema
asked for has no ``payload``. Payloads that are read are decoded and checked against their
digest. Records are streamed, one payload at a time.

Writing: every task writes its own files and rolls them at ``file_bytes``. A commit lists
the files of the successful tasks in a manifest; files of failed attempts are on no list
and are never read.

Paths may be of any file system that pyarrow opens: file, hdfs, s3, gs.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from marginloom.llm.common import for_python, salted_left_join
from marginloom.session import shared_folder

HEADERS = "record_type string, page_id bigint, target_uri string, payload_bytes bigint, payload_digest string, refers_to bigint"
SCHEMA = f"{HEADERS}, payload binary"
WRITTEN = "page_id bigint, target_uri string, payload binary, refers_to bigint"

PARTITION_BYTES = 128 << 20
FILE_BYTES = 128 << 20
BATCH_BYTES = 4 << 20
BATCH_RECORDS = 512
MANIFEST = "_files"

PAGE_URN = "urn:x-page:"


def open_path(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if re.match(r"^file:/[^/]", path):
        path = "file://" + path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<{PAGE_URN}{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(PAGE_URN)
    return int(number) if number else None


def record_bytes(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record without it if it refers to another page."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + b"\r\n"
    if not revisit:
        packed = gzip.compress(payload, 4, mtime=0)
        block = http + b"Content-Encoding: gzip\r\nContent-Length: %d\r\n\r\n" % len(packed) + packed
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("X-Payload-Bytes", str(len(payload))),
    ]
    if uri is not None:  # a header is one line
        fields.append(("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _urn(refers_to)),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _header_lines(stream: io.BufferedReader) -> list[bytes]:
    lines = []
    while (line := stream.readline()) and line.strip(b"\r\n"):
        lines.append(line)
    return lines


def read_records(stream: io.BufferedReader, wanted, with_payload: bool) -> Iterator[dict]:
    """The records whose header fields ``wanted`` accepts; others cost their headers and a seek."""
    while start := stream.readline():
        if not start.strip():
            continue
        if not start.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {start[:40]!r}")
        fields = _fields(_header_lines(stream))
        length = int(fields["content-length"])
        end = stream.tell() + length
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        record = {
            "record_type": fields.get("warc-type"),
            "page_id": _page(fields.get("warc-record-id")) if PAGE_URN in fields.get("warc-record-id", "") else None,
            "target_uri": fields.get("warc-target-uri"),
            "payload_bytes": int(fields["x-payload-bytes"]) if "x-payload-bytes" in fields else None,
            "payload_digest": digest,
            "refers_to": _page(fields.get("warc-refers-to")),
            "payload": None,
        }
        if wanted(record):
            if with_payload and record["record_type"] == "response":
                stream.readline()
                http = _fields(_header_lines(stream))
                payload = stream.read(end - stream.tell())
                if http.get("content-encoding") == "gzip":
                    payload = gzip.decompress(payload)
                if digest and payload_digest(payload) != digest:
                    raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
                record |= {"payload": payload, "payload_bytes": len(payload)}
            yield record
        stream.seek(end)


def _test(f: Filter):
    """A check of a header field by a pushed filter, or None where the filter cannot be pushed."""
    if isinstance(f, Not):
        inner = _test(f.child)
        # null compares to nothing, also negated
        return inner and (lambda r: (x := inner(r)) is not None and not x)
    if len(f.attribute) != 1 or f.attribute[0] == "payload":
        return None
    name = f.attribute[0]
    if isinstance(f, IsNull):
        return lambda r: r[name] is None
    if isinstance(f, IsNotNull):
        return lambda r: r[name] is not None
    if isinstance(f, EqualNullSafe):
        return lambda r: r[name] == f.value
    compare = {
        EqualTo: lambda v: v == f.value,
        GreaterThan: lambda v: v > f.value,
        GreaterThanOrEqual: lambda v: v >= f.value,
        LessThan: lambda v: v < f.value,
        LessThanOrEqual: lambda v: v <= f.value,
        In: lambda v: v in f.value,
        StringStartsWith: lambda v: v.startswith(f.value),
        StringEndsWith: lambda v: v.endswith(f.value),
        StringContains: lambda v: f.value in v,
    }.get(type(f))
    return compare and (lambda r: None if r[name] is None else compare(r[name]))


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path = options["path"]
        self.target = int(options.get("partition_bytes", PARTITION_BYTES))
        self.columns = schema.fieldNames()
        self.kinds = {f.name: f.dataType.simpleString() for f in schema}
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = open_path(self.path)
        info = fs.get_file_info(f"{root}/{MANIFEST}")
        if info.is_file:
            with fs.open_input_stream(info.path) as listed:
                names = [x.split("\t") for x in listed.read().decode().splitlines()]
            sizes = [(f"{root}/{name}", int(size)) for size, name in names]
        else:
            found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
            sizes = [(f.path, f.size) for f in found if f.is_file and f.extension == "warc"]
        planned, held, size = [], [], 0
        for path, n in sorted(sizes):
            if held and size + n > self.target:
                planned.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*planned, Files(held)] if held or not planned else planned

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = open_path(self.path)
        tests = [_test(f) for f in self.filters]
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c, kinds[self.kinds[c]]) for c in self.columns])
        held: list[dict] = []
        size = 0
        for path in partition.paths:
            with io.BufferedReader(fs.open_input_file(path), 1 << 16) as stream:
                for record in read_records(stream, lambda r: all(t(r) for t in tests), "payload" in self.columns):
                    held.append({c: record[c] for c in self.columns})
                    size += len(record["payload"] or b"")
                    if size >= BATCH_BYTES or len(held) >= BATCH_RECORDS:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_path(self.path)
        fs.create_dir(root, recursive=True)
        done, out, size, name = [], None, 0, ""
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc", 0
                    out = fs.open_output_stream(f"{root}/{name}")
                size += out.write(record_bytes(row["page_id"], row["target_uri"], row["payload"] or b"", row["refers_to"]))
                if size >= self.file_bytes:
                    out.close()
                    done.append((size, name))
                    out = None
        if out is not None:
            out.close()
            done.append((size, name))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest names every file of this write and of earlier ones to the same path."""
        fs, root = open_path(self.path)
        fs.create_dir(root, recursive=True)
        target, old = f"{root}/{MANIFEST}", b""
        if fs.get_file_info(target).is_file:
            with fs.open_input_stream(target) as listed:
                old = listed.read()
        lines = "".join(f"{size}\t{name}\n" for m in messages if m for size, name in m.files)
        with fs.open_output_stream(f"{target}.new") as out:
            out.write(old + lines.encode())
        fs.move(f"{target}.new", target)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_path(self.path)
        for m in messages:
            for _, name in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """format("warc"): reads SCHEMA or any part of it, writes WRITTEN."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    for_python(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, target_uri, payload and refers_to (the page whose payload is the same, else null).

    Of pages with equal payloads of at least ``min_bytes``, the one with the largest page_id
    keeps its payload and the others refer to it; rows that share that id all keep theirs.
    A null html is an empty payload; a page without an id refers to any that has one.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= min_bytes)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("pages")).filter("pages > 1 and last is not null")
    joined = salted_left_join(rows, groups.select("digest", "last"), "digest", F.struct("page_id", "target_uri"))
    other = F.coalesce(F.col("page_id") < F.col("last"), F.col("last").isNotNull())
    return joined.select("page_id", "target_uri", "payload", F.when(other, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    register(pages.sparkSession)
    revisits(pages, min_bytes).write.format("warc").mode("append").save(path)


def archive_table(pages: DataFrame) -> DataFrame:
    """Write the pages as WARC and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read with their payloads, which are checked and measured; of revisits only
    headers are read. Every page gives one record. An empty table gives no rows; other
    columns are ignored.
    """
    spark = pages.sparkSession
    path = shared_folder(spark, "archives")
    write_archives(pages, path)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = spark.read.format("warc").load(path).filter("record_type = 'response'")
    responses = responses.withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    again = spark.read.format("warc").schema(HEADERS).load(path).filter("record_type = 'revisit'")
    return responses.select(*names).unionByName(again.select(*names))
