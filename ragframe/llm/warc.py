"""WARC archives: a Spark data source that writes and reads them, and the deduplicating writer of web pages.

A file is a sequence of gzip members, one per record. The reader plans files as partitions and decides equality filters
on header columns before a payload is decoded: a record's headers are parsed first, and only a record that passes them,
in a read that wants payloads, has its body decoded. Filters come as options of one read (Spark keeps a reader with
the DataFrame, so filters it had taken over in one plan would hold in every later one); filters on the DataFrame push
nothing down and are right as well. Tasks write files of their own names; the commit lists those of
successful tasks in a manifest, so attempts that were lost or repeated leave nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from ragframe.llm.common import Batches, may_hold, membership, raw_text, saved, text_batches
from ragframe.session import new_path

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
HEADER_BYTES = 4 << 10
# Leading bytes of a digest that its place in a membership filter follows from.
HEAD_BYTES = 7

# column -> record header it is read from; filters on these are decided before a payload is decoded
HEADERS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "X-Refers-To-Page-Id",
    "page_id": "X-Page-Id",
    "payload_length": "X-Payload-Length",
}
READ_SCHEMA = ", ".join(f"{name} string" for name in HEADERS) + ", payload binary"
# Columns that may hold any text, percent-encoded in their headers; a null one has no header.
ENCODED = ("target_uri", "refers_to", "page_id")
SAFE = "!#$&'()*+,/:;=?@[]-._~"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encoded(value) -> str | None:
    """A header's text: on one line and reversible; None for null."""
    return None if value is None else quote(str(value), safe=SAFE)


def record_id(page_id) -> str:
    """The id of a page's record; pages without an id share one."""
    name = "no page" if page_id is None else f"page:{encoded(page_id)}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class WarcDataSource(DataSource):
    """``format("warc")``. Option ``path``: a folder; option ``payload``: "false" leaves all payloads undecoded.

    Option ``wanted``: JSON of column -> list of values; records with other values are passed over by their headers.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        wanted = json.loads(self.options.get("wanted", "{}"))
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", wanted)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


@dataclass
class ArchiveFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows (warc_type, target_uri, page_id, refers_to, digest, length, date, payload) -> archive files and a manifest."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)
        files: list[str] = []
        out = None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out = system.open_output_stream(f"{root}/{files[-1]}", compression=None)
                    out.write(page_record(row))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written]) -> None:
        """Files without a manifest are not read."""


def page_record(row: dict) -> bytes:
    """The record of one page row."""
    revisit = row["warc_type"] == "revisit"
    body = row["payload"] or b""
    headers = {
        "WARC-Type": row["warc_type"],
        "WARC-Record-ID": record_id(row["page_id"]),
        "WARC-Date": row["date"],
        "WARC-Target-URI": encoded(row["target_uri"]),
        "WARC-Payload-Digest": f"sha1:{row['digest']}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": encoded(row["page_id"]),
        "X-Payload-Length": str(row["length"]),
    }
    if revisit:
        headers["WARC-Profile"] = REVISIT_PROFILE
        headers["WARC-Refers-To"] = record_id(row["refers_to"])
        headers["X-Refers-To-Page-Id"] = encoded(row["refers_to"])
    headers = {name: value for name, value in headers.items() if value is not None}
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['length']}\r\n\r\n"
    return record(headers, block.encode() + (b"" if revisit else body))


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, wanted: dict[str, list]):
        self.path, self.payload = path, payload
        self.wanted = {column: set(values) for column, values in wanted.items()}

    def partitions(self) -> list[ArchiveFile]:
        system, root = _place(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        files: list[str] = []
        for info in found:
            if info.base_name.startswith("manifest-"):
                with system.open_input_stream(info.path) as manifest:
                    files += json.loads(manifest.read())
        return [ArchiveFile(f"{root}/{name}") for name in sorted(files)] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = _place(self.path)
        with system.open_input_stream(partition.path, compression=None) as stream:
            for head, body in _members(stream):
                headers = parse_headers(head)
                # the row as it is returned, so that values are compared with what a filter would see
                row = {c: headers.get(name) for c, name in HEADERS.items()}
                row |= {c: unquote(row[c]) for c in ENCODED if row[c] is not None}
                if any(row[c] not in values for c, values in self.wanted.items()):
                    continue
                payload = None
                if self.payload and row["warc_type"] == "response":
                    payload = body().partition(b"\r\n\r\n")[2]
                yield (*row.values(), payload)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def _members(stream) -> Iterator[tuple[bytes, object]]:
    """(header block, function that decodes the record's block) of each gzip member.

    The compressed bytes of an unwanted payload are passed over in pieces; they are inflated to find the member's end,
    since gzip does not state it, but neither joined nor parsed.
    """
    waiting = b""
    while True:
        waiting = waiting or stream.read(READ_BYTES)
        if not waiting:
            return
        inflate, seen = zlib.decompressobj(31), b""
        while b"\r\n\r\n" not in seen and not inflate.eof:
            piece = inflate.unconsumed_tail or waiting or stream.read(READ_BYTES)
            if not piece:
                raise ValueError("the archive ends within a record's headers")
            waiting = b""
            seen += inflate.decompress(piece, HEADER_BYTES)
        head, _, start = seen.partition(b"\r\n\r\n")
        state = {"rest": None}

        def rest(keep: bool, inflate=inflate, state=state, start=start) -> bytes:
            parts = [start]
            tail = inflate.unconsumed_tail
            while not inflate.eof:
                piece = tail or stream.read(READ_BYTES)
                if not piece:
                    raise ValueError("the archive ends within a record")
                out = inflate.decompress(piece, READ_BYTES)
                tail = inflate.unconsumed_tail
                if keep:
                    parts.append(out)
            state["rest"] = inflate.unused_data
            return b"".join(parts)

        def body(rest=rest) -> bytes:
            # the record's block ends with two line ends
            return rest(True)[:-4]

        yield head, body
        if state["rest"] is None:
            rest(False)
        waiting = state["rest"]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives in ``path``.

    Null html is an empty payload; null ids and urls have no header and come back as null. Of equal payloads of at least ``least_bytes`` bytes the
    smallest page_id (a null one only if all are) has the response and the others are revisits of it; rows that repeat
    this id are responses as well. Other columns are ignored.
    """
    register(pages.sparkSession)
    id_type = pages.schema["page_id"].dataType.simpleString()
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def digested(suspects: np.ndarray | None) -> Callable[[Batches], Batches]:
        """Adds digests, and whether ``suspects`` may hold the payload's."""

        def run(batches: Batches) -> Batches:
            for batch in batches:
                payloads = [p or b"" for p in batch.column("payload").to_pylist()]
                strong = [hashlib.sha256(p).digest() for p in payloads]
                heads = np.array([int.from_bytes(s[:HEAD_BYTES], "big") for s in strong], np.int64)
                held = np.zeros(len(strong), bool) if suspects is None else may_hold(suspects, heads)
                columns = [
                    pa.array([payload_digest(p) for p in payloads], pa.string()),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array(strong, pa.binary()),
                    pa.array(held),
                ]
                names = [*batch.schema.names, "digest", "length", "strong", "suspect"]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

        return run

    pages = pages.select("page_id", F.col("url").cast("string").alias("target_uri"), raw_text("html").alias("payload"))
    schema = f"page_id {id_type}, target_uri string, payload binary, digest string, length bigint, strong binary, suspect boolean"
    firsts = text_batches(pages, digested(None), schema).where(F.col("length") >= least_bytes).groupBy("strong")
    firsts = firsts.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("records"))
    firsts = saved(firsts.where("records > 1").select("strong", "first"), "warc-firsts")
    head = F.conv(F.hex(F.substring("strong", 1, HEAD_BYTES)), 16, 10).cast("bigint")
    rows = text_batches(pages, digested(membership(firsts.select(head.alias("head")), hashed=True)), schema)
    # digests outside the filter occur once; only the records of the others move
    alone = rows.where("not suspect").withColumn("first", F.lit(None).cast(id_type))
    rows = rows.where("suspect").join(firsts, "strong", "left").unionByName(alone)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        "target_uri",
        "page_id",
        F.when(again, F.col("first")).alias("refers_to"),
        "digest",
        "length",
        F.lit(date).alias("date"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    rows.write.format("warc").mode("append").option("path", path).save()


def read_archives(spark: SparkSession, path: str, payload: bool = True, **wanted) -> DataFrame:
    """The records below ``path``: header columns as text, and the payload of responses.

    ``wanted`` names header columns and the value, or list of values, that records must have there; others are passed
    over before their payload is decoded.
    """
    if unknown := wanted.keys() - HEADERS.keys():
        raise ValueError(f"no header columns: {sorted(unknown)}")
    register(spark)
    lists = {c: [str(v) for v in (values if isinstance(values, list | tuple | set) else [values])] for c, values in wanted.items()}
    reader = spark.read.format("warc").option("path", path).option("payload", str(payload).lower())
    return reader.option("wanted", json.dumps(lists)).load()


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages``, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are measured on the payload as read, and must agree with their headers; revisits, whose payload is not
    stored again, state it in their headers.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_pages(pages, path)
    kind = pages.schema["page_id"].dataType

    def measured(batches: Batches) -> Batches:
        for batch in batches:
            payloads = [p or b"" for p in batch.column("payload").to_pylist()]
            digests = [payload_digest(p) for p in payloads]
            if [f"sha1:{d}" for d in digests] != batch.column("payload_digest").to_pylist():
                raise ValueError("a payload does not have the digest of its record")
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(map(len, payloads), pa.int64()), pa.array(digests, pa.string())],
                ["page_id", "payload_bytes", "payload_digest"],
            )

    responses = read_archives(spark, path, warc_type="response").select("page_id", "payload_digest", "payload")
    responses = text_batches(responses, measured, "page_id string, payload_bytes bigint, payload_digest string")
    responses = responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("string")})
    revisits = read_archives(spark, path, payload=False, warc_type="revisit").select(
        "page_id",
        F.col("payload_length").cast("long").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        "refers_to",
    )
    both = responses.unionByName(revisits)
    ids = {c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}
    return both.withColumns(ids)
