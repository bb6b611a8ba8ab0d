"""WARC archives as a Spark data source, and archiving of pages with revisits.

``spark.read.format("warc")`` gives one row per record. Each file is a partition. Predicates on the
record type and on other header columns go down to the reader: it parses a record's header first
and decodes the payload only when the header meets them and the payload is asked for (option
``payload``, default true). Compressed records carry their length in the gzip member's header, so
a record that is not wanted is passed over without inflating it; members without that length, and
plain files, are read as well.

``df.write.format("warc")`` writes one gzip member per record. A task starts a new file after
``file_bytes`` of payload, so that no partition of a later read is larger, and its files get their
names when the whole job has succeeded.

Files are reached through ``pyarrow.fs``, so a path may be a folder of any store it knows. Reading
holds one record at a time besides a small batch.

Defined results: a null payload is written as an empty one, a null header is left out. Records with
repeated ids stay separate. An empty table gives an archive without records, and a folder without
files reads as no rows.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from rungwise.session import checkpoint_root, materialize

FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
BATCH_RECORDS = 512
DATE = "2024-01-01T00:00:00Z"

# The header names of the format behind each column.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
LENGTH_HEADER = "X-Payload-Length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_length bigint, content_length bigint, payload binary"
_END = b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """One gzip member with its own length in an extra field."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    length = 10 + 2 + 12 + len(body) + len(tail)
    if length >= 1 << 32 or len(data) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, length, len(data))
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def format_record(values: dict[str, str | None], payload: bytes) -> bytes:
    """A record as it stands in an archive: header, then an HTTP response as its block."""
    length = values.get("payload_length")
    length = len(payload) if length is None else length
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % length + _END + payload
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        value = "application/http; msgtype=response" if column == "content_type" else values.get(column)
        if value is not None:
            # A line break would end the header.
            lines.append(f"{header}: {' '.join(str(value).splitlines())}")
    if values.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += [f"{LENGTH_HEADER}: {length}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


class _Members:
    """The records of a compressed file, one after another.

    A member that states its own length holds one record, and is passed over by a seek. Others are
    inflated through to their ends, since they may hold any number of records; what is passed over is
    dropped as it comes.
    """

    def __init__(self, file) -> None:
        self.file = file
        self.packer = None
        self.data = bytearray()

    def _open(self) -> bool:
        self.start = self.file.tell()
        head = self.file.read(12)
        if len(head) < 12 or head[:2] != b"\x1f\x8b":
            return False
        self.length, self.begun = 0, False
        if head[3] & 4:
            extra = self.file.read(struct.unpack("<H", head[10:12])[0])
            while len(extra) >= 4:
                size = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and size == 8:
                    self.length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + size :]
        self.file.seek(self.start)
        self.packer = zlib.decompressobj(31)
        return True

    def _close(self) -> None:
        self.file.seek(self.start + self.length if self.length else self.file.tell() - len(self.packer.unused_data))
        self.packer = None
        self.data.clear()

    def _more(self) -> bool:
        chunk = b"" if self.packer.eof else self.file.read(1 << 16)
        self.data += self.packer.decompress(chunk)
        return bool(chunk)

    def next(self) -> bool:
        """Whether another record begins, in this member or a later one."""
        while self.packer is not None or self._open():
            if not (self.length and self.begun):
                while True:
                    del self.data[: len(self.data) - len(self.data.lstrip(b"\r\n"))]
                    if self.data:
                        self.begun = True
                        return True
                    if not self._more():
                        break
                if not self.packer.eof:
                    return False
            self._close()
        return False

    def until(self, mark: bytes) -> bytes:
        """What stands before ``mark``, which is passed."""
        seen = 0
        while (at := self.data.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.data)
            if not self._more():
                at = seen
                break
        found = bytes(self.data[:at])
        del self.data[: at + len(mark)]
        return found

    def take(self, size: int) -> bytes:
        """The next ``size`` bytes."""
        while len(self.data) < size and self._more():
            pass
        found = bytes(self.data[:size])
        del self.data[:size]
        return found

    def skip(self, size: int) -> None:
        """Passes over ``size`` bytes. The rest of a member of known length needs no reading."""
        while size and not self.length:
            size -= (passed := min(size, len(self.data)))
            del self.data[:passed]
            if size and not self._more():
                break


class _Plain:
    """The records of an uncompressed file."""

    def __init__(self, file) -> None:
        self.file = file

    def next(self) -> bool:
        """Whether another record begins here, after any blank lines."""
        while byte := self.file.read(1):
            if byte not in b"\r\n":
                self.file.seek(self.file.tell() - 1)
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        found = b""
        start = self.file.tell()
        while mark not in found:
            chunk = self.file.read(1 << 12)
            if not chunk:
                return found
            found += chunk
        found = found.partition(mark)[0]
        self.file.seek(start + len(found) + len(mark))
        return found

    def take(self, size: int) -> bytes:
        return self.file.read(size)

    def skip(self, size: int) -> None:
        self.file.seek(self.file.tell() + size)


def read_records(file, wanted, with_payload: bool) -> Iterator[tuple]:
    """The records of an open archive whose header columns satisfy ``wanted``, as rows of READ_SCHEMA."""
    start = file.read(2)
    file.seek(0)
    records = _Members(file) if start == b"\x1f\x8b" else _Plain(file)
    columns = {header.lower(): column for column, header in HEADERS.items()}
    while records.next():
        lines = records.until(_END).decode("utf-8", "replace").split("\r\n")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        row = {columns[name]: value for name, value in fields.items() if name in columns}
        length = int(fields.get("content-length", 0))
        if not wanted(row):
            records.skip(length)
            continue
        payload = None
        if with_payload:
            payload = records.take(length)
            if row.get("content_type", "").startswith("application/http"):
                payload = payload.partition(_END)[2]
        else:
            records.skip(length)
        own = fields.get(LENGTH_HEADER.lower())
        yield (*[row.get(c) for c in HEADERS], int(own) if own else None, length, payload)


def _meets(filters: Sequence[Filter], row: dict[str, str]) -> bool:
    for f in filters:
        value = row.get(f.attribute[0])
        if value is None:
            return False
        if isinstance(f, EqualTo) and value != f.value:
            return False
        if isinstance(f, In) and value not in f.value:
            return False
        if isinstance(f, StringStartsWith) and not value.startswith(f.value):
            return False
    return True


@dataclass
class ArchiveFile(InputPartition):
    """One archive of a read."""

    path: str


class WarcReader(DataSourceReader):
    """Plans one partition per file and reads records that meet the header predicates."""

    def __init__(self, path: str, with_payload: bool) -> None:
        self.path = path
        self.with_payload = with_payload
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over the predicates on header columns."""
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and f.attribute[0] in HEADERS and getattr(f, "value", "") is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """The archives of the folder, hidden and unfinished files left out."""
        system, root = fs.FileSystem.from_uri(self.path)
        listed = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(f.path for f in listed if f.is_file and not f.base_name.startswith((".", "_")))
        return [ArchiveFile(name) for name in names] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        """Rows of one archive in small batches."""
        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        schema = pa.schema(
            [(c, pa.string()) for c in HEADERS] + [("payload_length", pa.int64()), ("content_length", pa.int64()), ("payload", pa.binary())]
        )
        held: list[tuple] = []
        size = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
        with system.open_input_file(partition.path) as raw:
            file = io.BufferedReader(raw, 1 << 16)
            for row in read_records(file, lambda r: _meets(self.filters, r), self.with_payload):
                held.append(row)
                size += len(row[-1] or b"")
                if size > BATCH_BYTES or len(held) >= BATCH_RECORDS:
                    yield batch()
                    held, size = [], 0
            if held:
                yield batch()


@dataclass
class WrittenFiles(WriterCommitMessage):
    """What a task has written under unfinished names."""

    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes records under unfinished names and renames them when all tasks have succeeded."""

    def __init__(self, path: str, file_bytes: int) -> None:
        self.path = path
        self.file_bytes = file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        """The files of one task."""
        system, root = fs.FileSystem.from_uri(self.path)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                columns = {name: batch.column(name) for name in batch.schema.names}
                for i in range(batch.num_rows):
                    values = {name: column[i].as_py() for name, column in columns.items()}
                    payload = values.pop("payload") or b""
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{root}/_{names[-1]}", compression=None), 0
                    out.write(_member(format_record(values, payload)))
                    size += len(payload)
                    if size > self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return WrittenFiles(names)

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        """Gives the files their names."""
        system, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        """Removes the unfinished files."""
        system, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for name in message.names if message else ():
                system.delete_file(f"{root}/_{name}")


class WarcSource(DataSource):
    """The data source ``warc``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to; choose a new folder")
        system, root = fs.FileSystem.from_uri(self.options["path"])
        system.create_dir(root, recursive=True)
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes ``warc`` known to the session and lets it take predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_digest(data: Column) -> Column:
    """SHA-1 in base 32: each five hex digits are four digits of base 32 in the usual alphabet."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame) -> DataFrame:
    """Records of pages: of equal payloads the one with the largest page_id is the response.

    Rows that share the largest page_id are all responses. A page with a null id revisits the
    response of its group, and is a response where no page of the group has an id.
    """
    read = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn(
        "key", F.sha2("payload", 256)
    )
    groups = materialize(
        read.groupBy("key").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1 and keep is not null").select("key", "keep"),
        "warc-groups",
    )
    # Small rows meet the groups first, so that a hot payload is never moved to one task.
    others = materialize(
        read.select("page_id", "key").join(groups, "key").filter(~F.col("page_id").eqNullSafe(F.col("keep"))).distinct(), "warc-revisits"
    )
    joined = read.alias("r").join(
        others.alias("o"), F.col("r.page_id").eqNullSafe(F.col("o.page_id")) & (F.col("r.key") == F.col("o.key")), "left"
    )
    name = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">")))
    again = F.col("o.keep").isNotNull()
    return joined.select(
        F.coalesce(name(F.col("r.page_id")), F.lit("<urn:x-page:>")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("r.url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        name(F.col("o.keep")).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32_digest(F.col("r.payload"))).alias("payload_digest"),
        F.octet_length("r.payload").cast("bigint").alias("payload_length"),
        F.when(~again, F.col("r.payload")).alias("payload"),
    )


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Adds records to the archive folder ``path``."""
    register(records.sparkSession)
    records.write.format("warc").option("file_bytes", str(file_bytes)).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of all records below ``path``."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(name: Column) -> Column:
    """The page_id in a record's name."""
    digits = F.regexp_extract(name, "<urn:x-page:(-?[0-9]+)>", 1)
    return F.when(digits != "", digits.cast("bigint"))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages and describes what the archives hold: length and digest of every payload.

    Responses are measured on the payload that was read, revisits tell those of their response.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_root(spark)}/rungwise/warc-{uuid.uuid4().hex}"
    write_archives(page_records(pages), path)
    responses = read_archives(spark, path).filter(F.col("record_type") == "response")
    revisits = read_archives(spark, path, payload=False).filter(F.col("record_type") == "revisit")
    columns = lambda length, digest: (
        page_of(F.col("record_id")).alias("page_id"),
        length.cast("bigint").alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
    return responses.select(*columns(F.octet_length("payload"), base32_digest(F.col("payload")))).union(
        revisits.select(*columns(F.col("payload_length"), F.regexp_replace("payload_digest", "^sha1:", "")))
    )
