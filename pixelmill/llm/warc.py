"""WARC archives as a PySpark Python data source (read and write).

Reading plans one partition per run of files of about ``partition_bytes``; comparisons on
the record type and on header columns are pushed down.  For each record the WARC header is
parsed first; a record that the pushed predicates reject is stepped over, and the payload of
one that passes is decoded only when the payload column is asked for (option ``payload``).
Archives are plain or gzipped, one member per record or one for all.

Writing takes the same columns and makes one archive per task, gzipped record by record.  Each
write has a folder of its own for the attempts of its tasks, and names that no other write has;
only committed attempts are moved to their place, so lost executors, repeated attempts and
writes at the same time leave no record twice and none out.  Files and folders whose names begin
with ``_`` or ``.`` aren't read.

Cases: an empty payload is a record with an empty body; a revisit has the HTTP header (with
the full payload's length) and no payload; further WARC headers are in ``headers``; an HTTP
length that is no number is null; a block without the empty line that ends an HTTP header is
payload as a whole; bytes after the last whole record, a header that doesn't end within
``MAX_HEADER`` bytes and a WARC length that is no number raise; an empty folder gives no rows.
Of ``archive_pages``: a null payload is empty; a page without an id keeps its payload and refers
to nothing; of a repeated id with one payload each row is a response if the id is the smallest;
further columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceArrowWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from pixelmill.session import new_path

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, "
    "content_length bigint, http_length bigint, headers map<string,string>, payload binary"
)
#: The header line of a column.
HEADER = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
_ARROW = pa.schema([
    *[(n, pa.string()) for n in HEADER], ("content_length", pa.int64()), ("http_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])
READ_SIZE = 1 << 20
MAX_HEADER = 16 << 20


def _fs(path: str):
    """The file system of ``path`` and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class _Stream:
    """Buffered bytes of an archive, decompressed if gzipped, with exact reads and cheap skips."""

    def __init__(self, raw):
        self.raw, self.buf, self.at, self.more = raw, b"", 0, True
        head = raw.read(READ_SIZE)
        self.zip = zlib.decompressobj(31) if head[:2] == b"\x1f\x8b" else None
        self._take(head)

    def _take(self, data: bytes) -> None:
        if not data:
            self.more = False
            return
        if self.zip is None:
            out = data
        else:
            parts = []
            while data:
                parts.append(self.zip.decompress(data))
                data = self.zip.unused_data
                if self.zip.eof:
                    self.zip = zlib.decompressobj(31)
                else:
                    break
            out = b"".join(parts)
        self.buf, self.at = self.buf[self.at :] + out, 0

    def _fill(self, n: int) -> bool:
        if len(self.buf) - self.at >= n:
            return True
        held, size = [self.buf[self.at :]], len(self.buf) - self.at
        while size < n and self.more:
            self.buf, self.at = b"", 0
            self._take(self.raw.read(READ_SIZE))
            held.append(self.buf)
            size += len(self.buf)
        self.buf, self.at = b"".join(held), 0
        return size >= n

    def end(self) -> bool:
        while not self._fill(1):
            if not self.more:
                return True
        return False

    def line_block(self, most: int | None = None) -> bytes | None:
        """Bytes up to and without the next empty line; None, and nothing taken, if there is none within ``most`` bytes."""
        limit, n = most if most is not None else MAX_HEADER, 4096
        while True:
            n = min(n, limit)
            whole = self._fill(n)
            k = self.buf.find(b"\r\n\r\n", self.at, self.at + n)
            if k >= 0:
                out = self.buf[self.at : k]
                self.at = k + 4
                return out
            if n == limit and most is not None and whole:
                return None
            if not whole or n == limit:
                raise ValueError("an archive ends within a header" if not whole else "a header is too long")
            n *= 4

    def read(self, n: int) -> bytes:
        if not self._fill(n):
            raise ValueError("an archive ends within a record")
        out = self.buf[self.at : self.at + n]
        self.at += n
        return out

    def skip(self, n: int) -> None:
        while n:
            have = min(n, len(self.buf) - self.at)
            self.at += have
            n -= have
            if n and not self._fill(1):
                raise ValueError("an archive ends within a record")


def _fields(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _length(value: str | None) -> int | None:
    """A length that is a plain number, else None."""
    return int(value) if value is not None and re.fullmatch(r"[0-9]{1,18}", value) else None


def read_records(raw, wanted: list[tuple[str, list]], payload: bool) -> Iterator[tuple]:
    """Rows of one archive; ``wanted``: (column, allowed values, or None for not null)."""
    stream = _Stream(raw)
    while not stream.end():
        head = _fields(stream.line_block())
        size = _length(head.get("content-length"))
        if size is None:
            raise ValueError(f"a record's length is {head.get('content-length')!r}")
        row = {c: head.get(h) for c, h in HEADER.items()}
        if any(row[c] is None if allowed is None else row[c] not in allowed for c, allowed in wanted):
            stream.skip(size + 4)
            continue
        http, body, left = None, None, size
        if head.get("content-type", "").startswith("application/http") and (block := stream.line_block(size)) is not None:
            left = size - len(block) - 4
            http = _length(_fields(block).get("content-length"))
        if payload:
            body = stream.read(left)
        else:
            stream.skip(left)
        stream.skip(4)
        rest = [(k, v) for k, v in head.items() if k not in HEADER.values()]
        yield (*row.values(), size, http, rest, body)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.size = int(options.get("partition_bytes", 64 << 20))
        self.wanted: list[tuple[str, list | None]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADER and isinstance(f, EqualTo):
                self.wanted.append((name, [f.value]))
            elif name in HEADER and isinstance(f, In):
                self.wanted.append((name, list(f.value)))
            elif name in HEADER and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, path = _fs(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        runs, size = [[]], 0
        for f in sorted(files, key=lambda x: x.path):
            below = f.path[len(path) :] if f.path.startswith(path) and f.path != path else ""
            if f.type != fs.FileType.File or any(x[0] in "._" for x in below.split("/") if x):
                continue
            if runs[-1] and size + f.size > self.size:
                runs.append([])
                size = 0
            runs[-1].append(f.path)
            size += f.size
        return [_Files(r) for r in runs]

    def read(self, partition):
        store, _ = _fs(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                for row in read_records(raw, self.wanted, self.payload):
                    rows.append(row)
                    size += 300 + len(row[-1] or b"")
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Written(WriterCommitMessage):
    def __init__(self, name: str, records: int):
        self.name, self.records = name, records


def record_bytes(row: dict) -> bytes:
    """One record: WARC header, and an HTTP response with (or, for a revisit, without) its payload."""
    body = row["payload"] or b""
    length = row.get("http_length")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n".encode()
    lines = ["WARC/1.1"]
    for column, name in HEADER.items():
        if row.get(column) is not None:
            value = str(row[column]).replace("\r", " ").replace("\n", " ")
            lines.append(f"{'-'.join(x.upper() if x == 'warc' else x.title() for x in name.split('-'))}: {value}")
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(http) + len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.level = int(options.get("level", 3))
        self.write_id = uuid.uuid4().hex  # made once, on the driver
        self.attempts = f"_attempts-{self.write_id}"

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{self.write_id}-{task.taskAttemptId()}.warc.gz"
        store, folder = _fs(self.path)
        n = 0
        store.create_dir(f"{folder}/{self.attempts}", recursive=True)
        with store.open_output_stream(f"{folder}/{self.attempts}/{name}", compression=None) as out:
            for batch in iterator:
                columns = [c for c in batch.schema.names if c in HEADER or c in ("http_length", "payload")]
                for values in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)):
                    out.write(gzip.compress(record_bytes(dict(zip(columns, values))), self.level, mtime=0))
                    n += 1
        return _Written(name, n)

    def commit(self, messages):
        from pyarrow import fs

        store, folder = _fs(self.path)
        for m in messages:
            if m is not None and m.records:
                store.move(f"{folder}/{self.attempts}/{m.name}", f"{folder}/{m.name}")
        if store.get_file_info(f"{folder}/{self.attempts}").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/{self.attempts}")
        with store.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(json.dumps({"records": sum(m.records for m in messages if m is not None)}).encode())

    def abort(self, messages):
        from pyarrow import fs

        store, folder = _fs(self.path)
        if store.get_file_info(f"{folder}/{self.attempts}").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/{self.attempts}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32_sha1(data) -> F.Column:
    """Bare upper-case base32 of the SHA-1 of a string or binary column, without Python."""
    hexed = F.sha1(data)
    part = [F.lpad(F.conv(F.substr(hexed, F.lit(5 * i + 1), F.lit(5)), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """The records to write: of equal payloads of ``min_bytes`` or more the smallest id is response, others are revisits.

    Equality is that of SHA-256 and length.  Only ids and digests are grouped and joined with
    the pages; the shuffle before the join lets AQE split the partitions of a hot payload.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("body"))
    p = p.withColumns({"size": F.octet_length("body").cast("long"), "key": F.unhex(F.sha2("body", 256))})
    first = p.where(F.col("size") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    first = first.select("key", "first_id").repartition("first_id")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    again = F.coalesce(F.col("first_id") != F.col("page_id"), F.lit(False))  # a page without an id keeps its payload
    return p.join(first, "key", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.concat(F.lit("sha1:"), base32_sha1("body")).alias("payload_digest"),
        F.when(again, urn(F.col("first_id"))).alias("refers_to"),
        F.lit(None).cast("long").alias("content_length"),
        F.col("size").alias("http_length"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(~again, F.encode("body", "UTF-8")).alias("payload"),
    )


def write_archive(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read every record back.

    Responses are read with their payload, whose length and digest are those of the bytes
    read; revisits are read by their headers alone.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(plan_records(pages), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    full = read_archive(spark, path).where("record_type = 'response'")
    full = full.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1("payload").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    light = read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    light = light.select(number("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return full.unionByName(light)
