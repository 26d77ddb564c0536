"""WARC archives as a PySpark Python data source, and the deduplicating writer over it.

Writing: each task writes one file of gzip members, a member a record, under a name of its own; the driver's commit
lists the files of successful tasks in a manifest, so retried and speculative tasks leave nothing a reader sees.
Every member states its own compressed length in a gzip extra field, and the manifest has split points.

Reading: the driver plans partitions from the manifest's splits (or, without one, a partition per file). A task
parses the WARC headers of a record first and tests the pushed predicates on them; an unwanted payload is skipped by
seeking over the member, or over ``Content-Length`` in an uncompressed archive, without inflating it.

Options of reading: ``payload`` is ``full`` (bytes), ``digest`` (length and digest from the bytes, which stay in the
worker) or ``skip`` (header values only). ``where`` holds the pushed predicates on record type and headers, which
`scan` writes: equality, membership and prefix. They belong to one load. Spark keeps what a Python reader's own
``pushFilters`` records with the loaded relation, and would use it in later plans of the same DataFrame that have no
filter, or another one, so this reader has none: filters on a DataFrame are applied to the rows that it reads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from voxelake.llm.common import join_facts, new_path, written

MANIFEST = "_files.json"
SPLIT_BYTES = 16 << 20
BATCH_BYTES, BATCH_RECORDS = 8 << 20, 1000
#: The gzip extra subfield that holds the length of the member.
SKIP_ID = b"VX"
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, payload_length long, refers_to string, payload binary"
# fixed values: header names and the profile of revisit records
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
TESTS = {"eq": str.__eq__, "in": lambda own, values: own in values, "starts": str.startswith}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def build_record(row: dict) -> bytes:
    """One WARC 1.1 record: an HTTP response with the payload, or without it for a revisit."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['warc_date']}"]
    if row["target_uri"] is not None:
        # characters that would end or break a header line are percent-encoded
        lines.append("WARC-Target-URI: " + quote(row["target_uri"], safe="".join(map(chr, range(33, 127)))))
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    lines.append(f"X-Payload-Length: {len(payload)}")
    if revisit:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member with its own length in an extra field."""
    squeeze = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 4 + 8 + len(body) + 8
    extra = SKIP_ID + struct.pack("<HQ", 8, total)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Plain:
    """Bytes of a file from ``start`` up to ``end``."""

    def __init__(self, file, start: int, end: int):
        self.file, self.at, self.end, self.buffer = file, start, end, b""
        file.seek(start)

    def more(self) -> bool:
        piece = self.file.read(min(1 << 16, self.end - self.at))
        self.at += len(piece)
        self.buffer += piece
        return bool(piece)

    def unfinished(self) -> bool:
        return bool(self.buffer.strip())

    def header(self) -> bytes | None:
        """Up to the next empty line; None at the end."""
        seen = 0
        while (cut := self.buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.buffer)
            if not self.more():
                if self.unfinished():
                    raise EOFError("a record is cut short")
                return None
        head, self.buffer = self.buffer[:cut], self.buffer[cut + 4 :]
        return head

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self.more():
                raise EOFError("a record is cut short")
            parts.append(self.buffer)
            have += len(self.buffer)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        """Over the rest of a record."""
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.at += n - len(self.buffer)
            self.buffer = b""
            self.file.seek(self.at)


class _Gzip(_Plain):
    """The same over concatenated gzip members; a member that states its length is left by seeking."""

    def __init__(self, file, start: int, end: int):
        super().__init__(file, start, end)
        self.raw, self.member, self.next = b"", None, None

    def unfinished(self) -> bool:
        return self.member is not None or super().unfinished()

    def _raw(self, n: int) -> bytes:
        while len(self.raw) < n:
            piece = self.file.read(min(1 << 16, self.end - self.at))
            if not piece:
                break
            self.at += len(piece)
            self.raw += piece
        return self.raw[:n]

    def more(self) -> bool:
        if self.member is None:
            head = self._raw(12)
            if len(head) < 12:
                return False
            begin, self.next = self.at - len(self.raw), None
            if head[3] & 4:
                extra = self._raw(12 + struct.unpack_from("<H", head, 10)[0])[12:]
                while len(extra) >= 4:
                    n = struct.unpack_from("<H", extra, 2)[0]
                    if extra[:2] == SKIP_ID and n == 8:
                        self.next = begin + struct.unpack_from("<Q", extra, 4)[0]
                    extra = extra[4 + n :]
            self.member = zlib.decompressobj(31)
        if not self._raw(1):
            return False
        self.buffer += self.member.decompress(self.raw, 1 << 18)
        self.raw = self.member.unconsumed_tail or self.member.unused_data
        if self.member.eof:
            self.member = None
        return True

    def skip(self, n: int) -> None:
        if self.member is not None and self.next is not None:
            self.buffer, self.raw, self.member, self.at = b"", b"", None, self.next
            self.file.seek(self.at)
            return
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = b""
            if not self.more():
                raise EOFError("a record is cut short")
        self.buffer = self.buffer[n:]


def parse_header(head: bytes) -> dict[str, str]:
    """Field values by lower-cased name; folded lines belong to the line before."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def columns_of(fields: dict[str, str]) -> dict:
    """The header columns of a record."""
    row = {column: fields.get(name.lower()) for column, name in HEADERS.items()}
    for column in ("record_id", "refers_to"):
        row[column] = row[column].strip("<>") if row[column] is not None else None
    row["payload_digest"] = row["payload_digest"].removeprefix("sha1:") if row["payload_digest"] else None
    row["payload_length"] = int(row["payload_length"]) if (row["payload_length"] or "").isdigit() else None
    return row


def records(stream: _Plain, wanted, payload: str) -> Iterator[dict]:
    """Rows of the records whose header columns ``wanted`` accepts."""
    while (head := stream.header()) is not None:
        fields = parse_header(head)
        length = int(fields.get("content-length", "0"))
        row = columns_of(fields) | {"payload": None}
        if not wanted(row):
            stream.skip(length + 4)
            continue
        if payload == "skip" or row["record_type"] == "revisit":
            stream.skip(length + 4)
        else:
            block = stream.take(length + 4)[:length]
            body = block.split(b"\r\n\r\n", 1)[-1] if fields.get("content-type", "").startswith("application/http") else block
            row["payload_length"], row["payload_digest"] = len(body), base32_sha1(body)
            row["payload"] = body if payload == "full" else None
        yield row


@dataclass
class Split(InputPartition):
    """Records of a file that start at ``start`` or after, before ``end``."""

    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    splits: list[int]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.tests = options["path"].rstrip("/"), options.get("payload", "full"), json.loads(options.get("where", "[]"))
        if odd := [t for t in self.tests if t[0] not in TESTS or t[1] not in HEADERS or t[1] == "payload_length"]:
            raise ValueError(f"no predicate on a header column: {odd}")

    def partitions(self):
        from pyarrow import fs

        store, root = _filesystem(self.path)
        found = store.get_file_info(f"{root}/{MANIFEST}")
        if found.type == fs.FileType.File:
            with store.open_input_stream(f"{root}/{MANIFEST}") as file:
                listed = json.loads(file.read())
            return [Split(f"{self.path}/{name}", a, e) for name, cuts in listed for a, e in zip(cuts, cuts[1:])]  # noqa: B905
        infos = store.get_file_info(fs.FileSelector(root))
        return [Split(f"{self.path}/{x.base_name}", 0, x.size) for x in infos if x.base_name.endswith((".warc", ".warc.gz"))]

    def wanted(self, row: dict) -> bool:
        return all(row[column] is not None and TESTS[kind](row[column], value) for kind, column, value in self.tests)

    def read(self, partition):
        if partition is None:  # an archive without a file
            return
        store, path = _filesystem(partition.path)
        with store.open_input_file(path) as file:
            stream = (_Gzip if path.endswith(".gz") else _Plain)(file, partition.start, partition.end)
            rows, size = [], 0
            for row in records(stream, self.wanted, self.payload):
                rows.append(row)
                size += 500 + len(row["payload"] or b"")
                if size > BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                    yield self.batch(rows)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


class WarcWriter(DataSourceArrowWriter):
    """Rows of `SCHEMA` (payload_digest and payload_length are computed) into gzip members."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, iterator):
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        name, at, cuts = f"warc-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    member = gzip_member(build_record(row))
                    out.write(member)
                    at += len(member)
                    if at - cuts[-1] >= SPLIT_BYTES:
                        cuts.append(at)
        if cuts[-1] != at:
            cuts.append(at)
        if at == 0:
            store.delete_file(f"{root}/{name}")
        return Written(name if at else None, cuts)

    def commit(self, messages):
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        listed = sorted([m.name, m.splits] for m in messages if m is not None and m.name)
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages):
        store, root = _filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/{m.name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def scan(spark: SparkSession, path: str, payload: str = "full", where: Iterable[tuple] = ()) -> DataFrame:
    """The records of an archive that meet all of ``where``: ("eq", column, value), ("in", column, values) or
    ("starts", column, prefix) on a header column, which a null never meets. They are tested on the parsed headers,
    before the payload is decoded."""
    register(spark)
    return spark.read.format("warc").option("payload", payload).option("where", json.dumps([list(t) for t in where])).load(path)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archive every row: the payload is the html in UTF-8, null as empty.

    Of rows with equal payloads of ``least`` bytes or more, those with the smallest id are responses (more than one
    only if rows repeat an id) and the others revisit it; a null id never is the smallest, and rows of a payload
    that only null ids have are all responses. Digests of payloads that occur once are not carried on; the table of
    the others is joined by digest, so that no task gets all rows of a frequent one (`join_facts`). Null urls have no
    target header, texts of any length are one record each, and other columns are ignored. An empty table gives an
    archive without a file.
    """
    register(pages.sparkSession)
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"), body.alias("__body"))
    digest = F.when(F.octet_length("__body") >= least, F.sha1("__body"))
    groups = rows.select(digest.alias("__digest"), "__id").filter("__digest is not null").groupBy("__digest")
    groups = groups.agg(F.min("__id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1 and __first is not null")
    groups = written(groups.select("__digest", "__first", "__n"), "digests")
    rows = join_facts(rows.withColumn("__digest", digest), groups, ["__digest"], "__n", F.struct("__id", "__url"))
    revisit = F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = rows.select(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        urn("__id").alias("record_id"),
        F.col("__url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.lit(None).cast("long").alias("payload_length"),
        F.when(revisit, urn("__first")).alias("refers_to"),
        F.col("__body").alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive that `write_pages` wrote.

    Responses are read with their payloads, whose length and digest are taken anew; of revisits only headers are read.
    Ids are of the type that ``id_type`` names and null if they were; one that is not of it is an error.
    """
    own = lambda c: F.expr(f"cast(nullif(substring({c}, 10), '') as {id_type})")
    parts = []
    for kind, payload in (("response", "digest"), ("revisit", "skip")):
        df = scan(spark, path, payload, [("eq", "record_type", kind)])
        parts.append(df.select(own("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", own("refers_to").alias("refers_to")))
    return parts[0].unionByName(parts[1])


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages to a new archive in the shared folder and read it back: `read_pages` of `write_pages`, whose
    docstrings say what becomes of nulls, ties, repeated rows and empty tables. Every row of ``pages`` is a row."""
    path = new_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())
