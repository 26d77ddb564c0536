"""multipart/related: building, and incremental parsing that does not depend on how the bytes are chunked."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of one part that the incremental parser holds at most.
MAX_PART_BYTES = 256 << 20
# fixed value: the characters and length of a boundary
BOUNDARY = re.compile(r"[0-9A-Za-z'()+_,./:=? -]{0,69}[0-9A-Za-z'()+_,./:=?-]")


@dataclass(frozen=True)
class Part:
    body: bytes
    headers: dict[str, str] = field(default_factory=dict)

    @property
    def content_type(self) -> str | None:
        return self.headers.get("content-type")


def boundary_of(content_type: str) -> str:
    m = re.search(r';\s*boundary=(?:"([^"]+)"|([^";\s]+))', content_type, re.I)
    if not m:
        raise ValueError("the content type names no boundary")
    return m[1] or m[2]


def boundary_column(content_type: Column) -> Column:
    return F.regexp_extract(content_type, r'(?i)boundary="?([^";]+)"?', 1)


def new_boundary() -> str:
    return f"voxelake-{uuid.uuid4().hex}"


def generate(parts: Iterable[Part | bytes], content_type: str, boundary: str) -> Iterator[bytes]:
    """The body piece by piece; an error if there is no part."""
    if not BOUNDARY.fullmatch(boundary):
        raise ValueError("not a boundary")
    some = False
    for part in parts:
        some = True
        part = part if isinstance(part, Part) else Part(bytes(part))
        lines = {"content-type": content_type} | part.headers
        head = "".join(f"{k.title()}: {v}\r\n" for k, v in lines.items())
        yield f"--{boundary}\r\n{head}\r\n".encode("latin-1") + part.body + b"\r\n"
    if not some:
        raise ValueError("a multipart body needs a part")
    yield f"--{boundary}--\r\n".encode()


def build(parts: Iterable[Part | bytes], content_type: str = "application/dicom", boundary: str | None = None) -> tuple[bytes, str]:
    """(body, its content type)."""
    boundary = boundary or new_boundary()
    body = b"".join(generate(parts, content_type, boundary))
    return body, f'multipart/related; type="{content_type}"; boundary="{boundary}"'


def parse_headers(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode("latin-1").split("\r\n") if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(chunks: Iterable[bytes], content_type: str, max_part: int = MAX_PART_BYTES) -> Iterator[Part]:
    """Parts as soon as they are complete. A preamble is skipped; a last part that the stream cuts short still comes.

    A part of more than ``max_part`` bytes is an error; chunks may be of any size and hold any number of parts.
    """
    mark = b"\r\n--" + boundary_of(content_type).encode("latin-1")
    source, buffer, start, searched, inside = iter(chunks), bytearray(b"\r\n"), 0, 0, False

    def checked(end: int) -> bytes:
        if end - start > max_part:
            raise ValueError("a part is larger than allowed")
        return bytes(buffer[start:end])

    while True:
        at = buffer.find(mark, searched)
        if at < 0 or len(buffer) < at + len(mark) + 2:
            searched = at if at >= 0 else max(start, len(buffer) - len(mark))
            if not inside and at < 0:
                start = searched
            elif at < 0 and searched - start > max_part:
                raise ValueError("a part is larger than allowed")
            del buffer[:start]
            searched, start = searched - start, 0
            chunk = next(source, None)
            if chunk is None:
                break
            buffer += chunk
            continue
        if inside:
            yield _part(checked(at))
        end = at + len(mark)
        if buffer[end : end + 2] == b"--":
            return
        while (line := buffer.find(b"\r\n", end)) < 0:  # white space may follow the boundary
            chunk = next(source, None)
            if chunk is None:
                return
            buffer += chunk
        start, searched, inside = line, line, True
    if inside and len(buffer) > 2:
        yield _part(checked(len(buffer)))


def _part(raw: bytes) -> Part:
    head, _, body = raw.removeprefix(b"\r\n").partition(b"\r\n\r\n") if not raw.startswith(b"\r\n\r\n") else (b"", b"", raw[4:])
    return Part(body, parse_headers(head))


def parse_column(df: DataFrame, id_col: str, body_col: str, type_col: str) -> DataFrame:
    """(id, pos, headers map, body): a row per part of a column of multipart bodies."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, (body, content_type) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for pos, part in enumerate(parse([body], content_type)) if body else ():
                    at.append(i)
                    rows.append((pos, list(part.headers.items()), part.body))
            pos, headers, bodies = zip(*rows, strict=True) if rows else ([], [], [])
            arrays = [pa.array(pos, pa.int32()), pa.array(headers, pa.map_(pa.string(), pa.string())), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=[id_col, "pos", "headers", "body"])

    return df.select(F.col(id_col), F.col(body_col).cast("binary"), F.col(type_col)).mapInArrow(run, f"`{id_col}` {kind}, pos int, headers map<string, string>, body binary")


def build_column(df: DataFrame, id_col: str, bodies_col: str, content_type: str = "application/dicom", boundary: str = "voxelake-part") -> DataFrame:
    """(id, body, content_type): one multipart body per row of an array of binaries; null where the array is empty."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            built = [build(bodies, content_type, boundary) if bodies else (None, None) for bodies in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in built], pa.binary()), pa.array([t for _, t in built], pa.string())], names=[id_col, "body", "content_type"])

    return df.select(F.col(id_col), F.col(bodies_col).cast("array<binary>")).mapInArrow(run, f"`{id_col}` {kind}, body binary, content_type string")
