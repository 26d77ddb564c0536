"""Part 10 files: a parser, an encoder, and the ``dicom`` data source over them.

A file becomes a row of (path, dataset DICOM JSON text, pixel_data, error). What is not touched comes back as it was:

* ``pixel_data`` are the bytes of the file, in its byte order; of encapsulated pixels they are all items, the offset
  table first, as `fragments` and `frames` take them apart.
* Text is decoded by the character set that its dataset, or the one around it, declares. Text which that cannot decode
  stays bytes (``InlineBinary``).
* Writing takes the transfer syntax from the file meta (Explicit VR Little Endian if there is none) and encodes text
  by the declared character set; what that lacks is an error, never a substitute.

Metadata-only reading (``stopBeforePixels``) reads a file in growing steps and stops at the pixel data. A file that
cannot be read gives a row with its error, so one bad file does not end a job of millions.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from voxelake.dims import EXPLICIT_LITTLE, FILE_VR, NATIVE_SYNTAXES, TAG_OF
from voxelake.functions import charsets

PIXELS, CHARACTERS = TAG_OF["PixelData"], TAG_OF["SpecificCharacterSet"]
#: Files of one partition are planned up to this many bytes; folders that the driver lists itself, at most.
PARTITION_BYTES, LISTED_FOLDERS = 64 << 20, 512
#: A batch of rows is closed at this many bytes or rows; metadata are first sought in so many bytes of a file.
BATCH_BYTES, BATCH_ROWS, FIRST_BYTES = 8 << 20, 1000, 1 << 16
# fixed values: value representations by how their length and values are written
LONG = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
BYTES = {"OB", "OD", "OF", "OL", "OV", "OW", "UN"}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "UV": "Q", "SV": "q"}
TEXTS = {"LO", "LT", "PN", "SH", "ST", "UC", "UT"}
UNSPLIT = {"LT", "ST", "UT", "UR"}
UNDEFINED = 0xFFFFFFFF
IMPLICIT, DEFLATED, BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
IMPLEMENTATION = "2.25.304650834578612"
ITEM, END_ITEM, END_SEQUENCE = "FFFEE000", "FFFEE00D", "FFFEE0DD"


#: The folder of a target that tells of rows which could not be written.
FAILED = "_failed"


class CutShort(ValueError):
    """The bytes at hand end within an element."""


def text_of(raw: bytes, vr: str, charset) -> dict:
    """The element of a text value; bytes that the character set cannot decode stay bytes."""
    bare = raw.rstrip(b"\0") if vr == "UI" else raw.rstrip(b"\0 ")
    try:
        text = charsets.decode(bare, charset if vr in TEXTS else None)
    except ValueError:
        return {"vr": vr, "InlineBinary": base64.b64encode(raw).decode()}
    values = [text] if vr in UNSPLIT else text.split("\\")
    return {"vr": vr, "Value": [{"Alphabetic": v} if vr == "PN" else v for v in values]}


class _Reader:
    def __init__(self, data: bytes, explicit: bool, little: bool, stop: bool):
        self.data, self.explicit, self.order, self.stop = data, explicit, "<" if little else ">", stop
        self.pixels: bytes | None = None
        self.stopped = False

    def head(self, at: int) -> tuple[str, str, int, int]:
        """(tag, vr, length, where the value starts)."""
        if at + 8 > len(self.data):
            raise CutShort(f"cut short at byte {at}")
        group, element = struct.unpack_from(self.order + "HH", self.data, at)
        tag = f"{group:04X}{element:04X}"
        if group == 0xFFFE or not self.explicit:
            return tag, FILE_VR.get(tag, "OW" if tag == PIXELS else "UN"), struct.unpack_from(self.order + "I", self.data, at + 4)[0], at + 8
        vr = self.data[at + 4 : at + 6].decode("latin-1")
        if vr not in LONG:
            return tag, vr, struct.unpack_from(self.order + "H", self.data, at + 6)[0], at + 8
        if at + 12 > len(self.data):
            raise CutShort(f"{tag} is cut short")
        return tag, vr, struct.unpack_from(self.order + "I", self.data, at + 8)[0], at + 12

    def dataset(self, at: int, end: int | None, charset=None, depth: int = 0) -> tuple[dict, int]:
        """Elements from ``at`` up to ``end``; None is up to the item's end mark, or at the top that of the data."""
        out: dict[str, dict] = {}
        last = len(self.data) if end is None and depth == 0 else end
        while last is None or at < last:
            tag, vr, n, start = self.head(at)
            if tag in (END_ITEM, END_SEQUENCE):
                return out, start
            if tag == PIXELS and depth == 0 and self.stop:
                self.stopped = True
                return out, at
            if vr == "SQ" or (n == UNDEFINED and vr == "UN"):
                items, at = self.sequence(start, None if n == UNDEFINED else start + n, charset, depth + 1)
                out[tag] = {"vr": "SQ", "Value": items}
            elif n == UNDEFINED:
                stop, at = self.items_end(start)
                out[tag] = self.element(tag, vr, self.data[start:stop], charset, depth)
            elif start + n > len(self.data):
                raise CutShort(f"{tag} is cut short")
            else:
                out[tag] = self.element(tag, vr, self.data[start : start + n], charset, depth)
                at = start + n
            if tag == CHARACTERS:
                charset = out[tag].get("Value")
        return out, at

    def sequence(self, at: int, end: int | None, charset, depth: int) -> tuple[list[dict], int]:
        items = []
        while end is None or at < end:
            tag, _, n, start = self.head(at)
            if tag == END_SEQUENCE:
                return items, start
            if tag != ITEM:
                raise ValueError(f"{tag} stands where an item should")
            if n != UNDEFINED and start + n > len(self.data):
                raise CutShort("an item is cut short")
            item, at = self.dataset(start, None if n == UNDEFINED else start + n, charset, depth)
            items.append(item)
        return items, at

    def items_end(self, at: int) -> tuple[int, int]:
        """Where the items of encapsulated data end, and what follows their end mark starts."""
        while True:
            tag, _, n, start = self.head(at)
            if tag == END_SEQUENCE:
                return at, start
            at = start + n
            if tag != ITEM or n == UNDEFINED or at > len(self.data):
                raise CutShort("a fragment is cut short")

    def element(self, tag: str, vr: str, raw: bytes, charset, depth: int) -> dict:
        if tag == PIXELS and depth == 0:
            self.pixels = raw
            return {"vr": vr}
        if vr in BYTES:
            return {"vr": vr, "InlineBinary": base64.b64encode(raw).decode()}
        if vr in NUMBERS:
            size = struct.calcsize(NUMBERS[vr])
            return {"vr": vr, "Value": [x for (x,) in struct.iter_unpack(self.order + NUMBERS[vr], raw[: len(raw) // size * size])]}
        if vr == "AT":
            return {"vr": vr, "Value": [f"{a:04X}{b:04X}" for a, b in struct.iter_unpack(self.order + "HH", raw[: len(raw) // 4 * 4])]}
        return text_of(raw, vr, charset)


def _parse(data: bytes, stop: bool, force: bool, whole: bool = True) -> tuple[dict, bytes | None, bool]:
    """(dataset, pixel bytes, whether reading stopped before the pixels); ``whole`` says that the file ends with the data."""
    at, syntax, meta = 0, IMPLICIT, {}
    if not whole and len(data) < 132:
        raise CutShort("the preamble is cut short")
    if data[128:132] == b"DICM":
        reader = _Reader(data, True, True, False)
        at = 132
        while at + 8 <= len(data) and data[at : at + 2] == b"\x02\x00":
            tag, vr, n, start = reader.head(at)
            if start + n > len(data):
                raise CutShort(f"{tag} is cut short")
            meta[tag] = reader.element(tag, vr, data[start : start + n], None, 0)
            at = start + n
        if not whole and at + 8 > len(data):
            raise CutShort("the file meta may be cut short")
        syntax = meta.get(TAG_OF["TransferSyntaxUID"], {}).get("Value", [EXPLICIT_LITTLE])[0]
    elif not force:
        raise ValueError("no DICM mark after the preamble")
    if syntax == DEFLATED:
        inflate = zlib.decompressobj(-15)
        data, at = inflate.decompress(data[at:]), 0
        if not inflate.eof and not stop:
            raise CutShort("the deflated dataset is cut short")
    reader = _Reader(data, syntax != IMPLICIT, syntax != BIG, stop)
    out, _ = reader.dataset(at, None)
    return meta | out, reader.pixels, reader.stopped


def parse(data: bytes, stop_before_pixels: bool = False, force: bool = False) -> tuple[dict, bytes | None]:
    """(DICOM JSON of file meta and dataset, pixel bytes). ``force`` reads files without preamble as a bare dataset."""
    return _parse(data, stop_before_pixels, force)[:2]


def read_file(file, size: int, stop: bool, force: bool) -> tuple[dict, bytes | None]:
    """`parse` of an open file; before pixels it reads no more than twice what it needs, and `FIRST_BYTES` at least."""
    if not stop:
        return parse(file.read(), False, force)
    data = b""
    while True:
        piece = file.read(max(FIRST_BYTES, len(data)))
        data += piece
        try:
            dataset, pixels, stopped = _parse(data, True, force, len(data) >= size or not piece)
        except (CutShort, struct.error):
            if not piece or len(data) >= size:
                raise
            continue
        if stopped or not piece or len(data) >= size:
            return dataset, pixels


def fragments(pixel_data: bytes) -> list[bytes]:
    """The items of encapsulated pixel data; the first is the offset table."""
    out, at = [], 0
    while at + 8 <= len(pixel_data):
        mark, n = struct.unpack_from("<II", pixel_data, at)
        if mark != 0xE000FFFE or at + 8 + n > len(pixel_data):
            raise ValueError("encapsulated pixel data hold something else than whole items")
        out.append(pixel_data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def frames(pixel_data: bytes, number: int = 1) -> list[bytes]:
    """The frames of encapsulated pixel data: by the offset table; without one, all fragments are one frame, or each
    is one if there are as many."""
    table, *parts = fragments(pixel_data)
    if len(table) >= 4:
        offsets, starts, at = [x for (x,) in struct.iter_unpack("<I", table)], {}, 0
        for i, part in enumerate(parts):
            starts[at] = i
            at += 8 + len(part)
        if any(x not in starts for x in offsets):
            raise ValueError("the offset table points between items")
        cuts = [*(starts[x] for x in offsets), len(parts)]
        return [b"".join(parts[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
    if number == 1:
        return [b"".join(parts)]
    if len(parts) == number:
        return parts
    raise ValueError(f"{len(parts)} fragments without an offset table are not {number} frames")


class _Writer:
    """Elements in one transfer syntax."""

    def __init__(self, syntax: str):
        self.explicit, self.order, self.encapsulated = syntax != IMPLICIT, ">" if syntax == BIG else "<", syntax not in NATIVE_SYNTAXES

    def raw(self, tag: str, vr: str, element: dict, charset) -> bytes:
        values = element.get("Value") or []
        if vr == "SQ":
            bodies = [self.dataset(item, None, charset) for item in values]
            return b"".join(struct.pack(self.order + "HHI", 0xFFFE, 0xE000, len(body)) + body for body in bodies)
        if "InlineBinary" in element:
            return base64.b64decode(element["InlineBinary"])
        if vr in NUMBERS:
            return b"".join(struct.pack(self.order + NUMBERS[vr], (float if vr in ("FL", "FD") else int)(v)) for v in values)
        if vr == "AT":
            return b"".join(struct.pack(self.order + "HH", int(v[:4], 16), int(v[4:], 16)) for v in values)
        if vr in BYTES and any(not isinstance(v, str) for v in values):
            raise ValueError(f"{tag} of {vr} holds neither bytes nor text")
        text = "\\".join(v.get("Alphabetic", "") if isinstance(v, dict) else "" if v is None else str(v) for v in values)
        try:
            return charsets.encode(text, charset)
        except ValueError as problem:
            raise ValueError(f"{tag}: the text cannot be encoded in the declared character set ({problem})") from None

    def element(self, tag: str, element: dict, charset) -> bytes:
        vr = element.get("vr") or FILE_VR.get(tag, "UN")
        return self.framed(tag, vr, self.raw(tag, vr, element, charset))

    def framed(self, tag: str, vr: str, raw: bytes) -> bytes:
        if len(raw) % 2:
            raw += b"\0" if vr in BYTES or vr == "UI" else b" "
        head = struct.pack(self.order + "HH", int(tag[:4], 16), int(tag[4:], 16))
        if not self.explicit:
            return head + struct.pack(self.order + "I", len(raw)) + raw
        if vr in LONG:
            return head + vr.encode() + b"\0\0" + struct.pack(self.order + "I", len(raw)) + raw
        if len(raw) > 0xFFFF:
            raise ValueError(f"{tag} is too long for {vr}")
        return head + vr.encode() + struct.pack(self.order + "H", len(raw)) + raw

    def pixels(self, element: dict, pixels: bytes) -> bytes:
        if not self.encapsulated:
            vr = element.get("vr")
            return self.framed(PIXELS, vr if vr in ("OB", "OW") else "OW", pixels)
        if not fragments(pixels):
            raise ValueError("encapsulated pixel data have no items")
        end = struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
        return struct.pack("<HH", int(PIXELS[:4], 16), int(PIXELS[4:], 16)) + b"OB\0\0" + struct.pack("<I", UNDEFINED) + pixels + end

    def dataset(self, dataset: dict, pixels: bytes | None, charset=None) -> bytes:
        """Elements in tag order; the character set is the dataset's own or that of the one around it."""
        charset = dataset.get(CHARACTERS, {}).get("Value") or charset
        out = []
        for tag in sorted({*dataset, PIXELS} if pixels is not None else dataset):
            if tag == PIXELS and pixels is not None:
                out.append(self.pixels(dataset.get(PIXELS, {}), pixels))
            elif tag != PIXELS or "InlineBinary" in dataset[tag]:
                out.append(self.element(tag, dataset[tag], charset))
        return b"".join(out)


def encode(dataset: dict, pixels: bytes | None = None) -> bytes:
    """A Part 10 file in the transfer syntax of its file meta.

    The file meta's SOP class and instance come from the media storage tags or the dataset's own; an error if neither
    has them. Other elements of the file meta are kept. Errors are ValueErrors: text that the character set lacks,
    numbers that their representation cannot hold, compressed pixels that are no items.
    """
    first = lambda *tags: next((v for t in tags for v in (dataset.get(t, {}).get("Value") or [])[:1] if v), None)
    sop_class = first(TAG_OF["MediaStorageSOPClassUID"], TAG_OF["SOPClassUID"])
    instance = first(TAG_OF["MediaStorageSOPInstanceUID"], TAG_OF["SOPInstanceUID"])
    if not sop_class or not instance:
        raise ValueError("the file meta needs SOPClassUID and SOPInstanceUID")
    syntax = first(TAG_OF["TransferSyntaxUID"]) or EXPLICIT_LITTLE
    ui = lambda v: {"vr": "UI", "Value": [v]}
    meta = {t: e for t, e in dataset.items() if t[:4] == "0002" and t != "00020000"}
    meta |= {"00020002": ui(sop_class), "00020003": ui(instance), "00020010": ui(syntax), "00020012": ui(first("00020012") or IMPLEMENTATION)}
    meta.setdefault("00020001", {"vr": "OB", "InlineBinary": "AAE="})
    try:
        head = _Writer(EXPLICIT_LITTLE).dataset(meta, None)
        body = _Writer(syntax).dataset({t: e for t, e in dataset.items() if t[:4] != "0002"}, pixels)
    except (struct.error, TypeError, AttributeError, OverflowError) as problem:
        raise ValueError(f"a value does not fit its representation: {problem}") from None
    if syntax == DEFLATED:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(body) + squeeze.flush()
        body += b"\0" * (len(body) % 2)
    return bytes(128) + b"DICM" + struct.pack("<HH2sHI", 2, 0, b"UL", 4, len(head)) + head + body


SCHEMA = "path string, dataset string, pixel_data binary, error string"


class Files(InputPartition):
    """Files, and folders whose files the task lists itself."""

    def __init__(self, names: list[str], folders: list[str] = ()):
        self.names, self.folders = names, list(folders)


def _is_data(info) -> bool:
    from pyarrow import fs

    return info.type == fs.FileType.File and not info.base_name.startswith(("_", "."))


def arrow_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "dataset", "pixel_data", "error"])


class DicomReader(DataSourceReader):
    """Plans files by size. The driver walks folders breadth first until it has `LISTED_FOLDERS` open ones, which
    tasks then list, so it never holds the names of all files of a deep archive."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.stop = options.get("stopbeforepixels", options.get("stopBeforePixels", "false")).lower() == "true"
        self.force = options.get("force", "false").lower() == "true"

    def partitions(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [Files([self.path])]
        name = lambda path: f"{self.path}/{path[len(root):].lstrip('/')}"
        out, names, size, folders = [], [], 0, [root]
        while folders and len(folders) < LISTED_FOLDERS:
            for info in sorted(store.get_file_info(fs.FileSelector(folders.pop(0))), key=lambda i: i.path):
                if info.type == fs.FileType.Directory and not info.base_name.startswith(("_", ".")):
                    folders.append(info.path)
                elif _is_data(info):
                    names.append(name(info.path))
                    size += max(info.size, FIRST_BYTES)  # small files take as long as their first step
                    if size >= PARTITION_BYTES:
                        out.append(Files(names))
                        names, size = [], 0
        out += [Files(names)] if names else []
        return out + [Files([], [name(f)]) for f in folders]

    def files(self, partition) -> Iterator[str]:
        from pyarrow import fs

        yield from partition.names
        folders = list(partition.folders)
        while folders:
            folder = folders.pop()
            store, root = fs.FileSystem.from_uri(folder)
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.Directory and not info.base_name.startswith(("_", ".")):
                    folders.append(f"{folder}/{info.base_name}")
                elif _is_data(info):
                    yield f"{folder}/{info.base_name}"

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        rows, size = [], 0
        for name in self.files(partition) if partition else ():
            try:
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as file:
                    dataset, pixels = read_file(file, file.size(), self.stop, self.force)
                rows.append((name, json.dumps(dataset, ensure_ascii=False), pixels, None))
            except (ValueError, struct.error, OSError, zlib.error, RecursionError) as problem:
                rows.append((name, None, None, str(problem) or type(problem).__name__))
            size += sum(map(len, filter(None, rows[-1])))
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield arrow_batch(rows)
                rows, size = [], 0
        if rows:
            yield arrow_batch(rows)


class Wrote(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


def write_file(store, root: str, name: str, dataset: str, pixels: bytes | None) -> None:
    """One file of a row; its errors are ValueErrors, raised before anything is written."""
    data = encode(json.loads(dataset), pixels)
    with store.open_output_stream(f"{root}/{name}") as out:
        out.write(data)


class DicomWriter(DataSourceArrowWriter):
    """A file per row, under a name of its own, so equal base names of inputs cannot overwrite each other.

    A row that cannot be encoded ends the job, or with the option ``errors`` = ``report`` is left out and listed in
    files of the folder's `FAILED`, an object with path and error a line; `failures` reads them.
    """

    def __init__(self, options: dict):
        self.path, self.report = options["path"].rstrip("/"), options.get("errors", "fail").lower() == "report"

    def write(self, iterator):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        names, failed = [], []
        for batch in iterator:
            for row in batch.to_pylist():
                try:
                    if row["dataset"] is None:
                        raise ValueError(row["error"] or "there is no dataset")
                    name = f"{uuid.uuid4().hex}.dcm"
                    write_file(store, root, name, row["dataset"], row["pixel_data"])
                    names.append(name)
                except ValueError as problem:
                    if not self.report:
                        raise
                    failed.append((row["path"], str(problem)))
        if failed:
            # each task lists its own, so the driver holds none of them
            store.create_dir(f"{root}/{FAILED}")
            with store.open_output_stream(f"{root}/{FAILED}/{uuid.uuid4().hex}.jsonl") as out:
                out.write("".join(json.dumps({"path": p, "error": e}) + "\n" for p, e in failed).encode())
        return Wrote(names)

    def commit(self, messages):
        pass

    def abort(self, messages):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{root}/{name}")


class DicomDataSource(DataSource):
    """``spark.read.format("dicom")``; options ``stopBeforePixels`` and ``force``, and ``errors`` in writing."""

    @classmethod
    def name(cls):
        return "dicom"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return DicomReader(dict(self.options))

    def writer(self, schema, overwrite):
        return DicomWriter(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(DicomDataSource)


def failures(spark, path: str):
    """(path, error) of the rows that a write with ``errors`` = ``report`` left out."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path.rstrip("/"))
    schema, listed = "path string, error string", store.get_file_info(f"{root}/{FAILED}").type == fs.FileType.Directory
    return spark.read.schema(schema).json(f"{path.rstrip('/')}/{FAILED}") if listed else spark.createDataFrame([], schema)
