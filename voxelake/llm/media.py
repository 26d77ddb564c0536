"""Media columns: signature sniffing, structure validation, type correction and carving.

An Aho-Corasick automaton over all magic byte strings locates candidates in one pass over the bytes. The validator of
each candidate's format then walks its structure (chunks, blocks, segments, declared lengths, checksums where the
format has them) and gives the exact length, or refuses it. A column's declared type is corrected to the confirmed
type at its start; confirmed media further inside are carved out with offset and length.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 64
#: Samples a second that the stored form declares.
RATE = 8000

# fixed values: magic bytes and where in the format they stand
MAGIC = {
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "image/gif": (b"GIF8", 0),
    "image/bmp": (b"BM", 0),
    "image/x-portable-graymap": (b"P5", 0),
    "audio/wav": (b"RIFF", 0),
    "application/ogg": (b"OggS", 0),
    "video/mp4": (b"ftyp", 4),
    "application/pdf": (b"%PDF-", 0),
    "application/gzip": (b"\x1f\x8b\x08", 0),
}


class Walks:
    """What the validators learn about one value, so that no byte of it is walked again and again.

    Walks go from one position of a format's structure to the next, and what follows a position does not depend on
    how it was reached. So positions that led nowhere are remembered, and lists of marks are made once.

    Only checksums of long chunks, chunk lists of sound and inflating can overlap freely. They share a budget of
    `WORK` times the value's length and a constant; once hostile bytes have used it up, further PNG, WAV and gzip
    candidates of this value stay unconfirmed. Every other value is searched whole.
    """

    WORK, SPARE = 32, 64 << 20

    def __init__(self, data: bytes):
        self.data, self.left = data, self.WORK * len(data) + self.SPARE
        self.dead: dict[str, set] = {}
        self.boxes: dict[int, tuple[int, bool]] = {}

    def afford(self, work: int) -> bool:
        self.left -= work
        return self.left >= 0

    def fail(self, kind: str, states: list) -> None:
        self.dead.setdefault(kind, set()).update(states)

    def is_dead(self, kind: str, state) -> bool:
        return state in self.dead.get(kind, ())

    @cached_property
    def jpeg_markers(self) -> list[int]:
        return [m.start() for m in JPEG_MARKER.finditer(self.data)]

    @cached_property
    def pdf_marks(self) -> tuple[list[int], list[int], list[int]]:
        """Where headers, cross-reference pointers and end marks stand."""
        return tuple([m.start() for m in p.finditer(self.data)] for p in PDF_MARKS)


# fixed values: what delimits segments and files
JPEG_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
PDF_MARKS = (re.compile(rb"%PDF-\d\.\d"), re.compile(rb"startxref"), re.compile(rb"%%EOF"))
PGM_HEADER = re.compile(rb"P5\s+(\d{1,9})\s+(\d{1,9})\s+(\d{1,5})\s")
#: For each byte the one with its bits in reverse.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _first_after(places: list[int], at: int) -> int | None:
    i = bisect_left(places, at)
    return places[i] if i < len(places) else None


def _png(b: bytes, at: int, walks: Walks) -> int | None:
    """Chunks with valid checksums from IHDR to IEND."""
    p, seen = at + 8, []
    while p + 12 <= len(b) and not walks.is_dead("png", p):
        n, kind = struct.unpack_from(">I4s", b, p)
        if (not seen and (kind != b"IHDR" or n != 13)) or p + 12 + n > len(b) or not walks.afford(n):
            break
        if zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            break
        seen.append(p)
        p += 12 + n
        if kind == b"IEND":
            return p - at
    # what is refused as a first chunk may be a later one of another file
    walks.fail("png", [*seen, p] if seen else [])
    return None


def _jpeg(b: bytes, at: int, walks: Walks) -> int | None:
    """Marker segments up to the first scan, then entropy-coded data and more segments up to the end marker."""
    p, scanned, seen = at + 2, False, []
    while p + 2 <= len(b) and not walks.is_dead("jpeg", (p, scanned)):
        seen.append((p, scanned))
        if b[p] != 0xFF:
            break
        marker = b[p + 1]
        if marker == 0xFF:  # a fill byte
            p += 1
            continue
        if marker == 0xD9:
            if scanned:
                return p + 2 - at
            break
        if marker in (0x00, 0xD8) or p + 4 > len(b):
            break
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            break
        p += 2 + n
        if marker == 0xDA:
            scanned = True
            if (p := _first_after(walks.jpeg_markers, p)) is None:
                break
    walks.fail("jpeg", seen)
    return None


def _gif(b: bytes, at: int, walks: Walks) -> int | None:
    """Screen descriptor, then extension and image blocks up to the trailer."""
    if b[at : at + 6] not in (b"GIF87a", b"GIF89a") or at + 13 > len(b):
        return None
    flags, seen = b[at + 10], []
    p, inside = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), False
    while p < len(b) and not walks.is_dead("gif", (p, inside)):
        seen.append((p, inside))
        kind = b[p]
        if inside:  # sub-blocks up to an empty one
            inside = kind > 0
            p += 1 + kind
        elif kind == 0x3B:
            return p + 1 - at
        elif kind == 0x21:
            p, inside = p + 2, True
        elif kind == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p, inside = p + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0), True
        else:
            break
    walks.fail("gif", seen)
    return None


def _bmp(b: bytes, at: int, walks: Walks) -> int | None:
    """File size, pixel offset and header size agree with one another."""
    if at + 26 > len(b):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    fits = zero == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= offset <= size <= len(b) - at
    return size if fits else None


def _pgm(b: bytes, at: int, walks: Walks) -> int | None:
    """Width, height and depth; as many samples as they say."""
    m = PGM_HEADER.match(b, at)
    if m is None or not 0 < int(m[3]) < 65536 or not int(m[1]) * int(m[2]):
        return None
    n = m.end() - at + int(m[1]) * int(m[2]) * (1 if int(m[3]) < 256 else 2)
    return n if at + n <= len(b) else None


def _wav(b: bytes, at: int, walks: Walks) -> int | None:
    """Chunks fill the declared size, with a format chunk before the data chunk."""
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p, formatted, data, seen = at + 12, False, False, []
    while p + 8 <= end <= len(b) and not walks.is_dead("wav", (p, end, formatted + data)) and walks.afford(8):
        seen.append((p, end, formatted + data))
        kind, n = struct.unpack_from("<4sI", b, p)
        formatted |= kind == b"fmt " and n >= 16
        data |= kind == b"data" and formatted
        p += 8 + n + n % 2
    if data and p == end:
        return end - at
    walks.fail("wav", seen)
    return None


def _ogg(b: bytes, at: int, walks: Walks) -> int | None:
    """Consecutive pages with valid checksums up to the one that ends the stream."""
    p, seen = at, []
    while p + 27 <= len(b) and not walks.is_dead("ogg", p) and b[p : p + 4] == b"OggS" and b[p + 4] == 0:
        seen.append(p)
        n, last, checksum = b[p + 26], b[p + 5] & 4, struct.unpack_from("<I", b, p + 22)[0]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + 27 + n > len(b) or end > len(b):
            break
        # the checksum of Ogg is that of zlib with all bits in reverse, from zero and not inverted
        page = (b[p : p + 22] + bytes(4) + b[p + 26 : end]).translate(REVERSED)
        if int(f"{zlib.crc32(page, 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2) != checksum:
            break
        p = end
        if last:
            return p - at
    walks.fail("ogg", [*seen, p])
    return None


def _mp4(b: bytes, at: int, walks: Walks) -> int | None:
    """Boxes of four printable characters each with lengths that fit, a movie, media or fragment box among them."""
    p, seen, end, media = at, [], None, False
    while end is None:
        if p in walks.boxes:
            end, media = walks.boxes[p]
            break
        n, kind, head = 0, b"", 8
        if p + 8 <= len(b):
            n, kind = struct.unpack_from(">I4s", b, p)
            if n == 1 and p + 16 <= len(b):
                n, head = struct.unpack_from(">Q", b, p + 8)[0], 16
            elif n == 0:
                n = len(b) - p
        if n < head or p + n > len(b) or not all(32 <= c < 127 or c == 0xA9 for c in kind):
            end = p
        else:
            seen.append((p, kind))
            p += n
    for p, kind in reversed(seen):
        media |= kind in (b"moov", b"mdat", b"moof")
        walks.boxes[p] = end, media
    return end - at if media and at in walks.boxes else None


def _pdf(b: bytes, at: int, walks: Walks) -> int | None:
    """Version, then the last end mark before the next file starts, with a cross-reference pointer before it.

    Linearised files and files with updates have more than one end mark.
    """
    starts, pointers, ends = walks.pdf_marks
    if (i := bisect_left(starts, at)) == len(starts) or starts[i] != at:
        return None
    following = starts[i + 1] if i + 1 < len(starts) else len(b)
    if not (j := bisect_left(ends, following)) or ends[j - 1] < at:
        return None
    pointer = _first_after(pointers, at)
    return ends[j - 1] + 5 - at if pointer is not None and pointer < ends[j - 1] else None


def _gzip(b: bytes, at: int, walks: Walks) -> int | None:
    """A member that inflates to its own checksum and length."""
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    member, whole, p, left, made = zlib.decompressobj(31), memoryview(b), at, b"", 0
    try:
        while not member.eof and (left or p < len(b) or made == 1 << 20):
            if not left:
                left = whole[p : p + (1 << 16)]
                p += len(left)
            made = len(member.decompress(left, 1 << 20))
            if not walks.afford(len(left) - len(member.unconsumed_tail) + made):
                return None
            left = member.unconsumed_tail
    except zlib.error:
        return None
    return p - at - len(member.unused_data) if member.eof else None


VALIDATORS: dict[str, Callable[[bytes, int, Walks], int | None]] = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "image/x-portable-graymap": _pgm,
    "audio/wav": _wav, "application/ogg": _ogg, "video/mp4": _mp4, "application/pdf": _pdf, "application/gzip": _gzip,
}


def automaton():
    """Aho-Corasick over the magic strings, as Latin-1 text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, (magic, offset) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + offset))
    found.make_automaton()
    return found


def carve(data: bytes, machine) -> list[tuple[str, int, int]]:
    """Confirmed media (type, offset, length) by offset, none within another.

    A candidate inside media already confirmed is skipped, so confirmed bytes are walked once; `Walks` sees to it that
    refused ones are not walked often.
    """
    hits = sorted((end - back, kind) for end, (kind, back) in machine.iter(data.decode("latin-1")) if end >= back)
    out, free, walks = [], 0, Walks(data)
    for at, kind in hits:
        if at >= free and (n := VALIDATORS[kind](data, at, walks)) is not None:
            out.append((kind, at, n))
            free = at + n
    return out


def sniffed(data: bytes, declared: str | None, machine) -> tuple[str | None, list[tuple[str, int, int]]]:
    """(type, media): the type confirmed at the start, else the declared one unless its magic bytes are missing."""
    media = carve(data, machine)
    if media and media[0][1] == 0:
        return media[0][0], media
    magic, offset = MAGIC.get(declared, (b"", 0))
    return (declared if data[offset : offset + len(magic)] == magic else None), media


def sniff(df: DataFrame, data_col: str, type_col: str | None = None, id_col: str = "id") -> DataFrame:
    """(``id_col``, media_type, corrected, media array<struct<type, offset, length>>): a row per input row.

    ``corrected`` says that media_type differs from the declared one. Null data counts as empty and has no media.
    """
    kind = df.schema[id_col].dataType.simpleString()
    declared = F.col(type_col).cast("string") if type_col else F.lit(None).cast("string")
    media_type = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        machine = automaton()
        for batch in batches:
            rows = [sniffed(d or b"", t, machine) + (t,) for d, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[0] != r[2] for r in rows], pa.bool_()),
                    pa.array([[{"type": k, "offset": a, "length": n} for k, a, n in r[1]] for r in rows], media_type),
                ],
                names=[id_col, "media_type", "corrected", "media"],
            )

    schema = f"`{id_col}` {kind}, media_type string, corrected boolean, media array<struct<type: string, offset: bigint, length: bigint>>"
    return df.select(F.col(id_col), F.col(data_col).cast("binary"), declared).mapInArrow(run, schema)


def payload_of(text: str | None) -> bytes:
    """The text in UTF-8 with zero bytes up to a positive multiple of `BLOCK`."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def to_wav(samples: bytes) -> bytes:
    """One channel of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def wav_samples(media: bytes) -> bytes:
    """The data chunk, found by walking the chunks."""
    p = 12
    while True:
        kind, n = struct.unpack_from("<4sI", media, p)
        if kind == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + n % 2


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """(``id_col``, n_bytes, media binary, declared): texts stored losslessly as 8-bit sound."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            media = [to_wav(payload_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array([declared] * len(n), pa.string())],
                names=[id_col, "n_bytes", "media", "declared"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary, declared string")


def describe(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and the sniffed feature of what `store` wrote, read back from the stored bytes.

    ``feature`` is the corrected type with its length, then carved media within the payload (offsets into it), if
    any: equal payloads have equal features. Texts of any length are searched whole, in time that grows with their
    length, but for the budget that `Walks` states. Null texts are stored as empty ones, 64 zero samples; repeated rows
    repeat, an empty table gives none, and columns beside those of `store` are dropped.
    """
    kind = stored.schema[id_col].dataType.simpleString()

    def run(batches):
        machine = automaton()
        for batch in batches:
            rows = []
            for n, media, declared in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                kind_found, found = sniffed(media, declared, machine)
                payload = wav_samples(media)
                inner = carve(payload, machine)
                feature = ";".join(f"{k}@{a}+{size}" for k, a, size in [(kind_found, found[0][1], found[0][2]), *inner])
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, *FEATURES])

    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select(id_col, "n_bytes", "media", "declared").mapInArrow(run, schema)


FEATURES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
