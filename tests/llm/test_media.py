import gzip
import hashlib
import struct
import time
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from voxelake.llm import media as M


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


def ogg_page(body: bytes, last: bool) -> bytes:
    """A page with the checksum computed bit by bit."""
    page = b"OggS\0" + bytes([4 if last else 0]) + bytes(20) + bytes([1, len(body)]) + body
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return page[:22] + struct.pack("<I", crc) + page[26:]


SAMPLES = {
    "image/png": png(),
    "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2\x11\xff\0\x22\xff\xd0\x33\xff\xd9",
    "image/gif": b"GIF89a" + b"\1\0\1\0\x80\0\0" + bytes(6) + b"\x21\xf9\4\0\0\0\0\0" + b"\x2c" + bytes(8) + b"\0" + b"\2\2\x44\1\0" + b"\x3b",
    "image/bmp": b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40),
    "image/x-portable-graymap": b"P5 2 2 255\n1234",
    "audio/wav": M.to_wav(b"12345678"),
    "application/ogg": ogg_page(b"one", False) + ogg_page(b"abc", True),
    "video/mp4": struct.pack(">I4s", 12, b"ftyp") + b"isom" + struct.pack(">I4s", 8, b"moov"),
    "application/pdf": b"%PDF-1.4 x startxref 1 %%EOF",
    "application/gzip": gzip.compress(b"hello"),
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_sniff_and_carve(kind):
    machine, data = M.automaton(), SAMPLES[kind]
    assert M.carve(data, machine) == [(kind, 0, len(data))]
    assert M.carve(b"text before" + data + b"after", machine) == [(kind, 11, len(data))]
    assert M.sniffed(data, "text/plain", machine)[0] == kind
    assert kind not in [k for k, _, _ in M.carve(data[:-1], machine)]


def test_declared_types():
    machine = M.automaton()
    assert M.sniffed(b"plain", "text/plain", machine) == ("text/plain", [])
    assert M.sniffed(b"plain", "image/png", machine) == (None, [])
    # what is cut short keeps its type
    assert M.sniffed(SAMPLES["image/png"][:30], "image/png", machine) == ("image/png", [])


MORE = [
    ("application/pdf", b"%PDF-1.4 a startxref 1 %%EOF update startxref 2 %%EOF"),
    ("application/pdf", b"%PDF-1.7 linearised startxref 0 %%EOF body body startxref 9\n%%EOF"),
    ("video/mp4", struct.pack(">I4s", 12, b"ftyp") + b"isom" + struct.pack(">I4s", 8, b"wide") + struct.pack(">I4sQ", 1, b"mdat", 20) + b"data" + struct.pack(">I4s", 8, b"moov")),
    ("image/jpeg", b"\xff\xd8\xff\xff\xe0\0\4ab\xff\xff\xff\xda\0\2\x11\xff\0\x22\xff\xd0\x33\xff\xff\xd9"),
    ("application/gzip", gzip.compress(bytes(5_000_000))),
]


@pytest.mark.parametrize("kind, data", MORE)
def test_whole_files(kind, data):
    machine = M.automaton()
    assert M.carve(data, machine) == [(kind, 0, len(data))]
    assert M.carve(b"before " + data + b" after", machine) == [(kind, 7, len(data))]


def test_a_file_ends_before_the_next_one_starts():
    one = SAMPLES["application/pdf"]
    assert M.carve(one + b" " + one + b" stray %%EOF", M.automaton()) == [("application/pdf", 0, len(one)), ("application/pdf", len(one) + 1, len(one) + len(b" stray %%EOF"))]
    mp4 = SAMPLES["video/mp4"]
    assert M.carve(mp4 + struct.pack(">I4s", 0, b"free") + b"to the end", M.automaton()) == [("video/mp4", 0, len(mp4) + 18)]


def test_a_bad_checksum_is_refused():
    for kind, at in (("image/png", 18), ("application/ogg", 60), ("application/gzip", 12)):
        data = bytearray(SAMPLES[kind])
        data[at] ^= 1
        assert M.carve(bytes(data), M.automaton()) == []


def naive(data):
    """Every format at every offset, each with nothing remembered."""
    out, at = [], 0
    while at < len(data):
        found = None
        for kind, (magic, offset) in sorted(M.MAGIC.items()):
            if found is None and data[at + offset : at + offset + len(magic)] == magic and (n := M.VALIDATORS[kind](data, at, M.Walks(data))) is not None:
                found = (kind, at, n)
        out += [found] if found else []
        at += found[2] if found else 1
    return out


PARTS = [*SAMPLES.values(), *(m[1] for m in MORE[:4])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.tuples(st.sampled_from(PARTS), st.integers(0, 70), st.integers(0, 70)), st.binary(max_size=6)), max_size=8))
def test_carving_finds_what_a_naive_search_finds(parts):
    """Whole and cut files one after another and within another: nothing remembered of one walk misleads the next."""
    data = b"".join(p if isinstance(p, bytes) else p[0][p[1] % len(p[0]) if p[1] > 50 else 0 : len(p[0]) - p[2] % len(p[0]) if p[2] > 50 else None] for p in parts)
    assert M.carve(data, M.automaton()) == naive(data)


def hostile(n):
    """Texts and bytes of about n bytes whose candidates overlap as much as they can."""
    pages = b"".join(b"OggS\0\0" + bytes(20) + b"\0" for _ in range(n // 27))
    boxes = struct.pack(">I4s", 8, b"ftyp") * (n // 8)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    ihdr = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13))
    return {
        "pdf": b"%PDF-1.4 x" * (n // 10) + b"%%EOF",
        "pdf2": b"%PDF-1.4 startxref %%EO" * (n // 23),
        "ogg": pages,
        "ogg2": ogg_page(b"", False) * (n // 27),
        "mp4": boxes,
        "wav": b"".join(struct.pack("<4sI4s", b"RIFF", n - 12 * i - 8, b"WAVE") for i in range(n // 24)) + struct.pack("<4sI", b"junk", 0) * (n // 16),
        "gif": b"GIF89a\1\0\1\0\0\0\0\x21" * (n // 14),
        "jpeg": b"\xff\xd8\xff\xda\0\2" * (n // 6),
        "pgm": b"P5 " * (n // 3),
        "png": b"".join(ihdr + struct.pack(">I4s", n - (len(ihdr) + 8) * (i + 1), b"IDAT") for i in range(n // (len(ihdr) + 8))) + bytes(64),
        "gzip": b"\x1f\x8b\x08\0\0\0\0\0\0\xff\0\xff\xff\0\0" * (n // 15),
    }


@pytest.mark.parametrize("kind", hostile(400))
def test_hostile_values_take_linear_time(kind):
    data, began = hostile(4_000_000)[kind], time.time()
    M.carve(data, M.automaton())
    assert time.time() - began < 30


def test_registered_query(spark):
    """The registered query over its whole table, its features against the naive search."""
    from voxelake.llm.queries import op6_media

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op6_media(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        raw = texts[i].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        wav = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), zlib.crc32(payload[-64:]), len(wav))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(wav).hexdigest())
        assert r.feature == ";".join(f"{k}@{a}+{n}" for k, a, n in [("audio/wav", 0, len(wav)), *naive(payload)])


@given(st.binary(max_size=300))
def test_any_bytes(data):
    M.carve(b"".join(m for m, _ in M.MAGIC.values()) + data, M.automaton())


def test_store_and_read_back(documents):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "é" * 32, "en", "a"), (4, "x" * 65, "en", "a"), (5, "x" * 65, "en", "b"), (5, "x" * 65, "en", "b"), (6, "long " * 200_000, "en", "a"), (None, "P5 2 2 255\n1234", None, None)]
    got = M.describe(M.store(documents(rows))).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, _, _ in rows}
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(payload) + 44 and r.feature.startswith("audio/wav@0+")
        assert r.media_sha256 == hashlib.sha256(M.to_wav(payload)).hexdigest()
    assert next(r.feature for r in got if r.doc_id is None).endswith(";image/x-portable-graymap@0+15")
    assert M.describe(M.store(documents([]))).collect() == []


def test_sniff_column(spark):
    df = spark.createDataFrame([(1, SAMPLES["image/png"], "image/jpeg"), (2, None, None), (3, b"x", "text/plain")], "id int, data binary, type string")
    got = {r.id: r for r in M.sniff(df, "data", "type").collect()}
    assert got[1].media_type == "image/png" and got[1].corrected and got[2].media_type is None and not got[3].corrected
