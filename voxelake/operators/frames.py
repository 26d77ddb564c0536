"""Frames: native decoding, rendering, previews. Pixel bytes stay in Arrow batches and are never shuffled."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelake.dims import NATIVE_SYNTAXES

BIG_ENDIAN = "1.2.840.10008.1.2.2"
#: What a decoder of compressed frames takes and gives: (pixel bytes, metadata) -> frames as arrays.
Decoder = Callable[[bytes, dict], list[np.ndarray]]
META = ("rows", "columns", "samples", "bits_allocated", "pixel_representation", "frames", "planar")


def dtype_of(bits: int, signed: bool, syntax: str) -> np.dtype:
    if bits not in (8, 16, 32):
        raise ValueError(f"no array type for {bits} allocated bits")
    return np.dtype(f"{'>' if syntax == BIG_ENDIAN else '<'}{'i' if signed else 'u'}{bits // 8}")


def native_frame(data: bytes, m: dict, frame: int, syntax: str) -> np.ndarray:
    """One frame of uncompressed pixel data: (rows, columns) or (rows, columns, samples)."""
    if not 0 <= frame < m["frames"]:
        raise IndexError(f"frame {frame} of {m['frames']}")
    kind = dtype_of(m["bits_allocated"], m["pixel_representation"] == 1, syntax)
    shape, count = (m["rows"], m["columns"]), m["rows"] * m["columns"] * m["samples"]
    flat = np.frombuffer(data, kind, count, frame * count * kind.itemsize)
    if m["samples"] == 1:
        return flat.reshape(shape)
    if m["planar"] == 1:
        return flat.reshape(m["samples"], *shape).transpose(1, 2, 0)
    return flat.reshape(*shape, m["samples"])


def decode(df: DataFrame, id_col: str, decoders: dict[str, Decoder] | None = None, rescale: bool = False) -> DataFrame:
    """(id, frame, shape array<int>, pixels array<double>, error): a row per frame, pixels in row-major order.

    ``df`` has the columns of `META`, ``syntax`` and ``pixel_data``, and with ``rescale`` ``slope`` and ``intercept``,
    by which pixels are then scaled; a slope of zero or none counts as one. A row that cannot be decoded gives one row
    with its error. Compressed syntaxes take a decoder of the caller's, which gets the items as they are in the file
    (`dicom_file.frames` tells the frames apart); a multi-frame row is decoded once.
    """
    kind, decoders = df.schema[id_col].dataType.simpleString(), decoders or {}

    def frames_of(row: dict) -> list[np.ndarray]:
        if row["pixel_data"] is None:
            raise ValueError("PixelData is missing.")
        if row["syntax"] in NATIVE_SYNTAXES:
            found = [native_frame(row["pixel_data"], row, i, row["syntax"]) for i in range(row["frames"])]
        elif row["syntax"] not in decoders:
            raise ValueError(f"No codec decodes transfer syntax {row['syntax']}.")
        else:
            found = decoders[row["syntax"]](row["pixel_data"], row)
        return [f.astype(np.float64) * (row["slope"] or 1.0) + (row["intercept"] or 0.0) for f in found] if rescale else found

    def run(batches):
        for batch in batches:
            at, number, shapes, pixels, errors = [], [], [], [], []
            for i, row in enumerate(batch.to_pylist()):
                try:
                    found, error = frames_of(row), None
                except (ValueError, IndexError, TypeError) as problem:
                    found, error = [None], str(problem)
                at += [i] * len(found)
                number += [None] if error else range(len(found))
                shapes += [None if f is None else f.shape for f in found]
                pixels += found
                errors += [error] * len(found)
            # one flat array of all frames, cut by offsets
            flat = [np.zeros(0) if f is None else np.ascontiguousarray(f, np.float64).ravel() for f in pixels]
            ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
            offsets = pa.array(ends, pa.int32(), mask=np.array([*(f is None for f in pixels), False]))
            values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*flat, np.zeros(0)])))
            arrays = [pa.array(number, pa.int32()), pa.array(shapes, pa.list_(pa.int32())), values, pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=[id_col, "frame", "shape", "pixels", "error"])

    more = ["slope", "intercept"] if rescale else []
    return df.select(F.col(id_col), *META, "syntax", "pixel_data", *[F.col(c).cast("double") for c in more]).mapInArrow(run, f"`{id_col}` {kind}, frame int, shape array<int>, pixels array<double>, error string")


def windowed(x: np.ndarray, center: float, width: float) -> np.ndarray:
    low, high = center - 0.5 - (width - 1) / 2, center - 0.5 + (width - 1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = ((x - (center - 0.5)) / (width - 1) + 0.5) * 255.0
    return np.where(x <= low, 0.0, np.where(x > high, 255.0, inside))


def to_rgb(x: np.ndarray, photometric: str) -> np.ndarray:
    """RGB of full and partial range YBR; other colour frames as they are."""
    from voxelake.functions.pixels import BLUE_CB, GREEN_CB, GREEN_CR, RED_CR

    if photometric not in ("YBR_FULL", "YBR_FULL_422", "YBR_PARTIAL_422"):
        return x
    partial = photometric == "YBR_PARTIAL_422"
    f = x.astype(np.float64)
    y = (f[..., 0] - 16) * (255 / 219) if partial else f[..., 0]
    cb, cr = ((f[..., i] - 128) * (255 / 224 if partial else 1) for i in (1, 2))
    return np.stack([y + RED_CR * cr, y - GREEN_CB * cb - GREEN_CR * cr, y + BLUE_CB * cb], -1).clip(0, 255).astype(np.uint8)


def raster(x: np.ndarray, photometric: str, window: bool = True, center: float | None = None, width: float | None = None) -> np.ndarray:
    """8-bit pixels for display: grey frames by window (by default the mean, and the range or one) or stretch, inverted
    for MONOCHROME1; colour frames as RGB, stretched unless 8-bit."""
    photometric = photometric.strip().upper()
    span = lambda a: float(a.max() - a.min()) or 1.0
    if photometric in ("MONOCHROME1", "MONOCHROME2"):
        f = x.astype(np.float64)
        if window:
            f = windowed(f, float(f.mean()) if center is None else center, span(f) if width is None else width)
        else:
            f = (f - f.min()) / span(f) * 255
        out = f.clip(0, 255).astype(np.uint8)
        return 255 - out if photometric == "MONOCHROME1" else out
    x = to_rgb(x, photometric)
    return x if x.dtype == np.uint8 else ((x.astype(np.float64) - x.min()) / span(x) * 255).clip(0, 255).astype(np.uint8)


def to_png(pixels: np.ndarray) -> bytes:
    """A PNG of 8-bit grey or RGB pixels, with the standard library alone."""
    rows, columns = pixels.shape[:2]
    lines = b"".join(b"\0" + line.tobytes() for line in np.ascontiguousarray(pixels))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", columns, rows, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The pixels of a PNG that `to_png` wrote."""
    columns, rows, _, colour = struct.unpack_from(">IIBB", data, 16)
    body, p = b"", 8
    while p < len(data):
        n, kind = struct.unpack_from(">I4s", data, p)
        body += data[p + 8 : p + 8 + n] if kind == b"IDAT" else b""
        p += 12 + n
    samples = 3 if colour == 2 else 1
    flat = np.frombuffer(zlib.decompress(body), np.uint8).reshape(rows, 1 + columns * samples)[:, 1:]
    return flat.reshape(rows, columns, 3) if samples == 3 else flat


def to_jpeg(pixels: np.ndarray, quality: int = 85, progressive: bool = False, optimize: bool = False) -> bytes:
    """A JPEG, if Pillow can be imported; quality 1 to 95."""
    if not 1 <= quality <= 95:
        raise ValueError("quality must be from 1 to 95")
    try:
        from PIL import Image
    except ImportError as missing:
        raise RuntimeError("JPEG previews need Pillow; PNG previews do not") from missing
    import io

    out = io.BytesIO()
    Image.fromarray(pixels).save(out, "JPEG", quality=quality, progressive=progressive, optimize=optimize)
    return out.getvalue()


def from_jpeg(data: bytes, mode: str = "L") -> np.ndarray:
    """The pixels of a JPEG in a mode of Pillow's (L is grey), if that can be imported."""
    try:
        from PIL import Image
    except ImportError as missing:
        raise RuntimeError("reading JPEG previews needs Pillow") from missing
    import io

    return np.asarray(Image.open(io.BytesIO(data)).convert(mode))


def previews(frames: DataFrame, id_col: str, photometric_col: str, window: bool = True, center: float | None = None, width: float | None = None, encode: Callable[[np.ndarray], bytes] = to_png) -> DataFrame:
    """(id, frame, preview): an image of every row of `decode` (with ``photometric_col`` joined to it).

    The window is the one given; else that of the columns ``window_center`` and ``window_width``, where ``frames`` has
    them and they are not null; else the frame's mean and range. ``encode`` makes the image, `to_png` or `to_jpeg`.
    """
    kind, told = frames.schema[id_col].dataType.simpleString(), [c for c in ("window_center", "window_width") if c in frames.columns]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x = np.array(r["pixels"]).reshape(r["shape"])
                x = x.astype(np.uint8) if x.ndim == 3 and x.min() >= 0 and x.max() <= 255 else x
                middle = r.get("window_center") if center is None else center
                out.append(encode(raster(x, r["photometric"], window, middle, r.get("window_width") if width is None else width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=[id_col, "frame", "preview"])

    rows = frames.filter("error is null").select(id_col, "frame", "shape", "pixels", F.col(photometric_col).alias("photometric"), *[F.col(c).cast("double") for c in told])
    return rows.mapInArrow(run, f"`{id_col}` {kind}, frame int, preview binary")
