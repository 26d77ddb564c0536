"""Pixel metadata rules and pixel arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxelake.dims import SAMPLES, TAG_OF
from voxelake.functions.tags import lookup

# fixed values: the message texts below, the allowed BitsAllocated, and the fields that must be positive, in the order they are checked
BITS_ALLOCATED = (1, 8, 16, 32, 64)
POSITIVE = ("Rows", "Columns", "SamplesPerPixel", "BitsAllocated", "BitsStored", "NumberOfFrames")


def photometric(text: Column) -> Column:
    return F.upper(F.trim(text))


def is_monochrome(text: Column) -> Column:
    return photometric(text).isin("MONOCHROME1", "MONOCHROME2")


def needs_inversion(text: Column) -> Column:
    return photometric(text) == "MONOCHROME1"


def expected_samples(text: Column) -> Column:
    """1 or 3 by photometric interpretation, null for unknown ones."""
    return lookup(SAMPLES, photometric(text))


def first_value(value: Column) -> Column:
    """The first of a multi-valued attribute (backslash separated text)."""
    return F.split_part(value, F.lit("\\"), F.lit(1))


def integer(value: Column) -> Column:
    """An integer from text or number: no fraction in text, numbers are truncated; null if it is none."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def number(value: Column) -> Column:
    """The first value of an attribute as a double; null if it is none."""
    return F.trim(first_value(value.cast("string"))).try_cast("double")


def dataset_number(ds: Column, keyword: str, default: float) -> Column:
    """A number of a dataset: the default where it is absent or null, an error where it is no number."""
    raw = F.try_element_at(ds, F.lit(TAG_OF[keyword]))
    bad = F.raise_error(F.concat(F.lit(f"{keyword} must be a number, got '"), raw, F.lit("'.")))
    return F.when(raw.isNull(), F.lit(default)).when(number(raw).isNotNull(), number(raw)).otherwise(bad.cast("double"))


def _rules(m: dict[str, Column]) -> list[Column]:
    text = lambda c: c.cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else text(p) for p in parts])
    photo = photometric(m["PhotometricInterpretation"])
    samples, high, stored, allocated = m["SamplesPerPixel"], m["HighBit"], m["BitsStored"], m["BitsAllocated"]
    signed = m["PixelRepresentation"] == 1
    rules = [F.when(m[k] <= 0, say(f"{k} must be positive, got ", m[k], ".")) for k in POSITIVE]
    rules += [
        F.when(~allocated.isin(*BITS_ALLOCATED), say(f"BitsAllocated must be one of {list(BITS_ALLOCATED)}, got ", allocated, ".")),
        F.when(stored > allocated, say("BitsStored (", stored, ") cannot exceed BitsAllocated (", allocated, ").")),
        F.when(high >= allocated, say("HighBit (", high, ") must be less than BitsAllocated (", allocated, ").")),
        F.when(high != stored - 1, say("HighBit (", high, ") must equal BitsStored - 1 (", stored - 1, ").")),
        F.when(~m["PixelRepresentation"].isin(0, 1), say("PixelRepresentation must be 0 (unsigned) or 1 (signed), got ", m["PixelRepresentation"], ".")),
        F.when(signed & (stored < 2), say("BitsStored must be at least 2 for signed pixel data (PixelRepresentation=1), got ", stored, ".")),
        F.when(expected_samples(photo).isNull(), say("Unsupported photometric interpretation '", photo, "'.")),
        F.when(samples != expected_samples(photo), say(photo, " usually requires SamplesPerPixel ", expected_samples(photo), ", got ", samples, ".")),
        F.when((samples > 1) & ~F.coalesce(m["PlanarConfiguration"].isin(0, 1), F.lit(False)), F.lit("PlanarConfiguration must be 0 or 1 when SamplesPerPixel is greater than 1.")),
    ]
    return rules


def metadata_errors(m: dict[str, Column]) -> Column:
    """All violated rules, in checking order. ``m`` has columns by keyword: the `POSITIVE` ones, HighBit,
    PixelRepresentation, PhotometricInterpretation and PlanarConfiguration."""
    return F.filter(F.array(*_rules(m)), lambda r: r.isNotNull())


def metadata_error(m: dict[str, Column]) -> Column:
    """The first violated rule, null if there is none; rules behind it are not looked at."""
    return F.coalesce(*_rules(m))


def frame_sizes(m: dict[str, Column]) -> Column:
    """A struct of frame_pixels, frame_values, bytes_per_sample, frame_bytes and pixel_bytes. One allocated bit gives
    zero bytes a sample."""
    pixels = m["Rows"].cast("long") * m["Columns"]
    values = pixels * m["SamplesPerPixel"]
    size = F.floor(m["BitsAllocated"] / 8).cast("long")
    return F.struct(
        pixels.alias("frame_pixels"), values.alias("frame_values"), size.alias("bytes_per_sample"), (values * size).alias("frame_bytes"), (values * size * m["NumberOfFrames"]).alias("pixel_bytes")
    )


def length_error(length: Column, expected: Column, last_byte_zero: Column) -> Column:
    """What is wrong with the pixel data's length: one zero byte of padding may follow an odd length."""
    padded = (expected % 2 == 1) & (length == expected + 1)
    wrong = F.concat(F.lit("PixelData length mismatch: expected "), expected.cast("string"), F.lit(" bytes from frame metadata, got "), length.cast("string"), F.lit("."))
    return F.when((length != expected) & ~padded, wrong).when(padded & ~last_byte_zero, F.lit("PixelData odd-length padding byte must be zero."))


def rescale(value: Column, slope: Column, intercept: Column) -> Column:
    return value * slope + intercept


def rescale_array(values: Column, slope: Column, intercept: Column) -> Column:
    return F.transform(values, lambda v: v * slope + intercept)


def rescale_preview(values: Column, slope: Column, intercept: Column) -> Column:
    """As `rescale_array`, but a slope of zero or none counts as one: how frames are rescaled on decoding."""
    return rescale_array(values, F.when(F.coalesce(slope, F.lit(0.0)) == 0, 1.0).otherwise(slope), F.coalesce(intercept, F.lit(0.0)))


def rescale_from_dataset(value: Column, ds: Column) -> Column:
    """`rescale` by the dataset's slope and intercept, 1 and 0 where it has none; a slope of zero counts."""
    return rescale(value, dataset_number(ds, "RescaleSlope", 1.0), dataset_number(ds, "RescaleIntercept", 0.0))


def voi_bounds(center: Column, width: Column) -> Column:
    """struct(lower, upper) of a window; null for a width that is not positive."""
    half = (width - 1) / 2
    return F.when(width > 0, F.struct((center - 0.5 - half).alias("lower"), (center - 0.5 + half).alias("upper")))


def voi_window(value: Column, center: Column, width: Column, low: float = 0.0, high: float = 255.0) -> Column:
    """Linear window; null for a width that is not positive."""
    bounds = voi_bounds(center, width)
    inside = ((value - (center - 0.5)) / (width - 1) + 0.5) * (high - low) + low
    return F.when(width > 0, F.when(value <= bounds["lower"], F.lit(low)).when(value > bounds["upper"], F.lit(high)).otherwise(inside))


def voi_window_from_dataset(value: Column, ds: Column) -> Column:
    """`voi_window` by the dataset's first center and width, 0 and 1 where it has none."""
    return voi_window(value, dataset_number(ds, "WindowCenter", 0.0), dataset_number(ds, "WindowWidth", 1.0))


def lut_of_descriptor(descriptor: Column, table: Column) -> Column:
    """struct(first, bits, table) of a lookup table whose descriptor is (entries, first value, bits an entry): zero
    entries are 65,536. An error if the descriptor has not three values, the entries differ or there are no bits."""
    entries = F.try_element_at(descriptor, F.lit(1)).cast("int")
    entries = F.when(entries == 0, 65536).otherwise(entries)
    bits = F.try_element_at(descriptor, F.lit(3)).cast("int")
    problem = (
        F.when(F.size(descriptor) != 3, F.lit("VOI LUT descriptor must contain exactly three values."))
        .when(entries != F.size(table), F.concat(F.lit("VOI LUT descriptor declares "), entries.cast("string"), F.lit(" entries, got "), F.size(table).cast("string"), F.lit(".")))
        .when(bits <= 0, F.concat(F.lit("VOI LUT bits per entry must be positive, got "), bits.cast("string"), F.lit(".")))
    )
    made = F.struct(F.try_element_at(descriptor, F.lit(2)).cast("long").alias("first"), bits.alias("bits"), table.alias("table"))
    return F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(made)


def voi_lut(value: Column, first: Column, table: Column) -> Column:
    """The table's entry for a value, truncated and clamped to its ends."""
    at = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("long") - first
    return F.element_at(table, (F.least(F.greatest(at, F.lit(0)), F.size(table) - 1) + 1).cast("int"))


# fixed values: BT.601 coefficients
RED_CR, GREEN_CB, GREEN_CR, BLUE_CB = 1.402, 0.344136, 0.714136, 1.772


def ybr_to_rgb(y: Column, cb: Column, cr: Column, partial: bool = False) -> Column:
    """struct(r, g, b) of 8-bit components, clipped and truncated. Partial range: luma 16 to 235, chroma 16 to 240."""
    luma, chroma = ((y - 16.0) * (255.0 / 219.0), 255.0 / 224.0) if partial else (y * 1.0, 1.0)
    blue, red = (cb - 128.0) * chroma, (cr - 128.0) * chroma
    clip = lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("int")
    return F.struct(clip(luma + RED_CR * red).alias("r"), clip(luma - GREEN_CB * blue - GREEN_CR * red).alias("g"), clip(luma + BLUE_CB * blue).alias("b"))


def stretch(values: Column) -> Column:
    """A frame's values spread over 0 to 255; a flat frame becomes zero."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.when(high > low, (v - low) / (high - low) * 255.0).otherwise(F.lit(0.0)))
