"""Transfer syntaxes and codecs: classification, lookup, capability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxelake.dims import NATIVE_CODECS, NATIVE_SYNTAXES, TRANSFER_SYNTAXES
from voxelake.functions.pixels import frame_sizes, length_error
from voxelake.functions.tags import let, lookup
from voxelake.operators.validate import pixel_columns, pixel_error


#: Rows that a registry has at most.
MOST_ROWS = 1000


def _known(df: DataFrame, most: int = MOST_ROWS) -> list:
    """The rows of a registry, which is small by nature; an error if it is not."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a registry has {most} rows at most")
    return rows


def classify(df: DataFrame, uid_col: str, more: list[tuple] = ()) -> DataFrame:
    """Add syntax_name, little_endian, explicit_vr, encapsulated. Unknown syntaxes count as encapsulated, explicit,
    little endian. ``more`` rows (uid, name, little_endian, explicit_vr, encapsulated) are registered besides the 14
    fixed ones and replace those of their uid. The registry is a literal: no join, no shuffle."""
    registry = {row[0]: row[1:] for row in (*TRANSFER_SYNTAXES, *more)}
    value = lambda i: lookup({uid: row[i] for uid, row in registry.items()}, F.col(uid_col))
    return df.withColumns({
        "syntax_name": F.coalesce(value(0), F.concat(F.lit("Unknown Transfer Syntax "), F.col(uid_col))),
        **{name: F.coalesce(value(i), F.lit(True)) for i, name in enumerate(("little_endian", "explicit_vr", "encapsulated"), 1)},
    })


def _decoders(codecs: DataFrame | list[tuple] | None) -> dict[str, str]:
    """Syntax -> codec: of the codecs that decode it, the one registered first. ``codecs`` are rows as of `dim_codecs`."""
    rows = NATIVE_CODECS if codecs is None else codecs if isinstance(codecs, list) else _known(codecs)
    able = sorted((row[1], row[0], row[2]) for row in rows if row[3])
    return {uid: name for _, name, uid in reversed(able)}


def find_codec(df: DataFrame, uid_col: str, codecs: DataFrame | list[tuple] | None = None) -> DataFrame:
    """Add codec_name: of the codecs that decode the syntax, the one registered first; null if there is none."""
    found = _decoders(codecs)
    return df.withColumn("codec_name", lookup(found, F.col(uid_col)) if found else F.lit(None).cast("string"))


def supported(df: DataFrame, uid_col: str, codecs: DataFrame | list[tuple] | None = None, yes: bool = True) -> DataFrame:
    """The rows whose syntax some codec decodes, or those of the others."""
    able = F.coalesce(F.col(uid_col).isin(*_decoders(codecs)), F.lit(False))
    return df.filter(able if yes else ~able)


def capability_error(ds: Column, syntax: Column, pixel_data: Column, decodable: Column | None = None) -> Column:
    """The first reason why pixel data cannot be decoded, null if it can: no syntax, bad metadata, no data, no codec,
    wrong length (of uncompressed data)."""
    native = syntax.isin(*NATIVE_SYNTAXES)
    decodable = native if decodable is None else decodable
    zero = F.hex(F.substring(pixel_data, -1, 1)) == "00"

    def judged(ds: Column, error: Column) -> Column:
        expected = frame_sizes(pixel_columns(ds))["pixel_bytes"]
        return (
            F.when(syntax.isNull() | (syntax == ""), F.lit("TransferSyntaxUID is missing."))
            .when(error.isNotNull(), error)
            .when(pixel_data.isNull(), F.lit("PixelData is missing."))
            .when(~decodable, F.concat(F.lit("No codec decodes transfer syntax "), syntax, F.lit(".")))
            .when(native, let(expected, lambda n: length_error(F.octet_length(pixel_data), n, zero)))
        )

    # the map and the metadata's error are made once a row
    return let(ds, lambda ds: let(pixel_error(ds), lambda error: judged(ds, error)))
