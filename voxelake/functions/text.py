"""Character sets and query-string text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from voxelake.dims import CHARSETS, PREFERRED_CHARSET, TAG_OF
from voxelake.functions.tags import lookup


def normalize_charset(value: Column) -> Column:
    """Terms of a backslash-separated specific character set in normal form; the default repertoire for none."""
    term = lambda t: F.upper(F.regexp_replace(F.trim(F.replace(t, F.lit("_"), F.lit(" "))), r"\s+", " "))
    fixed = lambda t: (
        F.when(t.rlike("^ISO IR [0-9]+$"), F.replace(t, F.lit("ISO IR"), F.lit("ISO_IR")))
        .when(t.isin("UTF-8", "UTF8"), F.lit("ISO_IR 192"))
        .otherwise(t)
    )
    terms = F.filter(F.transform(F.split(value, r"\\"), lambda t: fixed(term(t))), lambda t: t != "")
    default = F.array(F.lit("ISO_IR 6"))
    return F.when(value.isNull() | (F.size(terms) == 0), default).otherwise(terms)


def dataset_charset(ds: Column) -> Column:
    """The terms that a dataset declares, the default repertoire if it declares none."""
    return normalize_charset(F.try_element_at(ds, F.lit(TAG_OF["SpecificCharacterSet"])))


def charset_codecs(value: Column) -> Column:
    """Codecs of a character set in the order they are tried, null if a term is unknown. With code extensions
    (ISO 2022) ASCII comes last."""
    terms = normalize_charset(value)
    codecs = F.transform(terms, lambda t: lookup(CHARSETS, t))
    extended = F.exists(terms, lambda t: t.startswith("ISO 2022 "))
    last = F.concat(F.filter(codecs, lambda c: c != "ascii"), F.filter(codecs, lambda c: c == "ascii"))
    known = F.forall(codecs, lambda c: c.isNotNull())
    return F.when(known, F.array_distinct(F.when(extended, last).otherwise(codecs)))


def preferred_charset(encoding: Column) -> Column:
    """The defined term of a named encoding; null if there is none."""
    return lookup(PREFERRED_CHARSET, F.replace(F.lower(F.trim(encoding)), F.lit(" "), F.lit("-")))


def is_ascii(text: Column) -> Column:
    return text.rlike(r"\A[\x00-\x7F]*\z")


def _first(codecs, convert):
    for codec in codecs if codecs is not None else ():
        try:
            return convert(codec)
        except (UnicodeError, LookupError):
            continue
    return None


@F.pandas_udf(T.BinaryType())
def _encode(text: pd.Series, codecs: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _first(c, t.encode) for t, c in zip(text, codecs, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _decode(data: pd.Series, codecs: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else _first(c, bytes(b).decode) for b, c in zip(data, codecs, strict=True)], dtype=object)


def encode_text(text: Column, charset: Column) -> Column:
    """Bytes by the first codec of the character set that can encode the text; null if none can."""
    return _encode(text, charset_codecs(charset))


def decode_text(data: Column, charset: Column) -> Column:
    """Text by the first codec of the character set that can decode the bytes; null if none can."""
    return _decode(data, charset_codecs(charset))


def can_encode(text: Column, charset: Column) -> Column:
    """Whether some codec encodes the text: JVM-side for ASCII text and for UTF-8, Latin-1 and ASCII alone; Python
    codecs else. False for an unknown term, whatever the text."""
    codecs = charset_codecs(charset)
    has = lambda name: F.array_contains(codecs, name)
    plain = F.forall(codecs, lambda c: c.isin("ascii", "utf-8", "latin_1"))
    native = has("utf-8") | (has("latin_1") & text.rlike(r"\A[\x00-\xFF]*\z")) | is_ascii(text)
    return F.when(codecs.isNull(), F.lit(False)).when(plain, native).otherwise(_encode(text, codecs).isNotNull())


def valid_for_write(text: Column, charset: Column) -> Column:
    """ASCII text always is, even if the character set is unknown."""
    return is_ascii(text) | can_encode(text, charset)


def quote_plus(text: Column) -> Column:
    """Form-urlencoding in which ``*`` is encoded and ``~`` is not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
