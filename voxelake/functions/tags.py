"""Tags as eight upper-case hex digits: parsing, labels, predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxelake.dims import FILE_VR, JSON_VR, KEYWORD_OF, TAG_OF


def let(value: Column, body) -> Column:
    """``body(value)`` with the value made once a row: a column named twice in an expression may be computed twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(table: dict, key: Column) -> Column:
    """A value of a small fixed dictionary, null where it lacks the key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def parse_tag(text: Column) -> Column:
    """A keyword, ``(gggg,eeee)``, ``gggg,eeee`` with any number of hex digits, or eight hex digits; else null."""
    bare = F.replace(F.regexp_replace(F.trim(text), r"^\((.*)\)$", "$1"), F.lit(" "), F.lit(""))
    part = lambda i: F.upper(F.lpad(F.regexp_replace(F.split_part(bare, F.lit(","), F.lit(i)), "^0+(?=.)", ""), 4, "0"))
    return (
        F.when(lookup(TAG_OF, F.trim(text)).isNotNull(), lookup(TAG_OF, F.trim(text)))
        .when(bare.rlike("^0*[0-9A-Fa-f]{1,4},0*[0-9A-Fa-f]{1,4}$"), F.concat(part(1), part(2)))
        .when(bare.rlike("^[0-9A-Fa-f]{8}$"), F.upper(bare))
    )


def tag_of_int(value: Column) -> Column:
    """The tag of a packed integer; bits beyond 32 are dropped."""
    return F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")


def tag_of_pair(group: Column, element: Column) -> Column:
    """The tag of a group and an element; null outside 0 to 65535."""
    fits = group.between(0, 0xFFFF) & element.between(0, 0xFFFF)
    return F.when(fits, F.concat(F.lpad(F.hex(group), 4, "0"), F.lpad(F.hex(element), 4, "0")))


def tag_value(tag: Column) -> Column:
    return F.conv(tag, 16, 10).cast("long")


def is_private(tag: Column) -> Column:
    """Odd groups are private."""
    return F.substring(tag, 4, 1).isin(*"13579BDF")


def tag_label(tag: Column) -> Column:
    return F.concat(F.lit("("), F.substring(tag, 1, 4), F.lit(","), F.substring(tag, 5, 4), F.lit(")"))


def tag_name(tag: Column) -> Column:
    """``Tag.Keyword``, or ``Tag(GGGG,EEEE)`` for tags of no keyword."""
    return F.coalesce(F.concat(F.lit("Tag."), lookup(KEYWORD_OF, tag)), F.concat(F.lit("Tag"), tag_label(tag)))


def query_key(tag_text: Column) -> Column:
    """The keyword of a known tag, else its eight digits."""
    tag = parse_tag(tag_text)
    return F.coalesce(lookup(KEYWORD_OF, tag), tag)


def file_vr(tag: Column, bits_allocated: Column) -> Column:
    """The value representation in files: pixel data by its allocated bits (OB up to 8, else OW, 16 if unknown),
    unlisted tags UN."""
    pixels = F.when(F.coalesce(bits_allocated.try_cast("int"), F.lit(16)) <= 8, F.lit("OB")).otherwise(F.lit("OW"))
    return F.when(tag == TAG_OF["PixelData"], pixels).otherwise(F.coalesce(lookup(FILE_VR, tag), F.lit("UN")))


def json_vr(tag: Column) -> Column:
    """The value representation in DICOM JSON; unlisted tags UN."""
    return F.coalesce(lookup(JSON_VR, tag), F.lit("UN"))
