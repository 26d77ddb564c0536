"""The DICOM JSON model as text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxelake.dims import JSON_VR
from voxelake.functions.tags import lookup, parse_tag


def encode(ds: Column) -> Column:
    """DICOM JSON text of a flat dataset, keys in tag order: an empty text is a value, a null has none, names go
    under Alphabetic, bytes are not among flat values."""

    def element(e):
        vr = F.coalesce(lookup(JSON_VR, e["key"]), F.lit("UN"))
        name = F.concat(F.lit('{"vr":"PN","Value":['), F.to_json(F.struct(e["value"].alias("Alphabetic"))), F.lit("]}"))
        plain = F.concat(F.lit('{"vr":"'), vr, F.lit('","Value":'), F.to_json(F.array(e["value"])), F.lit("}"))
        bare = F.concat(F.lit('{"vr":"'), vr, F.lit('"}'))
        return F.concat(F.lit('"'), e["key"], F.lit('":'), F.when(e["value"].isNull(), bare).when(vr == "PN", name).otherwise(plain))

    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(ds)), element), ","), F.lit("}"))


def inline_binary(data: Column) -> Column:
    """The JSON of a binary element."""
    return F.concat(F.lit('{"vr":"OB","InlineBinary":"'), F.base64(data), F.lit('"}'))


def decode(json: Column) -> Column:
    """A flat dataset from DICOM JSON text. One value stands alone, several as JSON; names keep their alphabetic
    group; inline binary stays in Base64; an element of none of these is an empty text. Later duplicates win."""
    schema = "map<string, struct<vr: string, Value: array<string>, InlineBinary: string, BulkDataURI: string>>"
    entries = F.map_entries(F.from_json(json, schema))

    def value(e):
        one = F.try_element_at(e["value"]["Value"], F.lit(1))
        text = F.when(e["value"]["vr"] == "PN", F.coalesce(F.get_json_object(one, "$.Alphabetic"), one)).otherwise(one)
        many = F.to_json(e["value"]["Value"])
        return (
            F.when((F.size(e["value"]["Value"]) == 1) & (e["value"]["vr"] != "SQ"), text)
            .when(F.size(e["value"]["Value"]) >= 1, many)
            .otherwise(F.coalesce(e["value"]["InlineBinary"], e["value"]["BulkDataURI"], F.lit("")))
        )

    return F.map_from_entries(F.transform(entries, lambda e: F.struct(parse_tag(e["key"]).alias("key"), value(e).alias("value"))))


def split_array(json: Column) -> Column:
    """Datasets of a response: the elements of a JSON array, or the one object."""
    many = F.from_json(json, "array<variant>")
    return F.when(F.ltrim(json).startswith("["), F.transform(many, lambda v: F.to_json(v))).otherwise(F.array(json))


def message(ds: Column) -> Column:
    """A flat dataset as a service message: sorted ``(GGGG,EEEE)`` keys."""
    entry = lambda e: F.struct(F.concat(F.lit("("), F.substring(e["key"], 1, 4), F.lit(","), F.substring(e["key"], 5, 4), F.lit(")")).alias("key"), e["value"].alias("value"))
    return F.to_json(F.map_from_entries(F.transform(F.array_sort(F.map_entries(ds)), entry)))


def from_message(text: Column) -> Column:
    entries = F.map_entries(F.from_json(text, "map<string, string>"))
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(parse_tag(e["key"]).alias("key"), e["value"].alias("value"))))
