"""Datasets: attribute maps (tag -> text) and nested DICOM JSON, with their traversal.

The flat form is a ``map<string, string>`` column: a key that is missing is an absent attribute, a null value a
present null, an empty text a present empty one; the three are never merged. Sequences live in the DICOM JSON form.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxelake.functions.tags import is_private, tag_label, tag_name


def dataset(pairs: dict[str, Column]) -> Column:
    """A flat dataset from tag -> value; a null value is a present null."""
    return F.create_map(*[x for tag, value in pairs.items() for x in (F.lit(tag), value.cast("string"))])


def upsert(ds: Column, changes: Column) -> Column:
    """Set attributes; the last value of a tag wins (the session keeps the last of equal keys)."""
    return F.map_concat(ds, changes)


def delete(ds: Column, *tags: str) -> Column:
    return F.map_filter(ds, lambda k, v: ~k.isin(*tags))


def get(ds: Column, tag: str, default: Column | None = None) -> Column:
    found = F.try_element_at(ds, F.lit(tag))
    return found if default is None else F.when(F.map_contains_key(ds, tag), found).otherwise(default)


def require(ds: Column, tag: str) -> Column:
    """The attribute's value, an error where it is absent."""
    return F.when(F.map_contains_key(ds, tag), F.try_element_at(ds, F.lit(tag))).otherwise(F.raise_error(F.lit(f"Required DICOM tag ({tag[:4]},{tag[4:]}) is missing")))


def without_private(ds: Column) -> Column:
    return F.map_filter(ds, lambda k, v: ~is_private(k))


def count_private(ds: Column) -> Column:
    return F.size(F.filter(F.map_keys(ds), is_private))


def sorted_dataset(ds: Column) -> Column:
    """Labels and values in tag order, as an array of structs."""
    entries = F.array_sort(F.map_entries(ds))
    return F.transform(entries, lambda e: F.struct(tag_label(e["key"]).alias("tag"), e["value"].alias("value")))


def summary(ds: Column) -> Column:
    """The first three tags' names, an ellipsis if there are more, and the count."""
    keys = F.array_sort(F.map_keys(ds))
    names = F.array_join(F.transform(F.slice(keys, 1, 3), tag_name), ", ")
    return F.concat(names, F.when(F.size(keys) > 3, F.lit(", ...")).otherwise(F.lit("")), F.lit(" ("), F.size(keys).cast("string"), F.lit(")"))


def walk(items: dict, path: tuple = (), places: tuple = ()) -> Iterator[tuple]:
    """(path, places, pos, tag, element) of a DICOM JSON object, depth first, an element before its children."""
    stack = [(path, places, pos, tag, element) for pos, (tag, element) in enumerate(items.items())][::-1]
    while stack:
        path, places, pos, tag, element = row = stack.pop()
        yield row
        below = []
        if isinstance(element, dict) and (element.get("vr") == "SQ"):
            for i, item in enumerate(element.get("Value") or []):
                if isinstance(item, dict):
                    below += [((*path, tag), (*places, i), n, t, e) for n, (t, e) in enumerate(item.items())]
        stack += below[::-1]


ELEMENTS = "path array<string>, item_path array<int>, pos int, tag8 string, vr string, value string"


def elements(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """A row for each element at any depth of a DICOM JSON column: (id, path, item_path, pos, tag8, vr, value,
    is_private). ``value`` is the JSON of the element's values. Null datasets have no element."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for path, places, pos, tag, element in walk(json.loads(text)) if text else ():
                    at.append(i)
                    value = element.get("Value", element.get("InlineBinary", element.get("BulkDataURI")))
                    rows.append((list(path), list(places), pos, tag.upper(), element.get("vr"), None if value is None else json.dumps(value, ensure_ascii=False)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.string(), pa.string()]
            names = [id_col, *(x.split(" ")[0] for x in ELEMENTS.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    out = df.select(F.col(id_col), F.col(json_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {ELEMENTS}")
    return out.withColumn("is_private", is_private(F.col("tag8")))


def private_removed(found: DataFrame) -> tuple[DataFrame, Column]:
    """(``found`` without private elements and all below them, the condition of those that removal counts): a private
    element inside a removed one is not counted."""
    below = F.exists("path", is_private)
    return found.filter(~below & ~F.col("is_private")), ~below & F.col("is_private")
