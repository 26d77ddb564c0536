"""Rule-driven de-identification with an audit table.

A plan is made on the driver and becomes expressions on the attribute map: no join, no shuffle, one pass. The audit
explodes the plan's rules (a fixed, small number) on each row. Nested datasets (DICOM JSON) take the same plan
through a recursive Arrow function.
"""

from __future__ import annotations

import datetime
import hashlib
import itertools
import json
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxelake.dims import FILE_VR, JSON_VR, MARKERS, STARTER
from voxelake.functions.dates import shift_date
from voxelake.functions.tags import is_private
from voxelake.functions.uids import DEFAULT_ROOT, DEFAULT_SALT, remap_uid

ACTIONS = ("DELETE", "EMPTY", "REPLACE", "REMAP_UID", "SHIFT_DATE")


@dataclass(frozen=True)
class Plan:
    """Rules (tag, action, replacement). The last rule of a tag wins, at the place of the first."""

    rules: list[tuple[str, str, str | int | None]]
    remove_private: bool = True
    uid_root: str = DEFAULT_ROOT
    uid_salt: str = DEFAULT_SALT
    final: list[tuple[str, str, str | int | None]] = field(init=False)
    #: The places of the rules in ``final`` by tag, and of those that act on absent attributes too.
    places: dict[str, int] = field(init=False)
    always: list[int] = field(init=False)

    def __post_init__(self):
        last: dict[str, tuple] = {}
        for tag, action, replacement in self.rules:
            if action not in ACTIONS:
                raise ValueError(f"unknown action {action}")
            if action == "SHIFT_DATE" and not isinstance(replacement, int):
                raise ValueError("SHIFT_DATE takes a whole number of days")
            last[tag] = (tag, action, replacement)
        object.__setattr__(self, "final", list(last.values()))
        object.__setattr__(self, "places", {t: i for i, (t, _, _) in enumerate(self.final)})
        object.__setattr__(self, "always", [i for i, (t, a, _) in enumerate(self.final) if a == "REPLACE" and t in MARKERS])

    def tags(self, action: str) -> list[str]:
        return [t for t, a, _ in self.final if a == action]

    def listing(self, spark) -> DataFrame:
        """The plan as a table, in order."""
        rows = [(i, t, a, None if r is None else str(r)) for i, (t, a, r) in enumerate(self.final)]
        return spark.createDataFrame(rows, "pos int, tag8 string, action string, replacement string")


def starter_plan(replacements: dict[str, str] | None = None, **options) -> Plan:
    """The starter profile; ``replacements`` change the replacement of its own rules only."""
    replacements = replacements or {}
    return Plan([(t, a, replacements.get(t, r)) for t, a, r in STARTER], **options)


#: The same profile by its other name.
basic_plan = starter_plan


def _new_value(plan: Plan, key: Column, value: Column) -> Column:
    out = F.when(key.isin(*plan.tags("EMPTY")), F.lit("")) if plan.tags("EMPTY") else F.when(F.lit(False), F.lit(""))
    for tag, action, replacement in plan.final:
        if action == "REPLACE":
            out = out.when(key == tag, F.lit(str(replacement)))
        elif action == "SHIFT_DATE":
            out = out.when(key == tag, shift_date(value, replacement))
    if plan.tags("REMAP_UID"):
        # several identifiers stand in one value, separated by backslashes
        mapped = F.array_join(F.transform(F.split(value, r"\\"), lambda u: remap_uid(u, plan.uid_root, plan.uid_salt)), "\\")
        out = out.when(key.isin(*plan.tags("REMAP_UID")), mapped)
    return out.otherwise(value)


def _markers(plan: Plan) -> list[tuple[str, str]]:
    return [(t, str(r)) for t, a, r in plan.final if a == "REPLACE" and t in MARKERS]


def deidentify(ds: Column, plan: Plan, remove_private: bool | None = None) -> Column:
    """The attribute map after the plan: rules first, private attributes second. Rules act on present attributes
    only, but for replacements of the markers, which are always set. ``remove_private``, if given, overrules the plan."""
    out = F.map_filter(ds, lambda k, v: ~k.isin(*plan.tags("DELETE"))) if plan.tags("DELETE") else ds
    out = F.transform_values(out, lambda k, v: _new_value(plan, k, v))
    if markers := _markers(plan):
        out = F.map_concat(out, F.create_map(*[F.lit(x) for pair in markers for x in pair]))
    removes = plan.remove_private if remove_private is None else remove_private
    return F.map_filter(out, lambda k, v: ~is_private(k)) if removes else out


def audit(df: DataFrame, id_col: str, ds_col: str, plan: Plan, redact_previous: bool = True) -> DataFrame:
    """An event for every rule and row, present or not: (id, pos, tag8, action, present, after_present,
    previous_value, replacement, new_value, changed). Previous values are withheld unless asked for; new ones are too
    where they are previous ones. The replacement of a remapped identifier is its new value, empty if it is absent."""
    rules = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("tag8"), F.lit(a).alias("action"), F.lit(None if r is None else str(r)).cast("string").alias("replacement")) for i, (t, a, r) in enumerate(plan.final)])
    rows = df.select(F.col(id_col), F.col(ds_col).alias("__ds"), F.explode(rules).alias("r"))
    previous, action = F.try_element_at("__ds", F.col("r.tag8")), F.col("r.action")
    present = F.map_contains_key("__ds", F.col("r.tag8"))
    marker = F.col("r.tag8").isin(*[t for t, _ in _markers(plan)]) if _markers(plan) else F.lit(False)
    # the very expression that changes the data
    new = F.when(marker, F.col("r.replacement")).when(present & (action != "DELETE"), _new_value(plan, F.col("r.tag8"), previous))
    kept_back = F.lit(redact_previous) & (new == previous) & (action == "SHIFT_DATE")
    return rows.select(
        id_col,
        "r.pos",
        "r.tag8",
        "r.action",
        present.alias("present"),
        (marker | present & (action != "DELETE")).alias("after_present"),
        (F.lit(None).cast("string") if redact_previous else previous).alias("previous_value"),
        F.when(action == "REMAP_UID", F.coalesce(new, F.lit(""))).otherwise(F.col("r.replacement")).alias("replacement"),
        F.when(~F.coalesce(kept_back, F.lit(False)), new).alias("new_value"),
        (present | marker).alias("changed"),
    )


TOLD = "present boolean, after_present boolean, previous_value string, replacement string, new_value string"
EVENT = f"path array<string>, item_path array<int>, pos int, tag8 string, action string, {TOLD}"


def audited_datasets(df: DataFrame, id_col: str, json_col: str, plan: Plan, redact_previous: bool = True) -> DataFrame:
    """The events of `audit_nested`, packed: a row for each dataset, the outer one and each sequence item, (id, path,
    item_path, events, told). ``events`` is their number; ``told`` has those of attributes that are there before or
    after, by the rule's place. All others are told by the plan alone; `event_of` has the event of any rule.
    """
    kind = df.schema[id_col].dataType.simpleString()
    fields = [f.split(" ")[0] for f in TOLD.split(", ")]

    def run(batches):
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    before = len(found)
                    _apply(json.loads(text), plan, found, (), ())
                    at += [i] * (len(found) - before)
            events = [e for _, _, told in found for e in told]
            ends = [0, *itertools.accumulate(len(told) for _, _, told in found)]
            pos, *cols = zip(*events, strict=True) if events else [[]] * 6
            types = (pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string())
            told = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=fields))
            paths = (pa.array([p for p, _, _ in found], pa.list_(pa.string())), pa.array([p for _, p, _ in found], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *paths, told], names=[id_col, "path", "item_path", "told"])

    struct = ", ".join(f.replace(" ", ": ") for f in TOLD.split(", "))
    out = df.select(F.col(id_col), F.col(json_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, path array<string>, item_path array<int>, told map<int, struct<{struct}>>")
    if redact_previous:
        shifted = F.array(*[F.lit(plan.places[t]) for t in plan.tags("SHIFT_DATE")]).cast("array<int>")
        same = lambda k, e: F.coalesce((e["new_value"] == e["previous_value"]) & F.array_contains(shifted, k), F.lit(False))
        kept = lambda k, e: e.withField("new_value", F.when(~same(k, e), e["new_value"])).withField("previous_value", F.lit(None).cast("string"))
        out = out.withColumn("told", F.transform_values("told", kept))
    return out.select(id_col, "path", "item_path", F.lit(len(plan.final)).alias("events"), "told")


def _absent(action: str, replacement) -> str | None:
    """What the event of a rule tells as its replacement where the attribute is absent."""
    return "" if action == "REMAP_UID" else None if replacement is None else str(replacement)


def _told(told: Column, pos: Column, absent: Column) -> dict[str, Column]:
    found = F.try_element_at(told, pos)
    return {
        "present": F.coalesce(found["present"], F.lit(False)),
        "after_present": F.coalesce(found["after_present"], F.lit(False)),
        "previous_value": found["previous_value"],
        "replacement": F.when(found.isNull(), absent).otherwise(found["replacement"]),
        "new_value": found["new_value"],
    }


def event_of(told: Column, plan: Plan, tag: str) -> dict[str, Column]:
    """The event of the tag's rule in a row of `audited_datasets`, by field."""
    _, action, replacement = plan.final[plan.places[tag]]
    return _told(told, F.lit(plan.places[tag]), F.lit(_absent(action, replacement)).cast("string"))


def audit_nested(df: DataFrame, id_col: str, json_col: str, plan: Plan, redact_previous: bool = True) -> DataFrame:
    """The events of `deidentify_nested`: one for every rule and dataset, the outer one and each sequence item that
    its own rules left, those of private sequences too, as rules come before the removal of private elements.

    ``path`` are the sequences' tags from outside in, ``item_path`` the items' places in them; values are JSON. A null
    dataset has no event.
    """
    rules = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("tag8"), F.lit(a).alias("action"), F.lit(_absent(a, r)).cast("string").alias("absent")) for i, (t, a, r) in enumerate(plan.final)])
    rows = audited_datasets(df, id_col, json_col, plan, redact_previous).select(id_col, "path", "item_path", "told", F.explode(rules).alias("r"))
    told = _told(F.col("told"), F.col("r.pos"), F.col("r.absent"))
    return rows.select(id_col, "path", "item_path", "r.pos", "r.tag8", "r.action", *[c.alias(k) for k, c in told.items()])


def reports(events: DataFrame, id_col: str, plan: Plan, private_removed: DataFrame | None = None) -> DataFrame:
    """(id, report): a JSON text a row's id with its events in order, the number of private elements removed (0 unless
    ``private_removed`` has it by id) and what was done with such elements. Events hold what `audit` let through."""
    names = [c for c in events.columns if c != id_col]
    nested = [c for c in ("item_path", "path") if c in names]
    order = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate([*nested, "pos"])], F.struct(*names).alias("event"))
    packed = events.groupBy(id_col).agg(F.array_sort(F.collect_list(order)).alias("__events"))
    removed = F.lit(0).cast("long")
    if private_removed is not None:
        packed = packed.join(private_removed.select(id_col, F.col("removed").cast("long").alias("__removed")), id_col, "left")
        removed = F.coalesce("__removed", removed)
    body = F.struct(F.transform("__events", lambda e: e["event"]).alias("events"), removed.alias("private_tags_removed"), F.lit("REMOVE" if plan.remove_private else "KEEP").alias("private_tag_action"))
    return packed.select(id_col, F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def audit_counts(df: DataFrame, id_col: str, ds_col: str, plan: Plan) -> DataFrame:
    """(id, events, changed, private_removed): a row per input row, without an explode."""
    ds = F.col(ds_col)
    touched = [F.lit(1) if t in dict(_markers(plan)) else F.map_contains_key(ds, t).cast("int") for t, _, _ in plan.final]
    private = F.size(F.filter(F.map_keys(ds), is_private)) if plan.remove_private else F.lit(0)
    return df.select(F.col(id_col), F.lit(len(plan.final)).alias("events"), sum(touched[1:], touched[0]).alias("changed"), private.alias("private_removed"))


def _remap(uid: str, plan: Plan) -> str:
    uid = uid.strip(" ")
    number = str(int.from_bytes(hashlib.sha256(f"{plan.uid_salt}\0{uid}".encode()).digest()[:16], "big"))
    root = plan.uid_root.rstrip(".")
    return f"{root}.{number[: 64 - len(root) - 1]}" if uid else ""


def _shift(text, days: int):
    if not isinstance(text, str) or len(text) < 8 or not (text[:8].isascii() and text[:8].isdigit()):
        return text
    try:
        moved = datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])) + datetime.timedelta(days=days)
    except (ValueError, OverflowError):
        return text
    return f"{moved.year:04d}{moved.month:02d}{moved.day:02d}{text[8:]}"


def _shown(element: dict | None) -> str | None:
    """The value of an element as an event tells it: the text alone if it is one, else JSON."""
    if element is None:
        return None
    values = element.get("Value", [element["InlineBinary"]] if "InlineBinary" in element else [])
    values = [v.get("Alphabetic", "") if isinstance(v, dict) and element.get("vr") == "PN" else v for v in values]
    return (values[0] if isinstance(values[0], str) else json.dumps(values[0])) if len(values) == 1 else json.dumps(values, ensure_ascii=False)


def _ruled(tag: str, action: str, replacement, element: dict | None, plan: Plan) -> dict | None:
    """The element after a rule; None is none."""
    if action == "REPLACE" and (element is not None or tag in MARKERS):
        value = {"Alphabetic": str(replacement)} if JSON_VR.get(tag) == "PN" else str(replacement)
        return {"vr": (element or {}).get("vr") or FILE_VR.get(tag, "UN"), "Value": [value]}
    if element is None or action == "DELETE":
        return None
    if action == "EMPTY":
        return {"vr": element.get("vr"), "Value": [""]}
    if action == "REMAP_UID":
        return {"vr": element.get("vr"), "Value": [_remap(str(v), plan) for v in element.get("Value", [])]}
    if action == "SHIFT_DATE":
        return {"vr": element.get("vr"), "Value": [_shift(v, replacement) for v in element.get("Value", [])]}
    return element


def _apply(dataset: dict, plan: Plan, found: list | None, path: tuple, places: tuple) -> dict:
    """The plan on a dataset, then on the items left in it, then the removal of private elements. ``found`` takes
    (path, places, events) of the dataset and then of its items. Rules of absent attributes have nothing to do, but
    for markers, so those of present ones are looked up."""
    out, told = {tag.upper(): element for tag, element in dataset.items()}, []
    for pos in sorted({*plan.always, *(plan.places[tag] for tag in out.keys() & plan.places.keys())}):
        tag, action, replacement = plan.final[pos]
        before = out.get(tag)
        after = _ruled(tag, action, replacement, before, plan)
        if after is None:
            out.pop(tag, None)
        else:
            out[tag] = after
        if found is not None:
            said = (_shown(after) or "") if action == "REMAP_UID" else _absent(action, replacement)
            told.append((pos, before is not None, after is not None, _shown(before), said, _shown(after)))
    if found is not None:
        found.append((path, places, told))
    for tag, element in out.items():
        if element.get("vr") == "SQ":
            items = [_apply(x, plan, found, (*path, tag), (*places, i)) if isinstance(x, dict) else x for i, x in enumerate(element.get("Value", []))]
            out[tag] = element | {"Value": items}
    return {tag: element for tag, element in out.items() if int(tag[3], 16) % 2 == 0} if plan.remove_private else out


def deidentify_json(dataset: dict, plan: Plan) -> dict:
    """The plan on a DICOM JSON object and, after its own rules, on every sequence item that is left of it."""
    return _apply(dataset, plan, None, (), ())


def deidentify_nested(json_col: Column, plan: Plan) -> Column:
    """`deidentify_json` over a column of DICOM JSON text; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else json.dumps(deidentify_json(json.loads(t), plan), ensure_ascii=False) for t in texts], dtype=object)

    return run(json_col)
