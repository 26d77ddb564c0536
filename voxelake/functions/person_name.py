"""Person names: five components, three groups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

COMPONENTS = ("family_name", "given_name", "middle_name", "name_prefix", "name_suffix")
GROUPS = ("ideographic", "phonetic")


def parse_person_name(value: Column) -> Column:
    """A struct of the components, the two further groups as they stand, and ``error`` (null if the name is sound)."""
    groups = F.split(value, "=")
    parts = F.split(groups[0], r"\^")
    at = lambda items, i: F.coalesce(F.try_element_at(items, F.lit(i)), F.lit(""))
    error = F.when(F.size(groups) > 3, F.lit("more than three groups")).when(F.size(parts) > 5, F.lit("more than five components"))
    fields = [at(parts, i + 1).alias(n) for i, n in enumerate(COMPONENTS)] + [at(groups, i + 2).alias(n) for i, n in enumerate(GROUPS)]
    return F.struct(*fields, error.alias("error"))


def format_person_name(name: Column) -> Column:
    """The text of a parsed name without trailing separators; null if a separator stands within a part."""
    bad = F.lit(False)
    for part in COMPONENTS:
        bad = bad | name[part].rlike("[=^]")
    for part in GROUPS:
        bad = bad | name[part].contains("=")
    alphabetic = F.regexp_replace(F.concat_ws("^", *[name[p] for p in COMPONENTS]), r"\^+$", "")
    return F.when(~bad, F.regexp_replace(F.concat_ws("=", alphabetic, *[name[g] for g in GROUPS]), "=+$", ""))


def display_name(name: Column) -> Column:
    """``prefix given middle family, suffix``, else the ideographic, else the phonetic group with spaces."""
    order = F.array(name["name_prefix"], name["given_name"], name["middle_name"], name["family_name"])
    main = F.array_join(F.filter(order, lambda x: x != ""), " ")
    suffix = name["name_suffix"]
    full = F.when(suffix == "", main).when(main == "", suffix).otherwise(F.concat(main, F.lit(", "), suffix))
    other = F.when(name["ideographic"] != "", name["ideographic"]).otherwise(name["phonetic"])
    return F.when(full != "", full).otherwise(F.replace(other, F.lit("^"), F.lit(" ")))
