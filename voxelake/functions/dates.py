"""Date shifting of DA and DT text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def shift_date(value: Column, days: Column | int) -> Column:
    """The first eight characters moved by ``days``, the rest kept; unchanged unless they are a calendar date of the
    years 1 to 9999 that stays in them. Years before 1000 keep their zeros."""
    days = F.lit(days) if isinstance(days, int) else days
    date = F.when(value.rlike(r"^[0-9]{8}") & (F.substring(value, 1, 4) != "0000"), F.try_to_date(F.substring(value, 1, 8), "yyyyMMdd"))
    moved = F.date_add(date, days)
    fits = F.year(moved).between(1, 9999)
    return F.when(fits, F.concat(F.date_format(moved, "yyyyMMdd"), F.substr(value, F.lit(9)))).otherwise(value)
