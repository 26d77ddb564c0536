"""Query building: parameters of a search, and the same search on a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, functions as F

from voxelake.dims import KEYWORD_OF, TAG_OF


def key_of(tag: str) -> str:
    """The keyword of a known tag, else its eight digits."""
    if tag in TAG_OF:
        return tag
    bare = tag.strip("()").replace(",", "").replace(" ", "").upper()
    if len(bare) != 8 or any(c not in "0123456789ABCDEF" for c in bare):
        raise ValueError(f"not a tag: {tag!r}")
    return KEYWORD_OF.get(bare, bare)


@dataclass(frozen=True)
class Query:
    """An immutable query; every method returns a longer one."""

    params: tuple[tuple[str, str], ...] = ()

    def match(self, tag: str, value) -> Query:
        return Query((*self.params, (key_of(tag), str(value))))

    def patient_id(self, value) -> Query:
        return self.match("PatientID", value)

    def patient_name(self, value) -> Query:
        return self.match("PatientName", value)

    def modality(self, value) -> Query:
        return self.match("Modality", value)

    def study_date(self, value) -> Query:
        return self.match("StudyDate", value)

    def include_field(self, tag: str) -> Query:
        return Query((*self.params, ("includefield", tag if tag == "all" else key_of(tag))))

    def _paging(self, key: str, n: int) -> Query:
        if n < 0:
            raise ValueError(f"{key} must not be negative")
        return Query((*[p for p in self.params if p[0] != key], (key, str(n))))

    def limit(self, n: int) -> Query:
        return self._paging("limit", n)

    def offset(self, n: int) -> Query:
        return self._paging("offset", n)

    def to_query_string(self) -> str:
        return urlencode(self.params)

    def condition(self, column: Column, value: str) -> Column:
        """One match: ``a-b`` is a range of dates or times, ``*`` and ``?`` are wildcards, anything else is equality."""
        low, dash, high = value.partition("-")
        if dash and (low + high).isdigit():
            out = F.lit(True)
            out = out & (column >= low) if low else out
            return out & (column <= high) if high else out
        if "*" in value or "?" in value:
            pattern = value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
            return column.like(pattern)
        return column == value

    def apply(self, df: DataFrame, order: list[str]) -> DataFrame:
        """The search on columns named by keyword: filters first (they reach the scan), then order, offset and limit,
        then the included columns (all if none is named). ``order`` makes paging deterministic."""
        paging, fields = {}, []
        for key, value in self.params:
            if key in ("limit", "offset"):
                paging[key] = int(value)
            elif key == "includefield":
                fields.append(value)
            else:
                df = df.filter(self.condition(F.col(key), value))
        if paging:
            df = df.orderBy(*order)
            df = df.offset(paging["offset"]) if "offset" in paging else df
            df = df.limit(paging["limit"]) if "limit" in paging else df
        return df if not fields or "all" in fields else df.select(*dict.fromkeys(fields))
