"""Two-valued filter trees, time windows and request validation.

A comparison with a missing value is false, and `not` turns it into true: each leaf is made two-valued before any
negation, so `not (x = v)` keeps rows without x.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta, timezone
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_IN_VALUES = 1000
BOUNDS = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


class RequestError(ValueError):
    """A request that can't be answered as stated; `code` names the reason."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def two_valued(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def compile_filter(tree: Mapping, families: Mapping[str, list[str]] | None = None) -> Column:
    """{"all": [...]}, {"any": [...]}, {"not": tree} or a leaf {"field", "op", "value"}; ops: eq, in, range, exists,
    family. Empty all and any are true."""
    if "all" in tree:
        return reduce(Column.__and__, (compile_filter(t, families) for t in tree["all"]), F.lit(True))
    if "any" in tree:
        return reduce(Column.__or__, (compile_filter(t, families) for t in tree["any"])) if tree["any"] else F.lit(True)
    if "not" in tree:
        return ~compile_filter(tree["not"], families)
    column, op, value = F.col(tree["field"]), tree["op"], tree.get("value")
    if op == "eq":
        return two_valued(column == F.lit(value))
    if op == "exists":
        return column.isNotNull() if value else column.isNull()
    if op == "family":
        if value not in (families or {}):
            raise RequestError("needs_clarification", f"unknown family {value!r}")
        op, value = "in", families[value]
    if op == "in":
        values = list(dict.fromkeys(value))
        if not values or len(values) > MAX_IN_VALUES:
            raise RequestError("invalid_filter", f"in takes 1 to {MAX_IN_VALUES} values")
        return two_valued(column.isin(values))
    if op == "range":
        if not value or set(value) - set(BOUNDS) or {"gt", "gte"} <= set(value) or {"lt", "lte"} <= set(value):
            raise RequestError("invalid_filter", "a range has one bound on each side at most")
        if any(isinstance(v, float) and not math.isfinite(v) for v in value.values()):
            raise RequestError("invalid_filter", "bounds must be finite")
        return two_valued(reduce(Column.__and__, (BOUNDS[k](column, F.lit(v)) for k, v in value.items())))
    raise RequestError("invalid_filter", f"unknown operation {op!r}")


def half_open(column: str, start: object, end: object) -> Column:
    """start <= column < end; null is outside."""
    return two_valued((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def in_periods(column: str, periods: Iterable[tuple[object, object]]) -> Column:
    """Inside any of the half-open periods; gaps between them are outside."""
    return reduce(Column.__or__, (half_open(column, a, b) for a, b in periods))


def last_month(as_of: datetime, zone: str) -> tuple[datetime, datetime]:
    """The local calendar month before as_of, as UTC instants."""
    local = as_of.astimezone(ZoneInfo(zone))
    end = local.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    start = (end - timedelta(days=1)).replace(day=1)
    return tuple(datetime(x.year, x.month, 1, tzinfo=ZoneInfo(zone)).astimezone(timezone.utc) for x in (start, end))


def require_coverage(coverage: Mapping, start: str, end: str) -> None:
    """Comparisons and calendar buckets need a dataset that is complete over the whole window."""
    if not coverage.get("complete") or start < coverage["gte"] or end > coverage["lt"]:
        raise RequestError("coverage_gap", f"{start} to {end} is not covered")


def project(df: DataFrame, fields: list[str], allowed: Iterable[str]) -> DataFrame:
    """The named fields; others than the allowed ones are an error."""
    if unknown := set(fields) - set(allowed):
        raise RequestError("invalid_field", ", ".join(sorted(unknown)))
    return df.select(*fields)


def bounded(df: DataFrame, most: int, what: str = "rows") -> DataFrame:
    """df, or an error if it has more than `most` rows; nothing is cut off silently."""
    if len(df.limit(most + 1).select(F.lit(1)).collect()) > most:
        raise RequestError("budget_exceeded", f"more than {most} {what}")
    return df
