"""The two kinds of intervals. Knowledge and state intervals are half-open, operating periods include both ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible_on(start: Column, end: Column, day: Column) -> Column:
    """start <= day < end; a null end is open."""
    return (start <= day) & (end.isNull() | (day < end))


def operates_within(first: Column, last: Column, day: Column) -> Column:
    """first <= day <= last."""
    return (first <= day) & (day <= last)


def overlap(first: Column, last: Column, other_first: Column, other_last: Column) -> Column:
    """Whether two periods that include both ends share a day."""
    return (first <= other_last) & (other_first <= last)


def on_weekday(day: Column, monday_to_sunday: list[str]) -> Column:
    """The flag of the day's ISO weekday; an unknown flag is false."""
    return F.coalesce(F.element_at(F.array(*monday_to_sunday), F.weekday(day) + 1), F.lit(False))


def ladder(value: Column, steps: list[tuple[str, int | None]]) -> Column:
    """The label of the first step whose upper bound, inclusive, the value doesn't exceed; None: no bound."""
    out = F.lit(None).cast("string")
    for label, top in reversed(steps):
        out = F.lit(label) if top is None else F.when(value <= top, label).otherwise(out)
    return F.when(value.isNull(), F.lit(None)).otherwise(out)
