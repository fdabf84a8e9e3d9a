"""Canonical text, framed tokens and digests of rows, as plain Column builders that Catalyst sees through.

A token frames a value by its length in bytes, so that no two different rows give the same text. Null has a frame of
its own and is never taken for an empty text, a zero or false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The source's date for an unknown future, and the date that closes no interval. They are never the same.
UNKNOWN_FUTURE, OPEN_END = "9999-12-31", "9999-01-01"


def framed(text: Column) -> Column:
    """`bytes:text`."""
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def canonical(value: Column, kind: T.DataType) -> Column:
    """One text for each value: ISO dates and times, doubles with at least one decimal, true and false; null stays null."""
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e16)
        return F.when(whole, F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))
    return value.cast("string")


def display_number(value: Column) -> Column:
    """A double without a needless fraction."""
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def token(name: str, value: Column, kind: T.DataType) -> Column:
    """A field's name and value as one framed text."""
    text = canonical(value, kind)
    return F.concat(framed(F.lit(name)), F.when(text.isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), framed(F.coalesce(text, F.lit(""))))))


def row_digest(schema: T.StructType, *names: str) -> Column:
    """SHA-256, in lower-case hex, of the named fields in the order given."""
    kinds = {f.name: f.dataType for f in schema}
    return F.sha2(F.concat(*[token(n, F.col(n), kinds[n]) for n in names]), 256)


def source_date(c: Column) -> Column:
    """A source date, null where it stands for an unknown future."""
    return F.nullif(c, F.lit(UNKNOWN_FUTURE).cast("date"))


def flag(c: Column) -> Column:
    """A flag coded 0 and 1 as a boolean; anything else is unknown."""
    return F.when(c == 0, False).when(c == 1, True)
