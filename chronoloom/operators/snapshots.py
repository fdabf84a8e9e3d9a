"""Periodic full snapshots: the deliveries that count, one row per key and delivery, and what changed between them.

`eligible` numbers the deliveries a calendar calls present and complete. `canonical` takes the one row that counts per
key and delivery by an aggregate that combines before the shuffle, so a key repeated any number of times costs no
task more than its distinct deliveries.

`diff` takes every snapshot row with +1 into the comparison in which it is on the later side, and with -1 into the one
in which it is on the earlier side. A row that is the same on both sides cancels itself as a whole. What is left is
unpivoted into signed cells (key, field, value), with one marker field for the key's presence. Sums that are not zero
remain: of the marker, they tell added and removed keys; of the other fields, what changed. Rows are brought together
by key once; the cells made from them need no further shuffle.

Defined results: rows without key or date, and deliveries outside the calendar, never count; null equals null in every
field; rows equal in all ordering columns are settled by the remaining ones; the first delivery gives no change; empty
tables give empty results; columns not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(calendar: DataFrame, day: str, *flags: str) -> DataFrame:
    """(day, ord): deliveries for which all flags hold, numbered from 0. One row per delivery date, so it is small."""
    ok = calendar.where(" and ".join(f"`{f}`" for f in flags)).select(F.col(day).alias("day")).where("day is not null").distinct()
    days = ok.agg(F.array_sort(F.collect_set("day")).alias("days"))
    return days.select(F.posexplode("days").alias("ord", "day"))


def ranking(column: str, descending: bool = False) -> list[Column]:
    """Ordering columns for `canonical`, the least first, nulls last. Descending is for numbers."""
    c = F.col(column)
    return [c.isNull(), -c if descending else c]


def canonical(rows: DataFrame, deliveries: DataFrame, key: str, day: str, order: list[Column], fields: list[str]) -> DataFrame:
    """(key, ord, fields...): of each key and eligible delivery the row that comes first by `order`, then by fields."""
    at = rows.where(F.col(key).isNotNull() & F.col(day).isNotNull()).join(F.broadcast(deliveries.select(F.col("day").alias(day), F.col("ord").alias("_delivery"))), day)
    one = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*fields).alias("row"))
    return at.groupBy(F.col(key).alias("_key"), "_delivery").agg(F.min(one).alias("one")).select(F.col("_key").alias("key"), F.col("_delivery").alias("ord"), "one.row.*")


#: The field of the marker for a key's presence, in `field_changes`.
PRESENCE = "__presence__"


def _signed_cells(state: DataFrame, deliveries: int, fields: list[str]) -> DataFrame:
    """(key, at, sign, field, value): the cells of all rows that don't cancel; field -1 marks the key's presence."""
    cells = ", ".join(["-1, ''", *(f"{i}, cast(`{f}` as string)" for i, f in enumerate(fields))])
    w = Window.partitionBy("key").orderBy("ord")
    row = F.struct(*fields)
    again = state.withColumn("_same", (F.lag("ord").over(w) == F.col("ord") - 1) & row.eqNullSafe(F.lag(row).over(w)))
    stays = again.withColumn("_stays", F.coalesce((F.lead("ord").over(w) == F.col("ord") + 1) & F.lead("_same").over(w), F.lit(False)))
    later, earlier = (F.col("ord") > 0) & ~F.coalesce("_same", F.lit(False)), (F.col("ord") < deliveries - 1) & ~F.col("_stays")
    side = lambda on, at, sign: F.when(on, F.struct(at.cast("int").alias("at"), F.lit(sign).alias("sign")))
    sides = stays.withColumn("_side", F.explode(F.array(side(later, F.col("ord"), 1), side(earlier, F.col("ord") + 1, -1)))).where("_side is not null").select("key", "_side.at", "_side.sign", *[f"`{f}`" for f in fields])
    return sides.selectExpr("key", "at", "sign", f"stack({len(fields) + 1}, {cells}) as (field, value)")


def diff(state: DataFrame, deliveries: int, fields: list[str], report_fields: bool = False) -> DataFrame:
    """Changes from each delivery to the next: (ord, key, change_type), with report_fields also (changed).

    state: (key, ord, fields...) as from `canonical`; deliveries: how many there are; ord: of the later delivery.
    """
    signed = _signed_cells(state, deliveries, fields)
    open_cells = signed.groupBy("key", "at", "field", "value").agg(F.sum("sign").alias("sum")).where("sum <> 0")
    presence = F.sum(F.when(F.col("field") == -1, F.col("sum")).otherwise(0))
    names = F.array(*[F.lit(f) for f in fields])
    changed = F.transform(F.array_sort(F.collect_set(F.when((F.col("field") >= 0), F.col("field")))), lambda i: F.get(names, i))
    kinds = open_cells.groupBy("key", "at").agg(presence.alias("presence"), *([changed.alias("changed")] if report_fields else []))
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return kinds.select(F.col("at").alias("ord"), "key", kind.alias("change_type"), *([F.when(F.col("presence") == 0, F.col("changed")).otherwise(F.array().cast("array<string>")).alias("changed")] if report_fields else []))


def field_changes(state: DataFrame, deliveries: int, fields: list[str]) -> DataFrame:
    """(ord, key, change_type, field, old_value, new_value, reappears): one row for each field of a changed key, as text.

    An added or removed key has one row, for the field PRESENCE, with values ABSENT and PRESENT; reappears tells whether
    an added key had been there in an earlier delivery.
    """
    signed = _signed_cells(state, deliveries, fields)
    side = lambda sign: F.max(F.when(F.col("sign") == sign, F.struct("value"))).alias("new" if sign > 0 else "old")
    cells = signed.groupBy("key", "at", "field").agg(side(1), side(-1))
    w = Window.partitionBy("key", "at")
    marked = cells.withColumn("sides", F.max(F.when(F.col("field") == -1, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed"))).over(w))
    kept = marked.where(((F.col("field") == -1) & (F.col("sides") != "changed")) | ((F.col("sides") == "changed") & (F.col("field") >= 0) & ~F.col("new.value").eqNullSafe(F.col("old.value"))))
    first = state.groupBy("key").agg(F.min("ord").alias("_first"))
    names = F.array(*[F.lit(f) for f in fields])
    marker = F.col("field") == -1
    text = lambda c: F.when(marker, F.when(F.col(c).isNull(), "ABSENT").otherwise("PRESENT")).otherwise(F.col(f"{c}.value"))
    out = kept.join(first, "key").select(F.col("at").alias("ord"), "key", F.col("sides").alias("change_type"), F.when(marker, F.lit(PRESENCE)).otherwise(F.get(names, F.col("field"))).alias("field"), text("old").alias("old_value"), text("new").alias("new_value"), ((F.col("sides") == "added") & (F.col("_first") < F.col("at"))).alias("reappears"))
    return out
