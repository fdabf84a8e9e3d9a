"""History of changing entity attributes, from an event-sourced log of changes per attribute.

`change_log` compares each observation of a key with the one before and emits one event per attribute that changed;
an attribute that kept its value emits nothing, so the log is as long as what happened, not as what was delivered. An
absence emits one event that closes all attributes. `attribute_intervals` closes each attribute's events on its own.
`versions` splits a key's time at the union of all boundaries of its attributes, and coalesces neighbouring pieces
that hold the same values.

All steps partition by the key alone, so one shuffle serves them all; a key has at most one observation per delivery.

Defined results: null equals null; A, B, A are three versions; a gap in consecutive deliveries ends a version even if
the same values return; the last version is open (null end); no attributes or no rows give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_log(state: DataFrame, deliveries: int, attributes: list[str], values: bool = True) -> DataFrame:
    """(key, ord, attribute, closes, value): events of each attribute; closes: the key is absent from ord on (attribute -1).

    state: (key, ord, attributes...), one row per key and delivery in which the key is present. values: carry the values, as text.
    """
    w = Window.partitionBy("key").orderBy("ord")
    now = F.struct(*attributes)
    seen = state.select("key", "ord", now.alias("now"), F.lag("ord").over(w).alias("prev_ord"), F.lag(now).over(w).alias("prev"), F.lead("ord").over(w).alias("next_ord"))
    fresh = F.col("prev_ord").isNull() | (F.col("prev_ord") != F.col("ord") - 1)
    value = lambda a: F.col(f"now.{a}").cast("string") if values else F.lit(None).cast("string")
    sets = [F.when(fresh | ~F.col(f"now.{a}").eqNullSafe(F.col(f"prev.{a}")), F.struct(F.lit(i).alias("attribute"), F.col("ord").alias("at"), F.lit(False).alias("closes"), value(a).alias("value"))) for i, a in enumerate(attributes)]
    leaves = (F.col("next_ord").isNull() & (F.col("ord") < deliveries - 1)) | (F.col("next_ord") != F.col("ord") + 1)
    clear = F.when(leaves, F.struct(F.lit(-1).alias("attribute"), (F.col("ord") + 1).alias("at"), F.lit(True).alias("closes"), F.lit(None).cast("string").alias("value")))
    return seen.select("key", F.explode(F.array_compact(F.array(*sets, clear))).alias("e")).select("key", F.col("e.at").alias("ord"), "e.attribute", "e.closes", "e.value")


def attribute_intervals(log: DataFrame, attributes: int) -> DataFrame:
    """(key, attribute, from_ord, to_ord, value): each attribute with its own intervals, to_ord null while open."""
    every = F.when(F.col("closes"), F.sequence(F.lit(0), F.lit(attributes - 1))).otherwise(F.array("attribute"))
    events = log.select("key", "ord", "closes", "value", F.explode(every).alias("attribute"))
    ends = F.lead("ord").over(Window.partitionBy("key", "attribute").orderBy("ord"))
    return events.select("key", "attribute", F.col("ord").alias("from_ord"), ends.alias("to_ord"), "value", "closes").where("not closes").drop("closes")


def boundaries(log: DataFrame) -> DataFrame:
    """(key, from_ord, to_ord): the pieces between the union of all attributes' boundaries in which the key is present."""
    points = log.groupBy("key", "ord").agg(F.bool_and("closes").alias("closes"))
    ends = F.lead("ord").over(Window.partitionBy("key").orderBy("ord"))
    return points.select("key", F.col("ord").alias("from_ord"), ends.alias("to_ord"), "closes").where("not closes").drop("closes")


def versions(log: DataFrame, attributes: list[str]) -> DataFrame:
    """(key, from_ord, to_ord, attributes...): the attributes' logs combined, as text, neighbours of equal values as one."""
    w = Window.partitionBy("key").orderBy("ord")
    points = log.groupBy("key", "ord").agg(F.bool_and("closes").alias("closes"), F.collect_list(F.when(~F.col("closes"), F.struct("attribute", "value"))).alias("sets"))
    held_now = points.select("key", "ord", "closes", F.map_from_entries("sets").alias("sets"))
    at = held_now.select("key", "ord", "closes", *[F.when(F.map_contains_key("sets", F.lit(i)), F.struct(F.col("sets")[F.lit(i)].alias("value"))).alias(f"s{i}") for i in range(len(attributes))])
    spell = at.select("*", F.sum(F.col("closes").cast("int")).over(w).alias("spell"), F.lead("ord").over(w).alias("to_ord"))
    carry = Window.partitionBy("key", "spell").orderBy("ord")
    held = spell.select("key", "ord", "to_ord", "closes", "spell", F.struct(*[F.last(f"s{i}", ignorenulls=True).over(carry)["value"].alias(a) for i, a in enumerate(attributes)]).alias("v"))
    flagged = held.where("not closes").select("*", (F.row_number().over(carry) == 1).alias("first"), F.lag("v").over(carry).alias("before"))
    marked = flagged.withColumn("run", F.sum(F.when(F.col("first") | ~F.col("v").eqNullSafe(F.col("before")), 1).otherwise(0)).over(carry))
    ends = F.when(F.max(F.col("to_ord").isNull()), F.lit(None)).otherwise(F.max("to_ord"))
    return marked.groupBy("key", "spell", "run").agg(F.min("ord").alias("from_ord"), ends.alias("to_ord"), F.first("v").alias("v")).select("key", "from_ord", "to_ord", "v.*")
