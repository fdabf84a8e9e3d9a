"""Event histories as versioned assignments: audit and daily streams, as-of status, spells, compositions.

Order within an entity is always the tuple (day, sequences, id); a day alone names no version. Only consecutive
equality is suppressed: A, B, A stay three versions. All windows share the partitioning by (dimension, entity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.canon import OPEN_END
from chronoloom.functions.intervals import ladder, visible_on

KEYS = ["dimension", "entity"]


def _order(columns: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def audit(events: DataFrame, order: list[str]) -> DataFrame:
    """Events (dimension, entity, day, value, order...) that change the value, each with its ordinal; first ones included."""
    w = Window.partitionBy(*KEYS).orderBy("day", *_order(order))
    before = events.withColumn("nth", F.row_number().over(w)).withColumn("previous", F.lag("value").over(w))
    changed = before.where((F.col("nth") == 1) | ~F.col("value").eqNullSafe(F.col("previous"))).drop("nth")
    return changed.withColumn("ordinal", F.row_number().over(w))


def daily(events: DataFrame, order: list[str], existence_to: str | None = None) -> DataFrame:
    """Versions (dimension, entity, valid_from, valid_to, value): the last event of a day owns it, equal neighbours are one."""
    w = Window.partitionBy(*KEYS).orderBy("day", *_order(order))
    last = events.withColumn("next_day", F.lead("day").over(w)).where(F.col("next_day").isNull() | (F.col("next_day") != F.col("day"))).drop("next_day")
    days = Window.partitionBy(*KEYS).orderBy("day")
    kept = last.withColumn("nth", F.row_number().over(days)).withColumn("previous", F.lag("value").over(days)).where((F.col("nth") == 1) | ~F.col("value").eqNullSafe(F.col("previous")))
    open_end = F.lit(OPEN_END).cast("date")
    end = F.coalesce(F.lead("day").over(days), open_end)
    if existence_to:
        end = F.least(end, F.coalesce(F.col(existence_to), open_end))
    return kept.select(*KEYS, F.col("day").alias("valid_from"), end.alias("valid_to"), "value").where("valid_from < valid_to")


def as_of_status(versions: DataFrame, existence: DataFrame, dimensions: list[str], days: list[str]) -> DataFrame:
    """(entity, dimension, as_of, status, value) for every entity, dimension and day asked for.

    OUTSIDE_EXISTENCE goes before NO_RECORDED_STATE (no version covers the day), UNKNOWN_STATE (its value is null), OK.
    existence: (entity, existence_from, existence_to). Dimensions and days are literals of the question.
    """
    asked = existence.withColumn("dimension", F.explode(F.array(*[F.lit(x) for x in dimensions]))).withColumn("as_of", F.explode(F.array(*[F.lit(d).cast("date") for d in days])))
    v = versions.select("entity", "dimension", "valid_from", "valid_to", "value", F.lit(True).alias("covered"))
    hit = asked.join(v, (asked.entity == v.entity) & (asked.dimension == v.dimension) & visible_on(v.valid_from, v.valid_to, asked.as_of), "left").select(asked.entity, asked.dimension, "as_of", "existence_from", "existence_to", "covered", "value")
    status = F.when(~visible_on(F.col("existence_from"), F.col("existence_to"), F.col("as_of")) | F.col("existence_from").isNull(), "OUTSIDE_EXISTENCE").when(F.col("covered").isNull(), "NO_RECORDED_STATE").when(F.col("value").isNull(), "UNKNOWN_STATE").otherwise("OK")
    return hit.select("entity", "dimension", "as_of", status.alias("status"), F.when(status == "OK", F.col("value")).alias("value"))


def reversion_spells(changes: DataFrame, order: list[str], home: str, away: list[str]) -> DataFrame:
    """(dimension, entity, start_day, end_day, days, same_day, state): home, then one of away, then home again at once."""
    w = Window.partitionBy(*KEYS).orderBy("day", *_order(order))
    near = changes.select("*", F.lag("value").over(w).alias("was"), F.lead("value").over(w).alias("then"), F.lead("day").over(w).alias("end_day"))
    spells = near.where((F.col("was") == home) & F.col("value").isin(away) & (F.col("then") == home))
    return spells.select(*KEYS, F.col("day").alias("start_day"), "end_day", F.datediff("end_day", "day").alias("days"), (F.col("end_day") == F.col("day")).alias("same_day"), F.col("value").alias("state"))


def distribution(values: DataFrame, column: str, steps: list[tuple[str, int | None]]) -> DataFrame:
    """(bucket_order, bucket, n, share): counts per step of a ladder, empty steps kept."""
    spark = values.sparkSession
    labels = spark.createDataFrame([(i, s[0]) for i, s in enumerate(steps)], "bucket_order int, bucket string")
    counts = values.groupBy(ladder(F.col(column), steps).alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    joined = labels.join(F.broadcast(counts), "bucket", "left").crossJoin(F.broadcast(total))
    return joined.select("bucket_order", "bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(F.coalesce("n", F.lit(0).cast("long")) / F.col("total"), 6).alias("share"))


def month_ends(start: str, end: str) -> Column:
    """Month ends from the month of start to that of end, as an array."""
    return F.transform(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month")), F.last_day)


def on_month_ends(versions: DataFrame, start: str, end: str) -> DataFrame:
    """versions with one row for each month end they cover: intervals are expanded, so joins on the day are equi-joins."""
    inside = F.filter(month_ends(start, end), lambda m: visible_on(F.col("valid_from"), F.col("valid_to"), m))
    return versions.withColumn("month_end", F.explode(inside)).drop("valid_from", "valid_to")


def composition(versions: DataFrame, by: str, state: tuple[str, str], start: str, end: str) -> DataFrame:
    """(month_end, label, entities): entities whose dimension state[0] has the value state[1] at the month end, by their value of dimension `by`."""
    at = on_month_ends(versions, start, end)
    holds = at.where((F.col("dimension") == state[0]) & (F.col("value") == state[1])).select("entity", "month_end").distinct()
    return at.where(F.col("dimension") == by).join(holds, ["entity", "month_end"]).groupBy("month_end", F.col("value").alias("label")).agg(F.countDistinct("entity").alias("entities"))


def with_previous(versions: DataFrame, compared: list[str] | None = None) -> DataFrame:
    """Versions with the value before and whether it changed: false for the first, true where a known value was left, false where one appears after none; null in dimensions other than `compared`."""
    w = Window.partitionBy(*KEYS).orderBy("valid_from")
    v = versions.select("*", F.lag("value").over(w).alias("previous"))
    changed = F.when(F.col("previous").isNull(), False).otherwise(~F.col("value").eqNullSafe(F.col("previous")))
    return v.withColumn("is_change", changed if compared is None else F.when(F.col("dimension").isin(compared), changed))


def close_disagreements(versions: DataFrame, declared_to: str) -> DataFrame:
    """Versions whose declared end differs from the one derived from their successor; an integrity guard, empty where all is well."""
    w = Window.partitionBy(*KEYS).orderBy("valid_from")
    return versions.withColumn("derived_to", F.lead("valid_from").over(w)).where(F.col("derived_to").isNotNull() & ~F.col("derived_to").eqNullSafe(F.col(declared_to)))


def first_return(audited: DataFrame, state: str) -> DataFrame:
    """(dimension, entity, left_day, left_to, return_day, between): every time an entity leaves a state, with its first return to it, null if none, and how many versions lie between.

    audited: (dimension, entity, day, value, ordinal), as from `audit`.
    """
    w = Window.partitionBy("dimension", "entity").orderBy("ordinal")
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    back = F.when(F.col("value") == state, F.struct("ordinal", "day"))
    seen = audited.select("*", F.lag("value").over(w).alias("_was"), F.min(back).over(ahead).alias("_back"))
    left = seen.where((F.col("_was") == state) & ~F.coalesce(F.col("value") == state, F.lit(False)))
    return left.select("dimension", "entity", F.col("day").alias("left_day"), F.col("value").alias("left_to"), F.col("_back.day").alias("return_day"), (F.col("_back.ordinal") - F.col("ordinal")).alias("between"))
