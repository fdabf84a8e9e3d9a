"""States of keys over a snapshot stream: opening and closing kinds, lineage, comparisons, amendments, markets, capacity.

Ordinals number the eligible deliveries, so a gap is a gap between deliveries that count and never one of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.intervals import on_weekday, operates_within, overlap, visible_on


def _runs(obs: DataFrame, content: list[str]) -> DataFrame:
    w = Window.partitionBy("key").orderBy("ord")
    now = F.struct(*content)
    seen = obs.select("*", F.lag("ord").over(w).alias("_was"), F.lag(now).over(w).alias("_before"))
    opens = F.when(F.col("_was").isNull(), "INITIAL").when(F.col("_was") != F.col("ord") - 1, "REAPPEARANCE").when(~now.eqNullSafe(F.col("_before")), "CONTENT_CHANGE")
    marked = seen.withColumn("open_kind", opens)
    # The ordinal of the latest opening carries forward to all observations of the state.
    return marked.withColumn("open_ord", F.max(F.when(F.col("open_kind").isNotNull(), F.col("ord"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_was", "_before")


def states(obs: DataFrame, content: list[str], deliveries: int) -> DataFrame:
    """(key, open_ord, close_ord, open_kind, close_kind, seen, content...); close_ord is the first delivery after the state, null while open."""
    runs = _runs(obs, content).groupBy("key", "open_ord").agg(F.max("ord").alias("last"), F.count("*").alias("seen"), F.max("open_kind").alias("open_kind"), F.min_by(F.struct(*content), "ord").alias("c"))
    nxt = F.lead("open_ord").over(Window.partitionBy("key").orderBy("open_ord"))
    closed = runs.withColumn("next_open", nxt)
    kind = F.when(F.col("next_open") == F.col("last") + 1, "CONTENT_CHANGE").when(F.col("last") < deliveries - 1, "ABSENCE").otherwise("OPEN")
    return closed.select("key", "open_ord", F.when(F.col("last") < deliveries - 1, F.col("last") + 1).alias("close_ord"), "open_kind", kind.alias("close_kind"), "seen", "c.*")


def lineage(obs: DataFrame, content: list[str], row_hash: str) -> DataFrame:
    """(key, open_ord, ord, row_hash): every observation that supports a state."""
    return _runs(obs, content).select("key", "open_ord", "ord", row_hash)


def comparisons(deliveries: DataFrame, expected: DataFrame) -> DataFrame:
    """(ord, earlier, later, days, skipped): consecutive eligible deliveries and the expected dates between that don't count."""
    pairs = deliveries.select((F.col("ord") + 1).alias("ord"), F.col("day").alias("earlier")).join(deliveries.withColumnRenamed("day", "later"), "ord")
    between = pairs.join(F.broadcast(expected), (F.col("expected") > F.col("earlier")) & (F.col("expected") < F.col("later")), "left")
    return between.groupBy("ord", "earlier", "later").agg(F.count("expected").alias("skipped")).withColumn("days", F.datediff("later", "earlier"))


def amendment_sides(changes: DataFrame, obs: DataFrame, signature: list[str], first: str, last: str) -> DataFrame:
    """Removed and added keys (ord, key, side, signature..., first, last) with the row that lost or got them."""
    at = changes.where("change_type <> 'changed'").select("ord", "key", F.col("change_type").alias("side"), (F.col("ord") - F.when(F.col("change_type") == "removed", 1).otherwise(0)).alias("seen"))
    return at.join(obs.select("key", F.col("ord").alias("seen"), *signature, F.col(first).alias("first"), F.col(last).alias("last")), ["key", "seen"]).drop("seen")


def presence_sides(obs: DataFrame, deliveries: int, signature: list[str], first: str, last: str) -> DataFrame:
    """Like amendment_sides, from the observations in one pass: keys that come (added) or are gone after their last row (removed)."""
    w = Window.partitionBy("key").orderBy("ord")
    near = obs.select("key", "ord", *signature, F.col(first).alias("first"), F.col(last).alias("last"), F.lag("ord").over(w).alias("_was"), F.lead("ord").over(w).alias("_next"))
    side = lambda on, at, name: F.when(on, F.struct(at.cast("int").alias("ord"), F.lit(name).alias("side")))
    came = (F.col("ord") > 0) & (F.col("_was").isNull() | (F.col("_was") < F.col("ord") - 1))
    gone = (F.col("ord") < deliveries - 1) & (F.col("_next").isNull() | (F.col("_next") > F.col("ord") + 1))
    sides = near.withColumn("_s", F.explode(F.array(side(came, F.col("ord"), "added"), side(gone, F.col("ord") + 1, "removed")))).where("_s is not null")
    return sides.select("_s.ord", "key", "_s.side", *signature, "first", "last")


def amendments(sides: DataFrame, signature: list[str]) -> DataFrame:
    """(ord, removed_key, added_key, partners_removed, partners_added): pairs of the same signature whose periods overlap.

    Pairs in which both sides have one partner are candidates, all others are ambiguous. A signature
    holds a carrier's route, and only keys removed or added in one comparison are paired, so the pairs stay few.
    """
    known = sides.dropna(subset=[*signature, "first", "last"])
    gone = known.where("side = 'removed'").select("ord", *signature, F.col("key").alias("removed_key"), F.col("first").alias("f1"), F.col("last").alias("l1"))
    new = known.where("side = 'added'").select("ord", *signature, F.col("key").alias("added_key"), F.col("first").alias("f2"), F.col("last").alias("l2"))
    pairs = gone.join(new, ["ord", *signature]).where(overlap(F.col("f1"), F.col("l1"), F.col("f2"), F.col("l2"))).select("ord", *signature, "removed_key", "added_key")
    partners = lambda c: F.count("*").over(Window.partitionBy("ord", c))
    return pairs.select("*", partners("removed_key").alias("partners_removed"), partners("added_key").alias("partners_added"))


def ambiguous_groups(pairs: DataFrame, signature: list[str]) -> DataFrame:
    """(ord, signature..., members, removed, added): pairs that are not one to one, grouped by signature with their keys listed."""
    doubtful = pairs.where("partners_removed > 1 or partners_added > 1")
    keys = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return doubtful.groupBy("ord", *signature).agg((F.countDistinct("removed_key") + F.countDistinct("added_key")).alias("members"), keys("removed_key").alias("removed"), keys("added_key").alias("added"))


def ambiguous_members(pairs: DataFrame, signature: list[str]) -> DataFrame:
    """(group_id, ord, signature..., side, key): the keys of pairs that are not one to one, one row each; a group is a signature in a delivery."""
    doubtful = pairs.where("partners_removed > 1 or partners_added > 1")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_key").alias("key")) for s in ("removed", "added")])
    group = F.sha2(F.concat_ws("|", F.col("ord").cast("string"), *signature), 256)
    return doubtful.select(group.alias("group_id"), "ord", *signature, F.explode(sides).alias("m")).select("group_id", "ord", *signature, "m.side", "m.key").distinct()


def unpaired(sides: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sides that take part in no pair."""
    taken = pairs.select("ord", F.col("removed_key").alias("key")).unionByName(pairs.select("ord", F.col("added_key").alias("key")))
    return sides.join(taken, ["ord", "key"], "left_anti")


def entries_and_exits(obs: DataFrame, market: list[str], earlier: int, later: int) -> DataFrame:
    """(market..., kind, keys): markets present at one of two deliveries alone, by conditional aggregation instead of two anti joins."""
    at = obs.where(F.col("ord").isin(earlier, later)).dropna(subset=market)
    n = lambda o: F.countDistinct(F.when(F.col("ord") == o, F.col("key")))
    both = at.groupBy(*market).agg(n(earlier).alias("before"), n(later).alias("after")).where("(before = 0) <> (after = 0)")
    return both.select(*market, F.when(F.col("before") == 0, "ENTRY").otherwise("EXIT").alias("kind"), (F.col("before") + F.col("after")).alias("keys"))


def consecutive_entries_and_exits(obs: DataFrame, market: list[str], deliveries: int) -> DataFrame:
    """(ord, market..., kind, keys): markets present at a delivery but not at the one before (ENTRY), or the other way round (EXIT), for all deliveries after the first."""
    w = Window.partitionBy(*market).orderBy("ord")
    per = obs.dropna(subset=market).groupBy(*market, "ord").agg(F.countDistinct("key").alias("keys")).select("*", F.lag("ord").over(w).alias("before"), F.lead("ord").over(w).alias("after"))
    entry = F.when((F.col("ord") > 0) & (F.col("before").isNull() | (F.col("before") < F.col("ord") - 1)), F.struct("ord", F.lit("ENTRY").alias("kind")))
    leaves = F.when((F.col("ord") < deliveries - 1) & (F.col("after").isNull() | (F.col("after") > F.col("ord") + 1)), F.struct((F.col("ord") + 1).alias("ord"), F.lit("EXIT").alias("kind")))
    return per.select(*market, "keys", F.explode(F.array_compact(F.array(entry, leaves))).alias("e")).select("e.ord", *market, "e.kind", "keys")


def capacity(dated: DataFrame, knowledge: str, operating: str, by: list[str], weekdays: list[str], frequency: str, seats: str, first: str, last: str) -> DataFrame:
    """(by..., schedules, weekly_frequency, weekly_seats, all_seats_known): what is known on one day to operate on another.

    The knowledge interval (valid_from, valid_to) is half-open, the operating period includes both ends.
    """
    k, o = F.lit(knowledge).cast("date"), F.lit(operating).cast("date")
    live = dated.where(visible_on(F.col("valid_from"), F.col("valid_to"), k) & operates_within(F.col(first), F.col(last), o) & on_weekday(o, weekdays))
    return live.groupBy(*by).agg(F.count("*").alias("schedules"), F.sum(frequency).alias("weekly_frequency"), F.sum(F.when(F.col(seats).isNotNull(), F.col(frequency) * F.col(seats)).otherwise(0.0)).alias("weekly_seats"), F.bool_and(F.col(seats).isNotNull()).alias("all_seats_known"))


def both_clocks(start: Column, end: Column, first: Column, last: Column) -> dict[str, tuple[Column, Column]]:
    """Days before, in and at the end of a knowledge interval and of an operating period."""
    return {
        "knowledge": F.array(F.struct(F.lit("BEFORE").alias("at"), F.date_sub(start, 1).alias("day")), F.struct(F.lit("INSIDE").alias("at"), start.alias("day")), F.struct(F.lit("AT_END").alias("at"), end.alias("day"))),
        "operating": F.array(F.struct(F.lit("BEFORE").alias("at"), F.date_sub(first, 1).alias("day")), F.struct(F.lit("INSIDE").alias("at"), first.alias("day")), F.struct(F.lit("AT_END").alias("at"), last.alias("day"))),
    }


def part_facts(total: str, parts: list[str], included: str, within: str) -> list[Column]:
    """How parts relate to their total and one part to the one that includes it, as facts that are null where a value is."""
    every = [F.col(c) for c in (total, *parts, included)]
    known, least, summed = F.lit(True), F.least(*every), F.lit(0.0)
    for c in every:
        known = known & c.isNotNull()
    for c in parts:
        summed = summed + F.col(c)
    return [known.alias("all_known"), (least >= 0).alias("none_negative"), (summed == F.col(total)).alias("adds_up"), (F.col(included) <= F.col(within)).alias("included_fits")]


def gap_flags(states: DataFrame, comparisons: DataFrame) -> DataFrame:
    """(key, open_ord, opens_after_gap, closes_after_gap): whether expected deliveries that don't count lie just before a state's opening or closing, so that its boundary is only known to lie between."""
    gap = F.broadcast(comparisons.select(F.col("ord").alias("_o"), (F.col("skipped") > 0).alias("_gap")))  # one row a delivery
    at = lambda df, c, out: df.join(gap, F.col(c) == F.col("_o"), "left").withColumn(out, F.coalesce("_gap", F.lit(False))).drop("_o", "_gap")
    return at(at(states, "open_ord", "opens_after_gap"), "close_ord", "closes_after_gap").select("key", "open_ord", "opens_after_gap", "closes_after_gap")


def top(rows: DataFrame, by: str, limit: int, *ties: str) -> DataFrame:
    """The `limit` greatest rows with their rank from 1, ties settled by further columns; never a sort of all rows."""
    order = [F.col(by).desc(), *[F.col(c).asc_nulls_last() for c in ties]]
    few = rows.orderBy(*order).limit(limit)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
