"""Entity matching without a common key: collective graph linkage.

Records of two sources are nodes of a bipartite candidate graph. Edges come from blocking keys that join several
attributes, so an edge needs a rare combination in common, and every edge is weighted by the information of what its
ends share: a shared value counts -ln of its measured frequency, a contradiction costs a fixed penalty, a missing value
nothing. Meta-blocking prunes edges that are much weaker than the best edge of either end, where what a record doesn't
say isn't held against it. Then neighbours vote: an edge gains from the share of the other parts of the same service
that are linked (a service with stops consists of several legs), and pruning and voting repeat until the set of
accepted edges is stable.

This module holds the general graph part (`refine`) and the linkage of flown legs with published plan rows. There all
attributes are numbers before the first shuffle: codes and stations are hashed to 64 bits, days and times counted. One
join on a single hashed key carries all ways of meeting, so each side is shuffled once for all of them; rows that lack
one of the attributes meet by what is left, against the other side as a whole, where only they are broadcast if their
counted number is small.

Defined results: records without id are never linked; missing attributes neither support nor contradict; repeated
rows count once, and repeated flights that say less are completed by each other; ties are all kept (a service published
twice is linked twice); empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.packed import packed_values
from chronoloom.session import BROADCAST_ROWS, cut, small, stored

#: ln odds lost by a contradiction in each attribute, by a number that differs, and gained by the other legs' links.
CARRIER_CONFLICT, ARRIVAL_CONFLICT, DIVERTED, TIME_CONFLICT, DATE_CONFLICT, NUMBER_CONFLICT, SUPPORT = 6.0, 12.0, 1.5, 6.0, 6.0, 6.0, 5.0
#: Least weight of a link, and how much weaker than the best edge of either end a link may be.
ACCEPT, SLACK = 17.0, 4.5
#: From this weight on a pair that agrees in number, day and both stations settles its flight and its planned leg.
STRONG = ACCEPT + SLACK
#: ln odds of a flight that is three to fifteen hours late: such delays are rare, but other services of the day are rarer still.
LATE = 2.7
#: What a shared carrier or station counts that is too rare to be in the statistics, a near time, and a mistyped number.
UNSEEN, NEAR_TIME, MISTYPED = 5.0, 4.0, 3.0
#: Hours by which local time may differ from UTC at most.
FAR_ZONE = 14
#: Days in a block of the blocking keys; a planned leg is entered in the blocks of the day before and after, too.
SPAN = 8
#: How many values numbers (up to four digits) and days (a year) can take. Frequencies are smoothed as if so many rows,
#: spread evenly over these, had been counted, too; it matters only where few rows are.
NUMBERS, DAYS, EVENLY = 9999, 366, 3000


def refine(edges: DataFrame, left: str, right: str, part: str, parts: str, weight: str, credit: str | None = None, accept: float = ACCEPT, slack: float = SLACK, support: float = SUPPORT) -> DataFrame:
    """Edges (left, right, part, parts, weight) that are accepted, with their confidence; repeated edges count once.

    right is a record made of `parts` parts; part numbers the one that the edge belongs to. credit is what an edge could
    have weighed more if its right record had said all; it counts when the edge is compared with others of its left
    record, never for acceptance. Edges are pruned at either end first. Only those of left records that touch a record
    of several parts can change after that, so only they are voted on, until a round prunes none. A round takes the
    votes of each record at once to where they lead (`votes`), so scores depend on the edges alone. Pruned edges never
    return, so scores never rise again and each round but the last has fewer edges: this ends by itself.
    """
    by_l, by_p, by_r = Window.partitionBy("l"), Window.partitionBy("r", "part"), Window.partitionBy("r")
    score = F.col("score")
    extra = F.col(credit) if credit else F.lit(0.0)
    e = edges.select(F.col(left).alias("l"), F.col(right).alias("r"), F.col(part).cast("short").alias("part"), F.col(parts).cast("short").alias("parts"), F.col(weight).cast("float").alias("w"), extra.cast("float").alias("credit"))
    e = e.repartition("l").groupBy("l", "r", "part", "parts").agg(F.max("w").alias("w"), F.min("credit").alias("credit")).withColumn("score", F.col("w"))
    e = e.withColumn("top", F.max("score").over(by_l)).withColumn("votes", F.max(F.col("parts") > 1).over(by_l)).where(score + F.col("credit") >= F.col("top") - slack)
    # All edges of a part get the same votes, so the later rounds needn't compare them with each other again.
    e = e.repartition("r").withColumn("top", F.max("score").over(by_p)).where(score >= F.col("top") - slack).drop("top")
    e = stored(e)
    settled, open_edges = e.where("not votes and parts = 1"), e.where("votes or parts > 1").drop("votes")
    left_over, seen = open_edges.count(), None
    while left_over != seen:
        best = open_edges.repartition("r").withColumn("best", F.max("w").over(by_p)).withColumn("bests", F.collect_set(F.struct("best", "part")).over(by_r))
        voted = best.withColumn("score", _voted(F.col("w"), votes("bests", "best", accept, support), support)).drop("best", "bests")
        open_edges = stored(voted.withColumn("top", F.max("score").over(by_l)).where(score + F.col("credit") >= F.col("top") - slack).drop("top"))
        left_over, seen = open_edges.count(), left_over
    kept = settled.drop("votes").unionByName(open_edges).where(score >= accept)
    confidence = F.round(1 / (1 + F.exp((accept - score) / 3)), 4)
    return kept.select(F.col("l").alias(left), F.col("r").alias(right), F.col("part").cast("int").alias(part), confidence.alias("confidence"))


def _voted(weight: Column, linked: Column, support: float) -> Column:
    """The score of an edge of which so many other parts are linked."""
    return (weight + support * linked / F.greatest(F.col("parts") - 1, F.lit(1))).cast("float")


def votes(bests: str, best: str, accept: float, support: float) -> Column:
    """How many other parts of a record are linked; bests: (best, part), the best weights of all its parts.

    Linked are the parts that are accepted by themselves, those that these carry over the threshold, and so on: the
    least fixed point. The part of the greatest weight is always the next to pass, so one look at the parts in order is
    enough. Voting in steps, in which all parts answer the state before, could alternate between two states forever.
    """
    ordered = F.transform(F.sort_array(F.col(bests), asc=False), lambda x: x["best"])
    linked = F.aggregate(ordered, F.lit(0), lambda n, w: F.when(_voted(w, n, support) >= accept, n + 1).otherwise(n))
    return linked - (_voted(F.col(best), F.greatest(linked - 1, F.lit(0)), support) >= accept).cast("int")


def flight_number(column: str) -> Column:
    """A flight number as written in the flight table, without carrier code, word, suffix and leading zeros."""
    t = F.upper(F.trim(F.col(column)))
    # A two-character carrier code has exactly one digit; glued to a number it is told apart by its letter.
    bare = F.regexp_replace(t, r"^(FLT|FLIGHT)[\s.#-]*", "")
    bare = F.regexp_replace(bare, r"^([A-Z][0-9]|[0-9][A-Z]|[A-Z]{2,3})[\s/-]*(?=[0-9])", "")
    plain = F.length(t).between(1, 7) & (F.translate(t, "0123456789", "") == "")
    return F.when(plain, t.try_cast("long")).otherwise(F.regexp_extract(bare, r"^0*([0-9]{1,7})[\s/-]*[A-Z]?$", 1).try_cast("long"))


def code(column: Column) -> Column:
    """A code's number; null stays null."""
    return F.when(column.isNotNull(), F.xxhash64(column))


def _clean(column: str | Column) -> Column:
    return F.nullif(F.upper(F.trim(column)), F.lit(""))


def codes_to_ids(reference: DataFrame, identity: str, codes: list[str]) -> DataFrame:
    """(code, ids): every code of a reference table, in whatever notation, with the numbers of the ids it may name."""
    pairs = reference.select(code(F.col(identity)).alias("id"), F.explode(F.array(identity, *codes)).alias("code")).where("code is not null and id is not null")
    return pairs.groupBy(code(F.upper(F.trim("code"))).alias("code")).agg(F.sort_array(F.collect_set("id")).alias("ids"))


def _minutes(day: Column, time: Column) -> Column:
    """Minutes since 1970 of a day, by its number, and a text HH:mm:ss, null if either is missing or unreadable."""
    hour, minute = F.substring(time, 1, 2).try_cast("int"), F.substring(time, 4, 2).try_cast("int")
    return F.when((F.substring(time, 3, 1) == ":") & hour.between(0, 29) & minute.between(0, 59), day * 1440 + hour * 60 + minute)


def _utc(here: Column, there: Column, offset: Column) -> Column:
    """UTC minutes of an event from its minutes by the local and the UTC clock on the local day: by the offset, else by both clocks, else null."""
    lead = F.pmod(here - there + FAR_ZONE * 60 - 120, F.lit(1440)) - (FAR_ZONE * 60 - 120)  # local minus UTC, from -12 h to +12 h
    return F.coalesce(here - offset.cast("int"), here - lead)


def planned_legs(plans: DataFrame, airlines: DataFrame) -> DataFrame:
    """Plan rows as legs between consecutive stations, repeated rows as they are: (pid, leg, legs, num, day, dep, arr, carriers, start, end, clock).

    airlines: as from `codes_to_ids`. start and end: UTC minutes of the service's departure and arrival; clock: minutes of
    the day in UTC at departure, where the day in UTC is unknown.
    """
    day = F.unix_date("operating_date")
    arrives = day + F.coalesce(F.col("arrival_day_indicator").cast("int"), F.lit(0))
    time = lambda at, c: _minutes(at, F.col(c))
    one = plans.where("historical_source_row_id is not null").select(
        F.col("historical_source_row_id").alias("pid"), F.col("flight_number").cast("long").alias("num"), day.alias("day"), _clean("departure_station_code_iata").alias("dep"), _clean("arrival_station_code_iata").alias("arr"),
        code(_clean("operating_carrier_internal")).alias("oc"), code(_clean("marketing_carrier_internal")).alias("mc"),
        time(day, "passenger_departure_local_time").alias("l_off"), time(day, "passenger_departure_utc_time").alias("u_off"), F.col("departure_utc_offset_minutes").alias("o_off"),
        time(arrives, "passenger_arrival_local_time").alias("l_on"), time(arrives, "passenger_arrival_utc_time").alias("u_on"), F.col("arrival_utc_offset_minutes").alias("o_on"),
        _minutes(F.lit(0), F.col("passenger_departure_utc_time")).alias("clock"), F.col("intermediate_stop_station_codes_iata").alias("packed"),
    )
    one = packed_values(one, "packed", "stops")
    for c in ("oc", "mc"):
        one = one.join(airlines.select(F.col("code").alias(c), F.col("ids").alias(f"{c}_ids")), c, "left")
    none = F.array().cast("array<bigint>")
    carriers = F.when(F.col("oc_ids").isNull() | F.col("mc_ids").isNull() | (F.col("oc") == F.col("mc")), F.coalesce("oc_ids", "mc_ids", none)).otherwise(F.array_union("oc_ids", "mc_ids"))
    rows = one.select("pid", "num", "day", _utc(F.col("l_off"), F.col("u_off"), F.col("o_off")).alias("start"), _utc(F.col("l_on"), F.col("u_on"), F.col("o_on")).alias("end"), "clock", carriers.alias("carriers"), "dep", "arr", F.coalesce("stops", F.array().cast("array<string>")).alias("stops"))
    legs = rows.withColumn("legs", F.size("stops") + 1).withColumn("leg", F.explode(F.sequence(F.lit(1), F.col("legs"))))
    first, last = F.col("leg") == 1, F.col("leg") == F.col("legs")
    return legs.select(
        "pid", "leg", "legs", "num", "day", code(F.when(first, F.col("dep")).otherwise(F.get("stops", F.col("leg") - 2))).alias("dep"), code(F.when(last, F.col("arr")).otherwise(F.get("stops", F.col("leg") - 1))).alias("arr"), "carriers",
        "start", "end", F.when(first & F.col("start").isNull(), F.col("clock")).alias("clock"),
    )


def flown_legs(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Flown legs, one row each: (fid, fnum, fday, fdep, farr, c1, c2, foff, fon, astray); of repeated rows the greatest of each attribute, as these may say less but nothing else."""
    # An id that versions give several codes gets the smallest, and a missing code the id itself.
    iata = small(airports.groupBy(F.col("airport_id").alias("a")).agg(F.min(F.upper(F.trim("airport_code_iata"))).alias("iata")), airports.count())
    minute = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 60).cast("int")
    # The date as given comes before that of the local time, and this before that in UTC.
    ranked = lambda rank, day: F.lit(rank * 10_000_000) + F.unix_date(day)
    date = F.coalesce(ranked(3, F.col("flight_departure_date")), ranked(2, F.col("actual_gate_departure_time_local").cast("date")), ranked(1, F.col("flight_departure_date_utc")))
    one = flights.where("flight_id is not null").select(
        F.col("flight_id").alias("fid"), flight_number("flight_number").alias("fnum"), date.alias("fday"), F.col("departure_airport_code").alias("da"), F.col("arrival_airport_code").alias("aa"),
        code(F.col("operating_carrier_code")).alias("c1"), code(F.col("marketing_carrier_code")).alias("c2"), minute("actual_gate_departure_time_utc").alias("foff"), minute("actual_gate_arrival_time_utc").alias("fon"),
        (F.coalesce(F.col("is_diverted") == 1, F.lit(False)) | F.col("diverted_airport_code").isNotNull()).alias("astray"),
    )
    at = lambda c: iata.select(F.col("a").alias(c), code(F.coalesce("iata", "a")).alias(f"{c}_code"))
    one = one.join(at("da"), "da", "left").join(at("aa"), "aa", "left").select("fid", "fnum", "fday", F.coalesce("da_code", code(F.col("da"))).alias("fdep"), F.coalesce("aa_code", code(F.col("aa"))).alias("farr"), "c1", "c2", "foff", "fon", "astray")
    merged = one.groupBy("fid").agg(*[F.max(c).alias(c) for c in one.columns[1:]])
    return merged.withColumn("fday", F.pmod(F.col("fday") + 5_000_000, F.lit(10_000_000)) - 5_000_000)


class Rarity:
    """How rare the values of the plans' attributes are: -ln of their measured frequency, from one pass over the plans."""

    KINDS = ("number", "day", "station", "carrier")

    def __init__(self, plans: DataFrame, airlines: DataFrame):
        cells = "0, cast(flight_number as bigint), 1, cast(unix_date(operating_date) as bigint), 2, d, 2, a, 3, o, 3, if(m = o, null, m)"
        rows = plans.where("historical_source_row_id is not null").select("flight_number", "operating_date", *[code(_clean(c)).alias(n) for n, c in zip("daom", ("departure_station_code_iata", "arrival_station_code_iata", "operating_carrier_internal", "marketing_carrier_internal"))])
        self.counts = cut(rows.selectExpr(f"stack(6, {cells}) as (kind, value)").where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n")))
        # One row a kind.
        found = {r.kind: (r.rows, r.total) for r in self.counts.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).collect()}
        self.size = {k: found.get(i, (0, 0)) for i, k in enumerate(self.KINDS)}
        self.airlines = airlines

    def of(self, kind: str, value: str, info: str, values: int = 0, least: float = 0.7) -> DataFrame:
        """(value, info), to be joined to the left of; broadcast where the counted number of values is small."""
        rows, total = self.size[kind]
        mine = self.counts.where(F.col("kind") == self.KINDS.index(kind)).select(F.col("value").alias("v"), "n")
        if kind == "carrier":  # counted by code, asked for by id
            mine = mine.join(self.airlines, F.col("v") == F.col("code")).select(F.explode("ids").alias("v"), "n").groupBy("v").agg(F.sum("n").alias("n"))
        share = (F.col("n") + (EVENLY / values if values else 0)) / F.lit(float(max(total, 1) + (EVENLY if values else 0)))
        return small(mine.select(F.col("v").alias(value), F.greatest(F.lit(least), -F.log(share)).cast("float").alias(info)), rows)


#: What a row's values count if shared, in hundredths, twelve bits each, as one number: rows are shuffled with it.
P_INFO, F_INFO = ("i_num", "i_day", "i_dep", "i_arr"), ("i_c1", "i_c2")


def _packed(rows: DataFrame, out: str, names: tuple[str, ...]) -> DataFrame:
    cell = lambda i, c: F.shiftleft(F.round(F.least(F.coalesce(c, F.lit(UNSEEN)), F.lit(40.0)) * 100).cast("bigint"), 12 * i)
    return rows.withColumn(out, sum((cell(i, c) for i, c in enumerate(names)), F.lit(0).cast("bigint"))).drop(*names)


def _info(name: str) -> Column:
    packed, names = ("p_info", P_INFO) if name in P_INFO else ("f_info", F_INFO)
    return F.shiftright(packed, 12 * names.index(name)).bitwiseAND(F.lit(4095)) / 100


def _weigh(pairs: DataFrame, numbers_equal: bool = False) -> DataFrame:
    """Candidate pairs with w, the information they share, and credit, what the plan doesn't say; only those that may be links, or all if their numbers are equal anyway."""
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    either_null = lambda a, b: F.col(a).isNull() | F.col(b).isNull()
    no_carrier = (F.size("carriers") == 0) | (F.col("c1").isNull() & F.col("c2").isNull())
    carrier = F.when(F.array_contains("carriers", F.col("c1")), _info("i_c1")).when(F.array_contains("carriers", F.col("c2")), _info("i_c2")).when(no_carrier, 0.0).otherwise(-CARRIER_CONFLICT)
    departure = F.when(same("dep", "fdep"), _info("i_dep")).otherwise(0.0)  # candidates have no other departure
    arrival = F.when(same("arr", "farr"), _info("i_arr")).when(either_null("arr", "farr"), 0.0).when(F.col("astray"), -DIVERTED).otherwise(-ARRIVAL_CONFLICT)
    first, last = F.col("leg") == 1, F.col("leg") == F.col("legs")
    begun, turn = F.col("foff") - F.col("start"), F.pmod(F.col("foff") - F.col("clock"), F.lit(1440))
    x = pairs.withColumns({"begun": begun, "days": F.col("fday") - F.col("day"), "d_off": F.when(first, F.abs(begun)), "d_on": F.when(last, F.abs(F.col("fon") - F.col("end"))), "turn": F.when(first, F.least(turn, 1440 - turn))})
    x = x.withColumn("near", F.least("d_off", F.when(F.col("turn") <= 90, F.col("turn")), F.when(~F.col("astray"), F.col("d_on"))))  # skips nulls
    near, days = F.col("near"), F.col("days")
    late = F.coalesce(F.when(first, F.col("begun")), F.when(last, F.col("fon") - F.col("end"))).between(180, 900)
    time = F.when(near.isNull(), 0.0).when(near <= 30, NEAR_TIME).when(near <= 90, 3.0).when(near <= 180, 1.0).when(late, -LATE).otherwise(-TIME_CONFLICT)
    later = (F.col("leg") > 1) & ((days == 1) | F.col("begun").between(20, 2160))
    # A flight's date may be off where its times are not.
    day = F.when(days == 0, _info("i_day")).when(days.isNull(), 0.0).when(F.least("d_off", "d_on") <= 180, F.lit(1.0)).when(F.abs(days) > 1, F.when(F.abs(F.col("day2") - F.col("day")) <= 1, -DATE_CONFLICT).otherwise(-2 * DATE_CONFLICT)).when(later, F.lit(2.0)).when(F.col("turn") <= 90, F.lit(-1.0)).otherwise(-DATE_CONFLICT)
    # Legs after a stop fly after the service began, within a day and a half.
    order = F.when((F.col("leg") > 1) & F.col("begun").isNotNull(), F.when(F.col("begun").between(20, 2160), 1.0).otherwise(-TIME_CONFLICT)).otherwise(0.0)
    enough = F.lit(ACCEPT) - F.when(F.col("legs") > 1, SUPPORT).otherwise(0.0)  # a leg's other legs can make up for SUPPORT at most
    equal = F.when(same("num", "fnum"), _info("i_num")).when(either_null("num", "fnum"), 0.0)
    x = x.withColumn("rest", (carrier + departure + arrival + time + day + order).cast("float"))
    if not numbers_equal:
        x = x.where(F.col("rest") + equal.otherwise(MISTYPED) >= enough)
    # Only what may still be a link is looked at digit by digit; a transposition changes a number by a multiple of nine.
    text, ftext = F.col("num").cast("string"), F.col("fnum").cast("string")
    swapped = ((F.col("num") - F.col("fnum")) % 9 == 0) & (F.array_sort(F.split(text, "")) == F.array_sort(F.split(ftext, "")))
    number = equal if numbers_equal else equal.when(F.levenshtein(text, ftext) <= 1, MISTYPED).when(swapped, MISTYPED).otherwise(-NUMBER_CONFLICT)
    lacks = lambda c, by: F.when(F.col(c).isNull(), by).otherwise(0.0)
    untold = lacks("arr", UNSEEN) + lacks("dep", UNSEEN) + lacks("num", 9.0) + F.when(F.size("carriers") == 0, _info("i_c1")).otherwise(0.0) + F.when(near.isNull() & F.col("foff").isNotNull(), NEAR_TIME).otherwise(0.0)
    x = x.withColumn("w", F.round((F.col("rest") + number).cast("double"), 4).cast("float")).withColumn("credit", untold.cast("float"))
    return x if numbers_equal else x.where(F.col("w") >= enough).select(*EDGE)


#: Ways of meeting, by these attributes and the day's block.
BY_NUMBER, BY_ROUTE, NO_ARRIVAL, NO_DEPARTURE, NO_STATIONS, NO_CARRIER, EXACT = range(7)
EDGE = ["fid", "pid", "leg", "legs", "w", "credit"]


def _key(way: int, *columns: str | Column) -> Column:
    """The key of a way of meeting, null where one of the columns is."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.xxhash64(F.lit(way), *cols))


def _entered(rows: DataFrame, *keys: Column) -> DataFrame:
    return rows.withColumn("key", F.explode(F.array(*keys))).where("key is not null")


def _in_blocks(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """Rows entered in the blocks of two days, once if these are the same."""
    a, b = F.floor(first / SPAN).cast("int"), F.floor(second / SPAN).cast("int")
    return rows.withColumn("block", F.explode(F.array(a, F.when(a.isNull() | (a != b), b)))).where("block is not null")


def _other_carrier() -> Column:
    """The marketing carrier where it differs from the operating one."""
    return F.when(F.col("c1").isNull() | (F.col("c1") != F.col("c2")), F.col("c2"))


#: For records that miss an attribute: what flights and planned legs miss, what they meet by instead, and whether by carrier, too.
INCOMPLETE = {
    NO_ARRIVAL: (("farr is null or astray", "arr is null"), ["fdep"], ["dep"], True), NO_DEPARTURE: (("fdep is null", "dep is null"), ["farr"], ["arr"], True),
    NO_STATIONS: (("fdep is null", "dep is null"), ["fnum"], ["num"], True), NO_CARRIER: (("c1 is null and c2 is null", "size(carriers) = 0"), ["fdep", "farr"], ["dep", "arr"], False),
}


def _by_way(rows: DataFrame, flights: bool, ways: list[int], only_incomplete: bool = False) -> DataFrame:
    """Flights or planned legs, with a day `at`, entered by the keys of these ways; by each of their carriers, where it counts."""
    if not flights and any(INCOMPLETE[w][3] for w in ways):
        rows = rows.withColumn("carrier", F.explode_outer("carriers"))
        first_carrier = F.col("carrier").isNull() | (F.col("carrier") == F.get("carriers", F.lit(0)))  # what doesn't depend on it is entered once
    else:
        first_carrier = F.lit(True)
    carriers = [F.col("c1"), _other_carrier()] if flights else [F.col("carrier")]
    entries = []
    for way in ways:
        gaps, f_cols, p_cols, by_carrier = INCOMPLETE[way]
        cols = [*(f_cols if flights else p_cols), "at"]
        for key in [_key(way, c, *cols) for c in carriers] if by_carrier else [F.when(first_carrier, _key(way, *cols))]:
            entries.append(F.struct(F.lit(way).alias("way"), (F.when(F.expr(gaps[0 if flights else 1]), key) if only_incomplete else key).alias("key")))
    return rows.withColumn("entry", F.explode(F.array(*entries))).where("entry.key is not null").select("*", "entry.way", "entry.key").drop("entry", "carrier")


def _batches(ways: dict[int, int], limit: int = BROADCAST_ROWS) -> list[list[int]]:
    """Ways that meet at once: all those whose rows can be broadcast together, and each of the others by itself."""
    together, rows = [], 0
    alone = []
    for way, n in sorted(ways.items(), key=lambda x: (x[1], x[0])):
        if rows + n <= limit:
            together, rows = [*together, way], rows + n
        else:
            alone.append([way])
    return ([together] if together else []) + alone


def link_flights(flights: DataFrame, plans: DataFrame, airlines: DataFrame, airports: DataFrame) -> DataFrame:
    """(flight_id, historical_source_row_id, leg, confidence): flown legs and the plan rows whose service they flew."""
    ids = small(codes_to_ids(airlines, "airline_id", ["carrier_code_iata", "carrier_code_icao"]), 3 * airlines.count())
    rare = Rarity(plans, ids)
    legs = planned_legs(plans, ids).where("day is not null").join(rare.of("number", "num", "i_num", NUMBERS), "num", "left").join(rare.of("day", "day", "i_day", DAYS), "day", "left")
    legs = _packed(legs.join(rare.of("station", "dep", "i_dep"), "dep", "left").join(rare.of("station", "arr", "i_arr"), "arr", "left"), "p_info", P_INFO)
    flown = _packed(flown_legs(flights, airports).join(rare.of("carrier", "c1", "i_c1"), "c1", "left").join(rare.of("carrier", "c2", "i_c2"), "c2", "left"), "f_info", F_INFO)
    # Where date and departure are far apart, either may be off: such flights are entered at both.
    left_on = F.floor(F.col("foff") / 1440).cast("int")
    flown = flown.withColumn("day2", F.when(F.col("fday").isNull() | (F.abs(left_on - F.col("fday")) > 1), left_on))
    flown = flown.where("fday is not null or day2 is not null")

    # First what agrees in number, day and both stations. If nothing else speaks against it, it is all but certain, and
    # what else its flight or planned leg might meet by another number would be pruned beside it. Rows that miss one of
    # the four get keys of their own, which meet nothing and spread them evenly.
    alone = lambda key, *row: F.coalesce(key, F.xxhash64(F.lit(-1), *row)).alias("key")
    l_side = legs.select("*", alone(_key(EXACT, "num", "dep", "arr", "day"), "pid", "leg"))
    f_side = flown.select("*", alone(_key(EXACT, "fnum", "fdep", "farr", "fday"), "fid"))
    met = l_side.join(f_side, (l_side.key == f_side.key) & (F.col("num") - F.col("fnum") == 0), "full").drop("key")
    ends = [c for c in (*legs.columns, *flown.columns) if c not in EDGE]
    first = stored(_weigh(met, numbers_equal=True).select(*EDGE, *ends))  # all legs and flights, those that met in one row
    edges = first.where("fid is not null and pid is not null").where(F.col("w") >= ACCEPT - F.when(F.col("legs") > 1, SUPPORT).otherwise(0.0)).select(*EDGE)
    unsettled = "fid is null or pid is null or w < {}".format(STRONG)
    l_cols, f_cols = legs.columns, flown.columns
    legs, flown = first.where("pid is not null").select(*l_cols), first.where("fid is not null").select(*f_cols)
    open_legs, free = first.where(unsettled).where("pid is not null").select(*l_cols), first.where(unsettled).where("fid is not null").select(*f_cols)

    # Then the rest by number and departure, or by carrier and route, within a day.
    close = (F.abs(F.col("fday") - F.col("day")) <= 1) | (F.abs(F.col("day2") - F.col("day")) <= 1)
    # Planned legs are entered in the blocks of the day before and after, flights in those of their days.
    by_carrier = lambda df: _in_blocks(df, F.col("day") - 1, F.col("day") + 1).withColumn("carrier", F.explode_outer("carriers"))
    blocked = lambda df: _in_blocks(df, F.col("fday"), F.col("day2"))
    first_carrier = F.col("carrier").isNull() | (F.col("carrier") == F.get("carriers", F.lit(0)))  # what doesn't depend on it is entered once
    planned = _entered(by_carrier(open_legs), F.when(first_carrier, _key(BY_NUMBER, "num", "dep", "block")), _key(BY_ROUTE, "carrier", "dep", "arr", "block"))
    flew = _entered(blocked(free), _key(BY_NUMBER, "fnum", "fdep", "block"), *[_key(BY_ROUTE, c, "fdep", "farr", "block") for c in (F.col("c1"), _other_carrier())])
    meets = [(_weigh(planned.join(flew, "key").where(close)), True)]  # and whether both sides are shuffled
    # Last, records that miss an attribute meet all of the other side by the rest; a diverted flight's arrival says nothing.
    # They are the few, so it is they that are entered at the days before and after, too, and all others at their own.
    own = lambda df, *at: df.withColumn("at", F.explode(F.array(*at)) if len(at) > 1 else F.col(*at)).where("at is not null")
    around = lambda df, *at: df.withColumn("at", F.explode(F.array_distinct(F.array(*[F.col(c) + k for c in at for k in (-1, 0, 1)])))).where("at is not null")
    f_days, p_days, every = ["fday", "day2"], ["day"], list(INCOMPLETE)
    gap = lambda side: " or ".join(dict.fromkeys(f"({gaps[side]})" for gaps, *_ in INCOMPLETE.values()))
    few_f = stored(_by_way(around(flown.where(gap(0)), *f_days), True, every, only_incomplete=True).drop("at"))
    few_p = stored(_by_way(around(legs.where(gap(1)), *p_days), False, every, only_incomplete=True).drop("at"))
    for few, others in ((few_f, lambda ways: _by_way(own(legs, *p_days), False, ways)), (few_p, lambda ways: _by_way(own(flown, *f_days), True, ways))):
        n = {r.way: r.n for r in few.groupBy("way").agg(F.count("*").alias("n")).collect()}  # one row a way
        for ways in _batches(n):
            rows = sum(n[w] for w in ways)
            meets.append((_weigh(others(ways).drop("at", "way").join(small(few.where(F.col("way").isin(ways)).drop("way"), rows), "key")), rows > BROADCAST_ROWS))
    # Where several are shuffled each is done before the next, so that the shuffle files of one at a time lie on disk.
    several = sum(shuffled for _, shuffled in meets) > 1
    for met, shuffled in meets:
        edges = edges.unionByName(stored(met) if shuffled and several else met)
    links = refine(edges, "fid", "pid", "leg", "legs", "w", "credit")
    return links.select(F.col("fid").alias("flight_id"), F.col("pid").alias("historical_source_row_id"), "leg", "confidence")
