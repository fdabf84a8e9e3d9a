"""The questions as functions with validated parameters, and their results as envelopes.

Parameters are checked before any plan is made. A refusal (wrong parameter, missing endpoint) is an error with a code;
an empty answer is a DataFrame that keeps its schema.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import flights, graph, states, versioning
from chronoloom.plans import reference as plans
from chronoloom.plans.dealt import deliveries_of
from chronoloom.sources.tables import table


class Refusal(ValueError):
    """A question that isn't answered."""

    def __init__(self, code: str, detail: str = "", status: str = "PARAMETER_ERROR"):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.status = code, status


def as_date(value: object, missing: str, invalid: str = "INVALID_DATE") -> date:
    if value is None or value == "":
        raise Refusal(missing)
    if isinstance(value, date):
        return value
    try:
        return date.fromisoformat(str(value))
    except ValueError:
        raise Refusal(invalid, str(value)) from None


def as_id(value: object, missing: str = "MISSING_AIRCRAFT_ID", invalid: str = "INVALID_AIRCRAFT_ID") -> int:
    if value is None or value == "":
        raise Refusal(missing)
    if isinstance(value, bool) or not str(value).lstrip("+").isdigit():
        raise Refusal(invalid, str(value))
    return int(str(value))


def as_choice(value: object, choices: tuple[str, ...], code: str) -> str:
    if value not in choices:
        raise Refusal(code, str(value))
    return str(value)


def month_end(value: object) -> date:
    d = as_date(value, "MISSING_MONTH_END", "INVALID_MONTH_END")
    if (date.fromordinal(d.toordinal() + 1)).day != 1:
        raise Refusal("INVALID_MONTH_END", str(d))
    return d


ROLES = ("marketing", "operating")


@dataclass(frozen=True)
class Engine:
    """All questions over the tables of one folder."""

    spark: SparkSession
    folder: str

    def _endpoint(self, day: date) -> int:
        """The ordinal of a delivery; exact, never the nearest."""
        cal = table(self.spark, self.folder, "schedule_snapshot_calendar").where(F.col("expected_publish_date") == F.lit(day)).first()
        if cal is None or not cal.is_present:
            raise Refusal("ENDPOINT_MISSING", str(day), "REFUSED")
        if not cal.is_complete:
            raise Refusal("ENDPOINT_INCOMPLETE", str(day), "REFUSED")
        return deliveries_of(self.spark, self.folder).where(F.col("day") == F.lit(day)).first().ord

    def _of(self, frame: DataFrame, aircraft: int) -> DataFrame:
        """A filter on the partition key, which passes below windows down to the scan."""
        return frame.where(F.col("entity") == aircraft)

    def aircraft_as_of(self, aircraft_id: object, as_of_date: object) -> DataFrame:
        """One row: status and value of every dimension on a day."""
        a, d = as_id(aircraft_id), as_date(as_of_date, "MISSING_AS_OF_DATE")
        events = self._of(plans._events(self.spark, self.folder), a)
        one = self.spark.createDataFrame([(a,)], "entity long").join(plans._existence(events), "entity", "left")
        got = versioning.as_of_status(versioning.daily(events, plans.ORDER, "existence_to"), one, plans.DIMENSIONS, [d.isoformat()])
        pick = lambda n, c: F.max(F.when(F.col("dimension") == n, F.col(c)))
        return got.groupBy(F.col("entity").alias("aircraft_id"), F.col("as_of").alias("as_of_date")).agg(*[pick(n, c).alias(f"{n}_{c}") for n in plans.DIMENSIONS for c in ("status", "value")])

    def status_reversion_spells(self, aircraft_id: object) -> DataFrame:
        return self._of(plans._spells(self.spark, self.folder), as_id(aircraft_id)).orderBy("start_day", "end_day")

    def fleet_storage_spell_distribution(self, aircraft_scope: object = "FLEET") -> DataFrame:
        as_choice(aircraft_scope, ("FLEET",), "INVALID_AIRCRAFT_SCOPE")
        return plans.spell_distribution(self.spark, self.folder).orderBy("bucket_order")

    def month_end_fleet_composition(self, start: object, end: object, status: object = "In Service") -> DataFrame:
        s, e = month_end(start), month_end(end)
        if s > e:
            raise Refusal("INVALID_MONTH_END_RANGE", f"{s} > {e}")
        if not isinstance(status, str) or not status:
            raise Refusal("INVALID_STATUS", str(status))
        first = lambda d: d.replace(day=1).isoformat()
        return versioning.composition(plans._versions(self.spark, self.folder), "aircraft_type", ("aircraft_status", status), first(s), first(e)).orderBy("month_end", F.col("label").asc_nulls_last())

    def type_engine_histories(self, aircraft_id: object) -> DataFrame:
        events = self._of(plans._events(self.spark, self.folder), as_id(aircraft_id))
        return versioning.with_previous(versioning.daily(events, plans.ORDER, "existence_to"), ["aircraft_type"]).orderBy("dimension", "valid_from")

    #: Kinds of changes in the order in which they are listed.
    CHANGES = ("ADDED", "REMOVED", "CHANGED", "PAIRED", "AMBIGUOUS", "UNPAIRED_REMOVED", "UNPAIRED_ADDED")

    def schedule_changes(self, start: object, end: object, cadence: object = "EVERY_DELIVERY") -> DataFrame:
        """Changes between the deliveries of two days, field by field with old and new values, and how removed and added keys pair.

        cadence: EVERY_DELIVERY compares each delivery with the one before, ENDPOINTS only the last with the first.
        """
        a, b = as_date(start, "MISSING_START_DATE"), as_date(end, "MISSING_END_DATE")
        lo, hi = self._endpoint(a), self._endpoint(b)
        ends = as_choice(cadence, ("EVERY_DELIVERY", "ENDPOINTS"), "INVALID_CADENCE") == "ENDPOINTS"
        # Deliveries are numbered from 0 within the span; of the endpoints alone there are two.
        place = (lambda c: F.when(c == lo, 0).when(c == hi, 1)) if ends else (lambda c: c - lo)
        obs = plans._observed(self.spark, self.folder).where(F.col("ord").between(lo, hi)).withColumn("ord", place(F.col("ord"))).where("ord is not null")
        steps = (2 if hi > lo else 1) if ends else hi - lo + 1
        from chronoloom.operators import snapshots

        fields = snapshots.field_changes(obs, steps, plans.CONTENT)
        sides = states.amendment_sides(fields.where(F.col("field") == snapshots.PRESENCE), obs, plans._SIGN, "effective_date", "discontinue_date")
        pairs = states.amendments(sides, plans._SIGN)
        none = F.lit(None).cast("string")
        exact = fields.select("ord", "key", F.upper("change_type").alias("kind"), "field", "old_value", "new_value", "reappears")
        paired = pairs.select("ord", F.col("removed_key").alias("key"), F.when((F.col("partners_removed") == 1) & (F.col("partners_added") == 1), "PAIRED").otherwise("AMBIGUOUS").alias("kind"), F.lit("schedule_key").alias("field"), F.col("removed_key").alias("old_value"), F.col("added_key").alias("new_value"), F.lit(False).alias("reappears"))
        alone = states.unpaired(sides, pairs).select("ord", "key", F.concat(F.lit("UNPAIRED_"), F.upper("side")).alias("kind"), none.alias("field"), none.alias("old_value"), none.alias("new_value"), F.lit(False).alias("reappears"))
        days = deliveries_of(self.spark, self.folder).select(place(F.col("ord")).alias("ord"), F.col("day").alias("publish_date")).where("ord is not null")
        rank = F.array_position(F.array(*[F.lit(k) for k in self.CHANGES]), F.col("kind"))
        out = exact.unionByName(paired).unionByName(alone).join(F.broadcast(days), "ord").withColumn("kind_rank", rank)
        identity = F.sha2(F.concat_ws("|", F.col("publish_date").cast("string"), "kind", "key", F.coalesce("field", F.lit("")), F.coalesce("new_value", F.lit(""))), 256)
        return out.select("publish_date", "kind", "kind_rank", "key", "field", "old_value", "new_value", "reappears", identity.alias("change_id")).orderBy("publish_date", "kind_rank", "key", F.col("field").asc_nulls_first(), "new_value")

    def _market(self, role: object) -> list[str]:
        return [f"{as_choice(role, ROLES, 'INVALID_CARRIER_ROLE')}_carrier_internal", *plans._MARKET[1:]]

    def market_entries_and_exits(self, latest: object, comparison: object, carrier_role: object = "marketing") -> DataFrame:
        market = self._market(carrier_role)
        later, earlier = self._endpoint(as_date(latest, "MISSING_LATEST_DATE")), self._endpoint(as_date(comparison, "MISSING_COMPARISON_DATE"))
        return states.entries_and_exits(plans._observed(self.spark, self.folder), market, earlier, later).orderBy("kind", *market)

    def market_count_at(self, day: object, carrier_role: object = "marketing") -> DataFrame:
        market = self._market(carrier_role)
        o = self._endpoint(as_date(day, "MISSING_DATE"))
        return plans._observed(self.spark, self.folder).where(F.col("ord") == o).agg(F.countDistinct(*market).alias("n"))

    def route_capacity(self, knowledge: object, operating: object, carrier_role: object = "marketing") -> DataFrame:
        market = self._market(carrier_role)
        k, o = as_date(knowledge, "MISSING_KNOWLEDGE_DATE"), as_date(operating, "MISSING_OPERATING_DATE")
        return states.capacity(plans._dated(self.spark, self.folder), k.isoformat(), o.isoformat(), market, plans._WEEK, "weekly_frequency", "total_seats", "effective_date", "discontinue_date").orderBy(*market)

    def actual_rotation(self, aircraft_id: object, flight_departure_date: object) -> DataFrame:
        """The day's legs of an aircraft with the facts of their links and their places in the day's chains."""
        a, d = as_id(aircraft_id), as_date(flight_departure_date, "MISSING_FLIGHT_DEPARTURE_DATE")
        legs = plans._actual(self.spark, self.folder)
        today = legs.where((F.col("aircraft_id") == a) & (F.col("flight_departure_date") == F.lit(d)))
        if today.isEmpty():
            raise Refusal("NO_ACTUAL_FLIGHTS", f"{a} {d}", "NOT_FOUND")
        facts = flights.link_facts(legs).join(today.select("flight_id"), "flight_id", "left_semi")
        links = today.select("flight_id").join(facts, "flight_id", "left")
        places = graph.chains(links.select("flight_id", F.when(F.col("holds"), F.col("target")).alias("target")), "flight_id", "target")
        return links.join(places, "flight_id", "left").orderBy(F.col("head").asc_nulls_last(), "position", "flight_id")

    CATALOG = ("aircraft_as_of", "status_reversion_spells", "fleet_storage_spell_distribution", "month_end_fleet_composition", "type_engine_histories", "schedule_changes", "market_entries_and_exits", "market_count_at", "route_capacity", "actual_rotation")

    def invoke(self, name: str, **parameters: object) -> dict:
        """A question by name, as an envelope {status, error_code, parameters, row_count, columns, rows}; rows of one answer, meant for the edge."""
        envelope = {"question": name, "parameters": {k: str(v) for k, v in parameters.items()}}
        try:
            f: Callable[..., DataFrame] = getattr(self, as_choice(name, self.CATALOG, "UNKNOWN_QUESTION"))
            df = f(**parameters)
        except Refusal as r:
            return envelope | {"status": r.status, "error_code": r.code, "row_count": 0, "columns": [], "rows": []}
        rows = [r.asDict(recursive=True) for r in df.collect()]
        return envelope | {"status": "OK", "error_code": None, "row_count": len(rows), "columns": df.columns, "rows": rows}
