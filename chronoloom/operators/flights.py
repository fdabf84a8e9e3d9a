"""Flown legs and plan rows: normalisation, link validation, UTC derivation, canonical rows, planned legs, compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.canon import flag
from chronoloom.operators.packed import split_packed
from chronoloom.operators.resolve import first_row


def actual(flights: DataFrame) -> DataFrame:
    """One row per flight id, the most complete one, with boolean flags, a numeric flight number and whether the diversion's flag and code agree."""
    known = sum((F.col(c).isNotNull().cast("int") for c in flights.columns), F.lit(0))
    one = first_row(flights.where("flight_id is not null").withColumn("_known", known), ["flight_id"], [F.col("_known").desc(), *[F.col(c).asc_nulls_last() for c in flights.columns if c != "flight_id"]]).drop("_known")
    number = F.when(F.col("flight_number").rlike("^[0-9]+$"), F.col("flight_number").try_cast("long"))
    return one.select("*", number.alias("number"), flag(F.col("is_cancelled")).alias("cancelled"), flag(F.col("is_diverted")).alias("diverted"), (flag(F.col("is_diverted")) == F.col("diverted_airport_code").isNotNull()).alias("diversion_agrees"), F.coalesce("diverted_airport_code", "arrival_airport_code").alias("continuity_code"))


#: What is known about a link between two legs, each true, false or, where a side doesn't say, null.
FACTS = {
    "flown": "not cancelled", "timed": "actual_gate_departure_time_utc is not null and actual_gate_arrival_time_utc is not null", "names_other": "target <> flight_id", "target_exists": "t_id is not null",
    "target_flown": "not t_cancelled", "same_aircraft": "aircraft_id = t_aircraft", "same_day": "flight_departure_date = t_day", "in_order": "t_off >= actual_gate_arrival_time_utc", "connects": "continuity_code = t_from",
}


def link_facts(legs: DataFrame) -> DataFrame:
    """(flight_id, target, FACTS..., holds): the facts of each leg's link to its next leg; holds: all facts are true."""
    t = legs.select(F.col("flight_id").alias("t_id"), F.col("aircraft_id").alias("t_aircraft"), F.col("flight_departure_date").alias("t_day"), F.col("departure_airport_code").alias("t_from"), F.col("actual_gate_departure_time_utc").alias("t_off"), F.col("cancelled").alias("t_cancelled"))
    x = legs.withColumnRenamed("next_flight_id", "target").where("target is not null").join(t, F.col("target") == F.col("t_id"), "left")
    facts = [F.expr(e).alias(n) for n, e in FACTS.items()]
    return x.select("flight_id", "target", *facts).withColumn("holds", F.expr(" and ".join(f"coalesce({n}, false)" for n in FACTS)))


def utc_time(day: Column, local: Column, offset: Column, later: Column | None = None) -> Column:
    """UTC timestamp of a local text time on a day, `later` days on; null without a finite offset."""
    base = F.date_add(day, F.coalesce(later, F.lit(0)).cast("int")) if later is not None else day
    stamp = F.concat(F.date_format(base, "yyyy-MM-dd"), F.lit(" "), local).try_cast("timestamp_ntz")
    finite = offset.isNotNull() & ~F.isnan(offset) & (F.abs(offset) < 1e6)
    return F.when(finite, F.timestamp_add("MINUTE", -offset.cast("int"), stamp))


def with_utc(plans: DataFrame) -> DataFrame:
    """Plan rows with derived UTC times and how they came about: OFFSET_DERIVED, UNRESOLVED_UTC_DATE or NO_LOCAL_TIME."""
    off = utc_time(F.col("operating_date"), F.col("passenger_departure_local_time"), F.col("departure_utc_offset_minutes"))
    on = utc_time(F.col("operating_date"), F.col("passenger_arrival_local_time"), F.col("arrival_utc_offset_minutes"), F.col("arrival_day_indicator"))
    status = F.when(F.col("operating_date").isNull() | F.col("passenger_departure_local_time").isNull(), "NO_LOCAL_TIME").when(F.col("departure_utc").isNull(), "UNRESOLVED_UTC_DATE").otherwise("OFFSET_DERIVED")
    return plans.withColumn("departure_utc", off).withColumn("arrival_utc", on).withColumn("utc_status", status)


PASSENGER_KEY = ["operating_carrier_internal", "marketing_carrier_internal", "flight_number", "operating_date", "departure_station_code_iata", "arrival_station_code_iata"]


def passenger_status(plans: DataFrame) -> DataFrame:
    """Plan rows with cleaned key columns, their status and the key columns they lack.

    QUARANTINED: no row id and an incomplete key; INVALID_KEY: an id but an incomplete key; else VALID.
    """
    clean = plans
    for c in PASSENGER_KEY:
        if dict(plans.dtypes)[c] == "string":
            clean = clean.withColumn(c, F.nullif(F.upper(F.trim(c)), F.lit("")))
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in PASSENGER_KEY])
    status = F.when(F.col("missing") == "", "VALID").when(F.col("historical_source_row_id").isNull(), "QUARANTINED").otherwise("INVALID_KEY")
    return clean.withColumn("missing", missing).withColumn("status", status)


def passenger_canonical(rows: DataFrame) -> DataFrame:
    """The row that counts for each valid key, the latest published, with the number of rows and distinct ids it stands for."""
    w = Window.partitionBy(*PASSENGER_KEY)
    order = [F.col("publish_date").desc_nulls_last(), F.col("historical_source_row_id").asc_nulls_last()]
    valid = rows.where("status = 'VALID'")
    ranked = valid.withColumn("nth", F.row_number().over(w.orderBy(*order))).withColumn("rows", F.count("*").over(w)).withColumn("ids", F.size(F.collect_set("historical_source_row_id").over(w)))
    return ranked.where("nth = 1").select(*PASSENGER_KEY, "historical_source_row_id", "publish_date", "rows", "ids")


def quarantine(rows: DataFrame) -> DataFrame:
    """(missing, reason, occurrences): rows that can't be used, counted instead of dropped."""
    return rows.where("status <> 'VALID'").groupBy(F.col("status").alias("reason"), "missing").agg(F.count("*").alias("occurrences"))


def planned_legs(rows: DataFrame) -> DataFrame:
    """(historical_source_row_id, leg_index, legs, origin, destination): consecutive stations of each plan row."""
    one = first_row(rows.where("historical_source_row_id is not null"), ["historical_source_row_id"], [F.col("publish_date").desc_nulls_last(), F.col("departure_station_code_iata").asc_nulls_last(), F.col("arrival_station_code_iata").asc_nulls_last(), F.col("intermediate_stop_station_codes_iata").asc_nulls_last()])
    stops = split_packed(one, "historical_source_row_id", "intermediate_stop_station_codes_iata").groupBy("historical_source_row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda s: s["value"]).alias("stops"))
    code = lambda c: F.upper(F.trim(c))
    route = F.concat(F.array(code("departure_station_code_iata")), F.coalesce("stops", F.array().cast("array<string>")), F.array(code("arrival_station_code_iata")))
    r = one.join(stops, "historical_source_row_id", "left").select("historical_source_row_id", "operating_date", "flight_number", route.alias("route"))
    return r.select("historical_source_row_id", "operating_date", "flight_number", (F.size("route") - 1).alias("legs"), "route", F.posexplode(F.slice("route", F.lit(1), F.size("route") - 1)).alias("at", "origin")).select(
        "historical_source_row_id", "operating_date", "flight_number", (F.col("at") + 1).alias("leg_index"), "legs", "origin", F.get("route", F.col("at") + 1).alias("destination"))


def compatibility(planned: DataFrame, legs: DataFrame) -> DataFrame:
    """(flight_id, historical_source_row_id, leg_index): legs and planned legs that agree in day, number and both ends."""
    return planned.join(legs.select("flight_id", F.col("flight_departure_date").alias("operating_date"), F.col("number").alias("flight_number"), "origin", "destination"), ["operating_date", "flight_number", "origin", "destination"]).select("flight_id", "historical_source_row_id", "leg_index")


def with_roles(pairs: DataFrame, planned: DataFrame, flown: DataFrame, claims: DataFrame) -> DataFrame:
    """pairs with operating_agrees and marketing_agrees: whether the carrier in each role is the same; null where a side has none or its code names no or several carriers.

    planned: (historical_source_row_id, operating, marketing) codes; flown: (flight_id, operating_carrier_code,
    marketing_carrier_code) ids; claims: (method, code, id) of a reference table, whichever notation a code is in.
    """
    one = claims.groupBy("code").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).where("n = 1")
    rows = planned
    for role in ("operating", "marketing"):
        rows = rows.join(one.select(F.col("code").alias(role), F.col("id").alias(f"{role}_id")), role, "left")
    x = pairs.join(rows.select("historical_source_row_id", "operating_id", "marketing_id"), "historical_source_row_id").join(flown, "flight_id")
    return x.select(*pairs.columns, (F.col("operating_id") == F.col("operating_carrier_code")).alias("operating_agrees"), (F.col("marketing_id") == F.col("marketing_carrier_code")).alias("marketing_agrees"))


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose ends have no other partner."""
    alone = lambda c, o: pairs.groupBy(c).agg(F.countDistinct(o).alias("n")).where("n = 1").select(c)
    return pairs.join(alone(left, right), left, "left_semi").join(alone(right, left), right, "left_semi").select(left, right).distinct()
