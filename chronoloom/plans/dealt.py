"""Queries of the general data problems 1, 2, 4, 5, 6 and 7 over their whole tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import asof, hierarchy, history, orphans, packed, snapshots
from chronoloom.sources.tables import table

#: The columns of schedule_snapshot that make up a state, in the table's order.
STATE_COLUMNS = [
    "marketing_carrier_internal", "operating_carrier_internal", "flight_number", "service_type_iata", "effective_date", "discontinue_date",
    "departure_station_code_iata", "arrival_station_code_iata", "departure_terminal", "arrival_terminal", "is_operating_monday",
    "is_operating_tuesday", "is_operating_wednesday", "is_operating_thursday", "is_operating_friday", "is_operating_saturday",
    "is_operating_sunday", "days_pattern", "weekly_frequency", "passenger_departure_utc_time", "passenger_arrival_utc_time",
    "passenger_departure_local_time", "passenger_arrival_local_time", "arrival_day_indicator", "scheduled_block_minutes",
    "equipment_subtype_code_iata", "total_seats", "first_class_seats", "business_class_seats", "premium_economy_seats",
    "economy_class_seats", "is_codeshare", "codeshare_carrier_internal", "number_of_intermediate_stops", "intermediate_stop_station_codes_iata",
]
NO_STATION = "departure_station_code_iata is null or arrival_station_code_iata is null"


# -- 1 ---------------------------------------------------------------------------------------------------------------
def _flights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "aircraft_flight", "flight_id", "next_flight_id", "aircraft_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    places = hierarchy.resolve_hierarchy(_flights(spark, d), "flight_id", "next_flight_id", "aircraft_id")
    return places.where("depth <> 0").select("flight_id", F.col("root").alias("root_flight_id"), "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, root, depth and number of descendants of every flight, also on and towards endless rotations, where the path is null."""
    tree = hierarchy.hierarchy_paths(_flights(spark, d), "flight_id", "next_flight_id", "aircraft_id")
    return tree.select("flight_id", F.col("root").alias("root_flight_id"), "depth", F.array_join("path", ">").alias("path"), "descendants")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every flight with each of its descendants, also on and towards endless rotations."""
    return hierarchy.descendants(_flights(spark, d), "flight_id", "next_flight_id", "aircraft_id").withColumnRenamed("descendant", "descendant_id")


_REACH = """WITH RECURSIVE f AS (SELECT flight_id, min(next_flight_id) AS nxt FROM aircraft_flight WHERE flight_id IS NOT NULL GROUP BY flight_id),
l AS (SELECT f.flight_id, f.nxt FROM f JOIN f g ON g.flight_id = f.nxt),
r(s, c) AS (SELECT flight_id, nxt FROM l UNION SELECT r.s, l.nxt FROM r JOIN l ON l.flight_id = r.c),
oncycle AS (SELECT s AS n FROM r WHERE s = c),
low AS (SELECT r.s AS n, min(r.c) AS m FROM r JOIN oncycle ON oncycle.n = r.s GROUP BY r.s),
places AS (SELECT r.s AS flight_id,
 CASE WHEN bool_or(low.n IS NOT NULL) THEN min(low.m) ELSE min(CASE WHEN l.flight_id IS NULL THEN r.c END) END AS root_flight_id,
 CASE WHEN bool_or(r.s = r.c) THEN -1 WHEN bool_or(low.n IS NOT NULL) THEN -2 ELSE count(*) END AS depth
FROM r LEFT JOIN low ON low.n = r.c LEFT JOIN l ON l.flight_id = r.c GROUP BY r.s)
"""
P1_FOUND = _REACH + "SELECT flight_id, root_flight_id, depth FROM places"
P1_PATHS = (
    _REACH.rstrip()
    + """,
below AS (SELECT c AS flight_id, count(*) AS n FROM r WHERE s <> c GROUP BY c),
up AS (SELECT r.s AS flight_id, string_agg(CAST(r.c AS VARCHAR), '>' ORDER BY coalesce(p.depth, 0) DESC) AS way FROM r LEFT JOIN places p ON p.flight_id = r.c GROUP BY r.s)
SELECT f.flight_id, coalesce(p.root_flight_id, f.flight_id) AS root_flight_id, coalesce(p.depth, 0) AS depth,
 CASE WHEN p.depth < 0 THEN NULL ELSE concat_ws('>', CAST(f.flight_id AS VARCHAR), up.way) END AS path, coalesce(below.n, 0) AS descendants
FROM f LEFT JOIN places p USING (flight_id) LEFT JOIN below USING (flight_id) LEFT JOIN up USING (flight_id)"""
)
P1_DESCENDANTS = _REACH + "SELECT c AS flight_id, s AS descendant_id FROM r WHERE s <> c"


#: The number of the increment of rows without a date, beyond any month's.
UNDATED = 10**8


# -- 2 ---------------------------------------------------------------------------------------------------------------
def _increment(period: Column) -> Column:
    """Increments are months, in order; what has no date comes last."""
    return F.coalesce(F.replace(period, F.lit("-"), F.lit("")).try_cast("int"), F.lit(UNDATED))


def _waits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Spans of waiting, and the months (at, increment). Each month brings its flights, as parents and with their links, and its validated links."""
    flights = table(spark, d, "aircraft_flight", "flight_id", "next_flight_id", "flight_departure_date")
    links = table(spark, d, "rotation_link_validation", "flight_id", "target_token", "selected_local_date")
    refs = orphans.references(flights, "aircraft_flight", "flight_id", "next_flight_id", "flight_departure_date").unionByName(orphans.references(links, "rotation_link_validation", "flight_id", orphans.whole_number("target_token"), "selected_local_date"))
    month = lambda c: F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("unknown"))
    arrived = flights.select(F.col("flight_id").alias("key"), _increment(month("flight_departure_date")).alias("at"))
    months = flights.select(month("flight_departure_date").alias("increment")).unionByName(links.select(month("selected_local_date").alias("increment"))).distinct().withColumn("at", _increment(F.col("increment")))
    return orphans.replay(refs.withColumn("at", _increment(F.col("period"))), arrived), months


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    waiting = orphans.waiting_at_end(_waits(spark, d)[0])
    return waiting.select("source_table", F.col("ref_id").alias("flight_id"), F.col("key").alias("missing_flight_id"), F.col("period").alias("period_month"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month of the referring row, after each monthly increment."""
    spans, months = _waits(spark, d)
    return orphans.counts_by_increment(spans, months).join(F.broadcast(months), "at").select("increment", "source_table", F.col("period").alias("period_month"), "orphans", "missing_keys")


_TOKEN = r"""regexp_replace(regexp_replace(target_token, '[\s"]', '', 'g'), '^([+-]?[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]*)?$', replace(regexp_replace(target_token, '[\s"]', '', 'g'), ',', ''))"""
_WAITING = f"""WITH ids AS (SELECT DISTINCT flight_id AS k FROM aircraft_flight WHERE flight_id IS NOT NULL),
links AS (SELECT flight_id, selected_local_date, {_TOKEN} AS t FROM rotation_link_validation),
refs AS (SELECT 'aircraft_flight' AS source_table, flight_id, next_flight_id AS missing_flight_id, coalesce(strftime(flight_departure_date, '%Y-%m'), 'unknown') AS period_month FROM aircraft_flight
UNION ALL SELECT 'rotation_link_validation', flight_id, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+(\\.0*)?') THEN TRY_CAST(regexp_replace(t, '\\.0*$', '') AS BIGINT) END, coalesce(strftime(selected_local_date, '%Y-%m'), 'unknown') FROM links),
waiting AS (SELECT DISTINCT * FROM refs WHERE flight_id IS NOT NULL AND missing_flight_id IS NOT NULL AND missing_flight_id NOT IN (SELECT k FROM ids))
"""
P2_FOUND = _WAITING + "SELECT * FROM waiting"
P2_COUNTS = (
    _WAITING.rstrip()
    + """,
arrival AS (SELECT flight_id AS k, min(coalesce(strftime(flight_departure_date, '%Y-%m'), 'unknown')) AS since FROM aircraft_flight WHERE flight_id IS NOT NULL GROUP BY 1),
months AS (SELECT coalesce(strftime(flight_departure_date, '%Y-%m'), 'unknown') AS increment FROM aircraft_flight UNION SELECT coalesce(strftime(selected_local_date, '%Y-%m'), 'unknown') FROM rotation_link_validation),
every AS (SELECT DISTINCT * FROM refs WHERE flight_id IS NOT NULL AND missing_flight_id IS NOT NULL)
SELECT increment, source_table, period_month, count(*) AS orphans, count(DISTINCT missing_flight_id) AS missing_keys
FROM months JOIN every ON period_month <= increment LEFT JOIN arrival ON k = missing_flight_id WHERE since IS NULL OR since > increment GROUP BY increment, source_table, period_month"""
)


# -- 4 ---------------------------------------------------------------------------------------------------------------
def _known(spark: SparkSession, d: str, payload: tuple[str, ...] = ()) -> DataFrame:
    return asof.as_of_join(
        table(spark, d, "aircraft_flight", "flight_id", "aircraft_id", "flight_departure_date"), table(spark, d, "aircraft_dimension_daily_assignment"),
        event_id="flight_id", entity="aircraft_id", event_day="flight_departure_date", version_entity="aircraft_id", dimension="dimension", valid_from="valid_from",
        valid_to="valid_to", published="publish_date", sequence="row_sequence_number", version_id="aircraft_history_id", payload=payload,
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d)


def p4_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Flights by month, status and type known on their day."""
    known = _known(spark, d, ("aircraft_status_code", "aircraft_type_label"))
    return known.groupBy("dimension", F.coalesce("aircraft_status_code", "aircraft_type_label").alias("label")).agg(F.count("*").alias("flights"))


_AS_OF = """WITH e AS (SELECT DISTINCT flight_id, aircraft_id, flight_departure_date AS day FROM aircraft_flight WHERE flight_id IS NOT NULL AND aircraft_id IS NOT NULL AND flight_departure_date IS NOT NULL),
m AS (SELECT e.flight_id, v.dimension, v.aircraft_history_id, coalesce(v.aircraft_status_code, v.aircraft_type_label) AS label,
 row_number() OVER (PARTITION BY e.flight_id, e.aircraft_id, e.day, v.dimension ORDER BY v.publish_date DESC, v.row_sequence_number DESC, v.aircraft_history_id DESC) AS n
FROM e JOIN aircraft_dimension_daily_assignment v ON v.aircraft_id = e.aircraft_id AND v.valid_from <= e.day AND (v.valid_to IS NULL OR year(v.valid_to) >= 9999 OR e.day < v.valid_to) AND v.publish_date <= e.day)
"""
P4_FOUND = _AS_OF + "SELECT DISTINCT flight_id, dimension, aircraft_history_id FROM m WHERE n = 1"
P4_ATTRIBUTES = _AS_OF + "SELECT dimension, label, count(*) AS flights FROM (SELECT DISTINCT flight_id, dimension, aircraft_history_id, label FROM m WHERE n = 1) GROUP BY dimension, label"


# -- 5, 6 ------------------------------------------------------------------------------------------------------------
def deliveries_of(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.eligible(table(spark, d, "schedule_snapshot_calendar"), "expected_publish_date", "is_present", "is_complete")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """(key, ord, the state columns): the row that counts per schedule key and eligible delivery."""
    rows = table(spark, d, "schedule_snapshot", "schedule_key", "publish_date", *STATE_COLUMNS, "itinerary_variation_identifier", "normalized_row_hash")
    order = [*snapshots.ranking("weekly_frequency", True), *snapshots.ranking("total_seats", True), *snapshots.ranking("itinerary_variation_identifier"), *snapshots.ranking("normalized_row_hash")]
    return snapshots.canonical(rows, deliveries_of(spark, d), "schedule_key", "publish_date", order, STATE_COLUMNS)


def _log(spark: SparkSession, d: str, values: bool) -> tuple[DataFrame, DataFrame]:
    days = deliveries_of(spark, d)
    return history.change_log(observations(spark, d).where(f"not ({NO_STATION})"), days.count(), STATE_COLUMNS, values), days


def _dated(spans: DataFrame, days: DataFrame) -> DataFrame:
    day = days.select("ord", F.date_format("day", "yyyy-MM-dd").alias("day"))
    spans = spans.join(F.broadcast(day.select(F.col("ord").alias("from_ord"), F.col("day").alias("valid_from"))), "from_ord").join(F.broadcast(day.select(F.col("ord").alias("to_ord"), F.col("day").alias("to"))), "to_ord", "left")
    return spans.withColumn("valid_to", F.coalesce("to", F.lit("9999-01-01"))).withColumnRenamed("key", "schedule_key").drop("from_ord", "to_ord", "to")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    log, days = _log(spark, d, False)
    return _dated(history.boundaries(log), days).select("schedule_key", "valid_from", "valid_to")


def _attribute_spans(spark: SparkSession, d: str) -> DataFrame:
    log, days = _log(spark, d, True)
    names = F.array(*[F.lit(c) for c in STATE_COLUMNS])
    spans = history.attribute_intervals(log, len(STATE_COLUMNS)).withColumn("attribute", F.get(names, F.col("attribute")))
    return _dated(spans, days).select("schedule_key", "attribute", "valid_from", "valid_to", "value")


def p5_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Every attribute of every key with its own intervals."""
    return _attribute_spans(spark, d)


def p5_versions(spark: SparkSession, d: str) -> DataFrame:
    """The versions with the values of all attributes as text, combined from the attributes' logs."""
    log, days = _log(spark, d, True)
    return _dated(history.versions(log, STATE_COLUMNS), days).select("schedule_key", "valid_from", "valid_to", *STATE_COLUMNS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    days = deliveries_of(spark, d)
    changes = snapshots.diff(observations(spark, d), days.count(), STATE_COLUMNS)
    return changes.join(F.broadcast(days), "ord").select(F.date_format("day", "yyyy-MM-dd").alias("publish_date"), F.col("key").alias("schedule_key"), "change_type")


def p6_fields(spark: SparkSession, d: str) -> DataFrame:
    """How many keys changed each field from one delivery to the next."""
    days = deliveries_of(spark, d)
    changes = snapshots.diff(observations(spark, d), days.count(), STATE_COLUMNS, report_fields=True)
    per = changes.select("ord", F.explode("changed").alias("field")).groupBy("ord", "field").agg(F.count("*").alias("keys"))
    return per.join(F.broadcast(days), "ord").select(F.date_format("day", "yyyy-MM-dd").alias("publish_date"), "field", "keys")


_COLS = ", ".join(STATE_COLUMNS)
_OBS = f"""WITH days AS (SELECT DISTINCT expected_publish_date AS day FROM schedule_snapshot_calendar WHERE is_present AND is_complete),
cal AS (SELECT day, row_number() OVER (ORDER BY day) AS o FROM days),
obs AS (SELECT * FROM (SELECT s.*, cal.o, row_number() OVER (PARTITION BY schedule_key, publish_date ORDER BY weekly_frequency DESC NULLS LAST, total_seats DESC NULLS LAST, itinerary_variation_identifier NULLS LAST, normalized_row_hash NULLS LAST) AS n
 FROM schedule_snapshot s JOIN cal ON cal.day = s.publish_date WHERE schedule_key IS NOT NULL) WHERE n = 1),
"""
_VERSIONS = (
    _OBS
    + f"""good AS (SELECT * FROM obs WHERE NOT ({NO_STATION})),
a AS (SELECT *, lag(o) OVER w AS po, lag(row({_COLS})) OVER w AS pr, row({_COLS}) AS r FROM good WINDOW w AS (PARTITION BY schedule_key ORDER BY o)),
b AS (SELECT *, sum(CASE WHEN po = o - 1 AND pr IS NOT DISTINCT FROM r THEN 0 ELSE 1 END) OVER (PARTITION BY schedule_key ORDER BY o) AS g FROM a),
v AS (SELECT schedule_key, g, min(o) AS f, max(o) AS t FROM b GROUP BY schedule_key, g)
"""
)
_SPAN = "strftime(x.day, '%Y-%m-%d') AS valid_from, coalesce(strftime(y.day, '%Y-%m-%d'), '9999-01-01') AS valid_to"
P5_FOUND = _VERSIONS + f"SELECT v.schedule_key, {_SPAN} FROM v JOIN cal x ON x.o = v.f LEFT JOIN cal y ON y.o = v.t + 1"
P5_VERSIONS = _VERSIONS + f"SELECT v.schedule_key, {_SPAN}, {', '.join(f'CAST(b.{c} AS VARCHAR) AS {c}' for c in STATE_COLUMNS)} FROM v JOIN b ON b.schedule_key = v.schedule_key AND b.o = v.f JOIN cal x ON x.o = v.f LEFT JOIN cal y ON y.o = v.t + 1"
P5_ATTRIBUTES = (
    _OBS
    + f"""good AS (SELECT * FROM obs WHERE NOT ({NO_STATION})),
u AS ({" UNION ALL ".join(f"SELECT schedule_key, o, '{c}' AS attribute, CAST({c} AS VARCHAR) AS value FROM good" for c in STATE_COLUMNS)}),
a AS (SELECT *, lag(o) OVER w AS po, lag(value) OVER w AS pv FROM u WINDOW w AS (PARTITION BY schedule_key, attribute ORDER BY o)),
b AS (SELECT *, sum(CASE WHEN po = o - 1 AND pv IS NOT DISTINCT FROM value THEN 0 ELSE 1 END) OVER (PARTITION BY schedule_key, attribute ORDER BY o) AS g FROM a),
v AS (SELECT schedule_key, attribute, g, min(o) AS f, max(o) AS t, any_value(value) AS value FROM b GROUP BY schedule_key, attribute, g)
SELECT v.schedule_key, v.attribute, {_SPAN}, v.value FROM v JOIN cal x ON x.o = v.f LEFT JOIN cal y ON y.o = v.t + 1"""
)
_DIFF = _OBS + f"""k AS (SELECT schedule_key, o, row({_COLS}) AS r, {_COLS} FROM obs),
chg AS (SELECT coalesce(q.o, p.o + 1) AS o, coalesce(q.schedule_key, p.schedule_key) AS schedule_key,
 CASE WHEN p.o IS NULL THEN 'added' WHEN q.o IS NULL THEN 'removed' WHEN p.r IS DISTINCT FROM q.r THEN 'changed' END AS change_type, p.o AS po, q.o AS qo
FROM k p FULL JOIN k q ON p.schedule_key = q.schedule_key AND q.o = p.o + 1)
"""
P6_FOUND = _DIFF + "SELECT strftime(cal.day, '%Y-%m-%d') AS publish_date, schedule_key, change_type FROM chg JOIN cal USING (o) WHERE o > 1 AND change_type IS NOT NULL"
P6_FIELDS = _DIFF + "SELECT strftime(cal.day, '%Y-%m-%d') AS publish_date, field, count(*) AS keys FROM (" + " UNION ALL ".join(
    f"SELECT c.o, '{f}' AS field FROM chg c JOIN k p ON p.schedule_key = c.schedule_key AND p.o = c.po JOIN k q ON q.schedule_key = c.schedule_key AND q.o = c.qo WHERE c.change_type = 'changed' AND p.{f} IS DISTINCT FROM q.{f}" for f in STATE_COLUMNS
) + ") JOIN cal USING (o) GROUP BY cal.day, field"


# -- 7 ---------------------------------------------------------------------------------------------------------------
def _stops(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "passenger_historical", "historical_source_row_id", "intermediate_stop_station_codes_iata")
    return packed.split_packed(rows, "historical_source_row_id", "intermediate_stop_station_codes_iata").select("historical_source_row_id", F.col("position").alias("stop_position"), F.col("value").alias("stop_code"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _stops(spark, d)


def p7_stations(spark: SparkSession, d: str) -> DataFrame:
    """How often each station is a stop, by position."""
    return _stops(spark, d).groupBy("stop_code", "stop_position").agg(F.count("*").alias("rows"))


_SPLIT = r"""WITH s AS (SELECT DISTINCT historical_source_row_id AS id, intermediate_stop_station_codes_iata AS f FROM passenger_historical WHERE historical_source_row_id IS NOT NULL AND intermediate_stop_station_codes_iata IS NOT NULL),
t AS (SELECT id, list_filter(list_transform(regexp_extract_all(f, '"[^"]*"|''[^'']*''|“[^”]*”|[A-Za-z0-9]+'), lambda x: trim(regexp_replace(upper(x), '^["''“]|["''”]$', '', 'g'))), lambda x: x <> '') AS v FROM s),
o AS (SELECT DISTINCT id AS historical_source_row_id, CAST(unnest(range(1, len(v) + 1)) AS INTEGER) AS stop_position, unnest(v) AS stop_code FROM t)
"""
P7_FOUND = _SPLIT + "SELECT * FROM o"
P7_STATIONS = _SPLIT + "SELECT stop_code, stop_position, count(*) AS rows FROM o GROUP BY stop_code, stop_position"

QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p2_found, p2_counts, p4_found, p4_attributes, p5_found, p5_attributes, p5_versions, p6_found, p6_fields, p7_found, p7_stations)}
SQL = {
    "p1_found": P1_FOUND, "p1_paths": P1_PATHS, "p1_descendants": P1_DESCENDANTS, "p2_found": P2_FOUND, "p2_counts": P2_COUNTS, "p4_found": P4_FOUND, "p4_attributes": P4_ATTRIBUTES, "p5_found": P5_FOUND,
    "p5_attributes": P5_ATTRIBUTES, "p5_versions": P5_VERSIONS,
    "p6_found": P6_FOUND, "p6_fields": P6_FIELDS, "p7_found": P7_FOUND, "p7_stations": P7_STATIONS,
}
