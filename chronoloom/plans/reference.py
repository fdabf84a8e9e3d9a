"""Queries of the engine's own operators over the whole test tables, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.canon import row_digest
from chronoloom.operators import flights, graph, resolve, snapshots, states, versioning
from chronoloom.plans.dealt import NO_STATION, STATE_COLUMNS, deliveries_of
from chronoloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its name, with its SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- Versions of aircraft dimensions ---------------------------------------------------------------------------------
ORDER = ["row_sequence_number", "event_sequence_number", "aircraft_history_id"]
DIMENSIONS = ["aircraft_status", "aircraft_type"]
DAYS = ["2026-02-15", "2026-03-15", "2026-04-15"]
BUCKETS = [("same day", 0), ("1-30 days", 30), ("31-90 days", 90), ("91-365 days", 365), ("longer", None)]


def _events(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "aircraft_dimension_daily_assignment")
    return a.select("dimension", F.col("aircraft_id").alias("entity"), F.col("valid_from").alias("day"), F.coalesce("aircraft_status_code", "aircraft_type_label").alias("value"), *ORDER, "existence_from", "existence_to").where("entity is not null and day is not null").distinct()


def _existence(events: DataFrame) -> DataFrame:
    return events.groupBy("entity").agg(F.min("existence_from").alias("existence_from"), F.min("existence_to").alias("existence_to"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return versioning.daily(_events(spark, d), ORDER, "existence_to")


_E = """WITH e AS (SELECT DISTINCT dimension, aircraft_id AS entity, valid_from AS day, coalesce(aircraft_status_code, aircraft_type_label) AS value, row_sequence_number, event_sequence_number, aircraft_history_id, existence_from, existence_to
 FROM aircraft_dimension_daily_assignment WHERE aircraft_id IS NOT NULL AND valid_from IS NOT NULL),
audit AS (SELECT *, row_number() OVER (PARTITION BY dimension, entity ORDER BY day, row_sequence_number NULLS LAST, event_sequence_number NULLS LAST, aircraft_history_id NULLS LAST) AS ordinal FROM (
 SELECT *, row_number() OVER w AS nth, lag(value) OVER w AS previous FROM e WINDOW w AS (PARTITION BY dimension, entity ORDER BY day, row_sequence_number NULLS LAST, event_sequence_number NULLS LAST, aircraft_history_id NULLS LAST)) WHERE nth = 1 OR value IS DISTINCT FROM previous),
lastday AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension, entity, day ORDER BY row_sequence_number DESC NULLS FIRST, event_sequence_number DESC NULLS FIRST, aircraft_history_id DESC NULLS FIRST) AS back FROM e) WHERE back = 1),
coal AS (SELECT * FROM (SELECT *, row_number() OVER w AS nth, lag(value) OVER w AS previous FROM lastday WINDOW w AS (PARTITION BY dimension, entity ORDER BY day)) WHERE nth = 1 OR value IS DISTINCT FROM previous),
daily AS (SELECT * FROM (SELECT dimension, entity, day AS valid_from, least(coalesce(lead(day) OVER (PARTITION BY dimension, entity ORDER BY day), DATE '9999-01-01'), coalesce(existence_to, DATE '9999-01-01')) AS valid_to, value FROM coal) WHERE valid_from < valid_to),
existence AS (SELECT entity, min(existence_from) AS existence_from, min(existence_to) AS existence_to FROM e GROUP BY entity)
"""


@query(_E + "SELECT dimension, entity, day, value, ordinal, aircraft_history_id FROM audit")
def audit_assignment(spark: SparkSession, d: str) -> DataFrame:
    return versioning.audit(_events(spark, d), ORDER).select("dimension", "entity", "day", "value", "ordinal", "aircraft_history_id")


@query(_E + "SELECT * FROM daily")
def daily_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d)


@query(
    _E
    + """SELECT x.entity, q.dimension, p.as_of, CASE WHEN NOT (existence_from <= as_of AND (existence_to IS NULL OR as_of < existence_to)) OR existence_from IS NULL THEN 'OUTSIDE_EXISTENCE' WHEN v.entity IS NULL THEN 'NO_RECORDED_STATE' WHEN v.value IS NULL THEN 'UNKNOWN_STATE' ELSE 'OK' END AS status,
 CASE WHEN existence_from <= as_of AND (existence_to IS NULL OR as_of < existence_to) THEN v.value END AS value
FROM existence x CROSS JOIN (VALUES ('aircraft_status'), ('aircraft_type')) q(dimension) CROSS JOIN (VALUES (DATE '2026-02-15'), (DATE '2026-03-15'), (DATE '2026-04-15')) p(as_of)
LEFT JOIN daily v ON v.entity = x.entity AND v.dimension = q.dimension AND v.valid_from <= p.as_of AND p.as_of < v.valid_to"""
)
def as_of_status(spark: SparkSession, d: str) -> DataFrame:
    return versioning.as_of_status(_versions(spark, d), _existence(_events(spark, d)), DIMENSIONS, DAYS)


_SPELLS = _E + """, n AS (SELECT *, lag(value) OVER w AS was, lead(value) OVER w AS nxt, lead(day) OVER w AS end_day FROM audit WINDOW w AS (PARTITION BY dimension, entity ORDER BY ordinal)),
spells AS (SELECT dimension, entity, day AS start_day, end_day, CAST(end_day - day AS INTEGER) AS days, end_day = day AS same_day, value AS state FROM n WHERE was = 'In Service' AND value IN ('Storage', 'Parked', 'Maintenance') AND nxt = 'In Service')
"""


def _spells(spark: SparkSession, d: str) -> DataFrame:
    return versioning.reversion_spells(versioning.audit(_events(spark, d), ORDER).select("dimension", "entity", "day", "value", *ORDER), ORDER, "In Service", ["Storage", "Parked", "Maintenance"])


@query(_SPELLS + "SELECT * FROM spells")
def reversion_spells(spark: SparkSession, d: str) -> DataFrame:
    return _spells(spark, d)


@query(
    _SPELLS
    + """SELECT b.bucket_order, b.bucket, count(s.days) AS n, round(count(s.days) / (SELECT count(*) FROM spells), 6) AS share
FROM (VALUES (0, 'same day', -1, 0), (1, '1-30 days', 0, 30), (2, '31-90 days', 30, 90), (3, '91-365 days', 90, 365), (4, 'longer', 365, 999999)) b(bucket_order, bucket, lo, hi) LEFT JOIN spells s ON s.days > b.lo AND s.days <= b.hi GROUP BY ALL"""
)
def spell_distribution(spark: SparkSession, d: str) -> DataFrame:
    return versioning.distribution(_spells(spark, d), "days", BUCKETS)


_MONTHS = _E + """, cal AS (SELECT last_day(CAST(m AS DATE)) AS month_end FROM generate_series(DATE '2025-01-01', DATE '2026-04-01', INTERVAL 1 MONTH) g(m)),
comp AS (SELECT cal.month_end, t.value AS label, count(DISTINCT t.entity) AS entities FROM cal JOIN daily s ON s.dimension = 'aircraft_status' AND s.value = 'In Service' AND s.valid_from <= month_end AND month_end < s.valid_to
 JOIN daily t ON t.dimension = 'aircraft_type' AND t.entity = s.entity AND t.valid_from <= month_end AND month_end < t.valid_to GROUP BY ALL)
"""


def _composition(spark: SparkSession, d: str) -> DataFrame:
    return versioning.composition(_versions(spark, d), "aircraft_type", ("aircraft_status", "In Service"), "2025-01-01", "2026-04-01")


@query(_MONTHS + "SELECT * FROM comp")
def month_end_composition(spark: SparkSession, d: str) -> DataFrame:
    return _composition(spark, d)


@query(_MONTHS + "SELECT label, count(*) AS months, min(entities) AS least, max(entities) AS most, round(avg(entities), 4) AS mean, median(entities) AS median FROM comp GROUP BY label")
def composition_summary(spark: SparkSession, d: str) -> DataFrame:
    return _composition(spark, d).groupBy("label").agg(F.count("*").alias("months"), F.min("entities").alias("least"), F.max("entities").alias("most"), F.round(F.avg("entities"), 4).alias("mean"), F.median("entities").alias("median"))


@query("WITH long AS (" + _MONTHS + "SELECT * FROM comp) SELECT * FROM (PIVOT long ON label USING coalesce(sum(entities), 0)::BIGINT GROUP BY month_end)")
def composition_pivot(spark: SparkSession, d: str) -> DataFrame:
    """One column for every label found; labels are a code list."""
    return _composition(spark, d).where("label is not null").groupBy("month_end").pivot("label").agg(F.sum("entities")).na.fill(0)


@query(_E + "SELECT *, lag(value) OVER w AS previous, CASE WHEN dimension <> 'aircraft_type' THEN NULL WHEN lag(value) OVER w IS NULL THEN false ELSE value IS DISTINCT FROM lag(value) OVER w END AS is_change FROM daily WINDOW w AS (PARTITION BY dimension, entity ORDER BY valid_from)")
def independent_histories(spark: SparkSession, d: str) -> DataFrame:
    return versioning.with_previous(_versions(spark, d), ["aircraft_type"])


@query(_E + ", n AS (SELECT dimension, entity, day, aircraft_history_id, value FROM audit), s AS (SELECT entity, value AS status, valid_from AS sf, valid_to AS st FROM daily WHERE dimension = 'aircraft_status') SELECT n.entity, n.day, n.value AS type_label, s.status FROM n JOIN s ON s.entity = n.entity AND s.sf <= n.day AND n.day < s.st WHERE n.dimension = 'aircraft_type'")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Type changes with the status in force on their day: a half-open interval join on the entity."""
    n = versioning.audit(_events(spark, d), ORDER).where("dimension = 'aircraft_type'").select("entity", "day", F.col("value").alias("type_label"))
    s = _versions(spark, d).where("dimension = 'aircraft_status'").select("entity", F.col("value").alias("status"), "valid_from", "valid_to")
    return n.join(s, "entity").where("valid_from <= day and day < valid_to").select("entity", "day", "type_label", "status")


# -- References ------------------------------------------------------------------------------------------------------
@query("SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY airport_id ORDER BY effective_start_date DESC, coalesce(effective_end_date, DATE '9999-01-01') DESC, airport_name) AS n FROM airport_reference) WHERE n = 1")
def airport_current(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "airport_reference")
    return resolve.first_row(a, ["airport_id"], [F.col("effective_start_date").desc(), F.coalesce("effective_end_date", F.lit("9999-01-01").cast("date")).desc(), F.col("airport_name")])


_METHODS = {"IATA": "carrier_code_iata", "ICAO": "carrier_code_icao", "ID": "airline_id"}
_CLAIMS = """WITH claims AS (SELECT 'IATA' AS method, carrier_code_iata AS code, airline_id AS id FROM airline_reference UNION SELECT 'ICAO', carrier_code_icao, airline_id FROM airline_reference UNION SELECT 'ID', airline_id, airline_id FROM airline_reference),
outcomes AS (SELECT method, code, count(DISTINCT id) AS n, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM claims WHERE code IS NOT NULL GROUP BY method, code)
"""


@query(_CLAIMS + "SELECT * FROM outcomes")
def code_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolve.outcomes(resolve.candidates(table(spark, d, "airline_reference"), "airline_id", _METHODS))


@query(_CLAIMS + """SELECT m.method, CASE WHEN c IS NULL OR trim(c) = '' THEN 'INVALID_INPUT' WHEN o.code IS NULL THEN 'UNRESOLVED' WHEN o.n = 1 THEN 'EXACT' ELSE 'AMBIGUOUS' END AS status, count(*) AS rows, count(DISTINCT c) AS codes
FROM (SELECT operating_carrier_internal AS c FROM passenger_historical) p CROSS JOIN (VALUES ('IATA'), ('ICAO'), ('ID')) m(method) LEFT JOIN outcomes o ON o.method = m.method AND o.code = p.c GROUP BY 1, 2""")
def carrier_resolution(spark: SparkSession, d: str) -> DataFrame:
    """How carriers resolve by each method; a column may hold codes of all."""
    out = resolve.outcomes(resolve.candidates(table(spark, d, "airline_reference"), "airline_id", _METHODS))
    codes = table(spark, d, "passenger_historical").groupBy(F.col("operating_carrier_internal").alias("c")).agg(F.count("*").alias("rows"))  # once for all methods
    each = [resolve.resolve(codes, "c", out, m, "airline").select(F.lit(m).alias("method"), F.col("airline_status").alias("status"), "c", "rows") for m in _METHODS]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("method", "status").agg(F.sum("rows").alias("rows"), F.count("c").alias("codes"))


@query("SELECT aircraft_code_iata, count(DISTINCT (coalesce(aircraft_family, chr(1)), coalesce(aircraft_type, chr(1)))) AS definitions, CASE WHEN count(DISTINCT (coalesce(aircraft_family, chr(1)), coalesce(aircraft_type, chr(1)))) = 1 THEN min(aircraft_family) END AS aircraft_family, CASE WHEN count(DISTINCT (coalesce(aircraft_family, chr(1)), coalesce(aircraft_type, chr(1)))) = 1 THEN min(aircraft_type) END AS aircraft_type FROM aircraft_flight WHERE aircraft_code_iata IS NOT NULL GROUP BY 1")
def type_definition(spark: SparkSession, d: str) -> DataFrame:
    return resolve.definition(table(spark, d, "aircraft_flight", "aircraft_code_iata", "aircraft_family", "aircraft_type"), "aircraft_code_iata", ["aircraft_family", "aircraft_type"])


@query("SELECT flight_id, count(*) AS rows FROM aircraft_flight WHERE flight_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_flights(spark: SparkSession, d: str) -> DataFrame:
    return resolve.violations(table(spark, d, "aircraft_flight", "flight_id").where("flight_id is not null"), ["flight_id"])


def _frame_sql(name: str, text: str) -> str:
    return f"'{len(name)}:{name}' || CASE WHEN {text} IS NULL THEN 'N' ELSE 'V' || strlen({text}) || ':' || {text} END"


_HASHED = {"airline_id": "airline_id", "effective_start_date": "strftime(effective_start_date, '%Y-%m-%d')", "carrier_code_icao": "carrier_code_icao", "carrier_full_name": "carrier_full_name", "is_active": "CAST(is_active AS VARCHAR)"}
_ROW_HASH = "sha256(" + " || ".join(_frame_sql(n, t) for n, t in _HASHED.items()) + ")"


@query(f"SELECT airline_id, effective_start_date, {_ROW_HASH} AS row_hash FROM airline_reference")
def typed_row_hash(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "airline_reference")
    return a.select("airline_id", "effective_start_date", row_digest(a.schema, *_HASHED).alias("row_hash"))


@query(f"SELECT count(*) AS rows, sha256(string_agg(h, '' ORDER BY h)) AS content_hash FROM (SELECT {_ROW_HASH} AS h FROM airline_reference)")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """A multiset digest of a reference table; large tables are compared by `sources.files.fingerprint`, which needs no sort."""
    a = table(spark, d, "airline_reference")
    return a.select(row_digest(a.schema, *_HASHED).alias("h")).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("content_hash"))


@query("SELECT CAST(last_day(CAST(m AS DATE)) AS DATE) AS month_end, year(m)::INTEGER AS year, month(m)::INTEGER AS month FROM generate_series(DATE '2000-01-01', DATE '2049-12-01', INTERVAL 1 MONTH) g(m)")
def month_end_calendar(spark: SparkSession, d: str) -> DataFrame:
    m = spark.range(1).select(F.explode(versioning.month_ends("2000-01-01", "2049-12-01")).alias("month_end"))
    return m.select("month_end", F.year("month_end").alias("year"), F.month("month_end").alias("month"))


# -- Snapshots and states --------------------------------------------------------------------------------------------
CONTENT = STATE_COLUMNS
_SIGN = ["marketing_carrier_internal", "departure_station_code_iata", "arrival_station_code_iata"]


def _observed(spark: SparkSession, d: str, *more: str) -> DataFrame:
    rows = table(spark, d, "schedule_snapshot")
    order = [*snapshots.ranking("weekly_frequency", True), *snapshots.ranking("total_seats", True), *snapshots.ranking("itinerary_variation_identifier"), *snapshots.ranking("normalized_row_hash")]
    return snapshots.canonical(rows, deliveries_of(spark, d), "schedule_key", "publish_date", order, [*CONTENT, *more])


_COLS = ", ".join(CONTENT)
_OBS = """WITH days AS (SELECT DISTINCT expected_publish_date AS day FROM schedule_snapshot_calendar WHERE is_present AND is_complete),
cal AS (SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS o FROM days),
obs AS (SELECT * FROM (SELECT s.*, s.schedule_key AS key, cal.o AS ord, row_number() OVER (PARTITION BY schedule_key, publish_date ORDER BY weekly_frequency DESC NULLS LAST, total_seats DESC NULLS LAST, itinerary_variation_identifier NULLS LAST, normalized_row_hash NULLS LAST) AS n
 FROM schedule_snapshot s JOIN cal ON cal.day = s.publish_date WHERE schedule_key IS NOT NULL) WHERE n = 1)
"""
_STATES = (
    _OBS
    + f""", good AS (SELECT * FROM obs WHERE NOT ({NO_STATION})),
a AS (SELECT *, lag(ord) OVER w AS po, lag(row({_COLS})) OVER w AS pr, row({_COLS}) AS r FROM good WINDOW w AS (PARTITION BY key ORDER BY ord)),
b AS (SELECT *, CASE WHEN po IS NULL THEN 'INITIAL' WHEN po <> ord - 1 THEN 'REAPPEARANCE' WHEN r IS DISTINCT FROM pr THEN 'CONTENT_CHANGE' END AS kind FROM a),
c AS (SELECT *, max(CASE WHEN kind IS NOT NULL THEN ord END) OVER (PARTITION BY key ORDER BY ord) AS open_ord FROM b),
g AS (SELECT key, open_ord, max(ord) AS last, count(*) AS seen, max(kind) AS open_kind FROM c GROUP BY key, open_ord),
st AS (SELECT key, open_ord, CASE WHEN last < (SELECT max(o) FROM cal) THEN last + 1 END AS close_ord, open_kind,
 CASE WHEN lead(open_ord) OVER (PARTITION BY key ORDER BY open_ord) = last + 1 THEN 'CONTENT_CHANGE' WHEN last < (SELECT max(o) FROM cal) THEN 'ABSENCE' ELSE 'OPEN' END AS close_kind, seen FROM g)
"""
)


def _good(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return _observed(spark, d, *more).where(f"not ({NO_STATION})")


def _states(spark: SparkSession, d: str) -> DataFrame:
    return states.states(_good(spark, d), CONTENT, deliveries_of(spark, d).count())


@query(_OBS + "SELECT key, ord, weekly_frequency, total_seats, normalized_row_hash FROM obs")
def canonical_observation(spark: SparkSession, d: str) -> DataFrame:
    return _observed(spark, d, "normalized_row_hash").select("key", "ord", "weekly_frequency", "total_seats", "normalized_row_hash")


@query("SELECT expected_publish_date AS day, CASE WHEN NOT is_present THEN 'ENDPOINT_MISSING' WHEN NOT is_complete THEN 'ENDPOINT_INCOMPLETE' ELSE 'ELIGIBLE' END AS status FROM schedule_snapshot_calendar")
def endpoint_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "schedule_snapshot_calendar").select(F.col("expected_publish_date").alias("day"), F.when(~F.col("is_present"), "ENDPOINT_MISSING").when(~F.col("is_complete"), "ENDPOINT_INCOMPLETE").otherwise("ELIGIBLE").alias("status"))


@query(_STATES + "SELECT * FROM st")
def route_states(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("key", "open_ord", "close_ord", "open_kind", "close_kind", "seen")


@query(_STATES + "SELECT key, open_ord, ord, normalized_row_hash FROM c")
def state_lineage(spark: SparkSession, d: str) -> DataFrame:
    return states.lineage(_good(spark, d, "normalized_row_hash"), CONTENT, "normalized_row_hash")


@query(_OBS + "SELECT departure_station_code_iata AS departure, arrival_station_code_iata AS arrival, (departure_station_code_iata IS NOT NULL AND arrival_station_code_iata IS NOT NULL) AS complete, count(*) AS observations, count(DISTINCT key) AS keys FROM obs GROUP BY 1, 2, 3")
def routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes with how often they were observed; those that lack a station are kept and told apart."""
    ends = F.col("departure_station_code_iata"), F.col("arrival_station_code_iata")
    return _observed(spark, d).groupBy(ends[0].alias("departure"), ends[1].alias("arrival"), (ends[0].isNotNull() & ends[1].isNotNull()).alias("complete")).agg(F.count("*").alias("observations"), F.countDistinct("key").alias("keys"))


@query(_OBS + "SELECT y.o AS ord, x.day AS earlier, y.day AS later, (SELECT count(*) FROM schedule_snapshot_calendar c WHERE c.expected_publish_date > x.day AND c.expected_publish_date < y.day) AS skipped, CAST(y.day - x.day AS INTEGER) AS days FROM cal x JOIN cal y ON y.o = x.o + 1")
def snapshot_comparisons(spark: SparkSession, d: str) -> DataFrame:
    return states.comparisons(deliveries_of(spark, d), table(spark, d, "schedule_snapshot_calendar").select(F.col("expected_publish_date").alias("expected")))


def _sides(spark: SparkSession, d: str) -> DataFrame:
    return states.presence_sides(_observed(spark, d), deliveries_of(spark, d).count(), _SIGN, "effective_date", "discontinue_date")


_S = ", ".join(_SIGN)
_SIDES = (
    _OBS
    + f""", sides AS (SELECT y.ord, y.key, 'added' AS side, {", ".join("y." + c for c in _SIGN)}, y.effective_date AS f, y.discontinue_date AS l FROM obs y WHERE y.ord > 0 AND NOT EXISTS (SELECT 1 FROM obs x WHERE x.key = y.key AND x.ord = y.ord - 1)
 UNION ALL SELECT x.ord + 1, x.key, 'removed', {", ".join("x." + c for c in _SIGN)}, x.effective_date, x.discontinue_date FROM obs x WHERE x.ord < (SELECT max(o) FROM cal) AND NOT EXISTS (SELECT 1 FROM obs y WHERE y.key = x.key AND y.ord = x.ord + 1)),
pairs AS (SELECT r.ord, {", ".join("r." + c for c in _SIGN)}, r.key AS removed_key, a.key AS added_key FROM sides r JOIN sides a ON r.side = 'removed' AND a.side = 'added' AND r.ord = a.ord AND {" AND ".join(f"r.{c} = a.{c}" for c in _SIGN)} AND r.f <= a.l AND a.f <= r.l),
counted AS (SELECT *, count(*) OVER (PARTITION BY ord, removed_key) AS partners_removed, count(*) OVER (PARTITION BY ord, added_key) AS partners_added FROM pairs)
"""
)


@query(_SIDES + "SELECT ord, removed_key, added_key, CASE WHEN partners_removed = 1 AND partners_added = 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM counted")
def amendment_candidates(spark: SparkSession, d: str) -> DataFrame:
    pairs = states.amendments(_sides(spark, d), _SIGN)
    return pairs.select("ord", "removed_key", "added_key", F.when((F.col("partners_removed") == 1) & (F.col("partners_added") == 1), "MEDIUM").otherwise("LOW").alias("confidence"))


@query(_SIDES + f"SELECT ord, {_S}, count(DISTINCT removed_key) + count(DISTINCT added_key) AS members, string_agg(DISTINCT removed_key, ',' ORDER BY removed_key) AS removed, string_agg(DISTINCT added_key, ',' ORDER BY added_key) AS added FROM counted WHERE partners_removed > 1 OR partners_added > 1 GROUP BY ALL")
def ambiguous_amendments(spark: SparkSession, d: str) -> DataFrame:
    return states.ambiguous_groups(states.amendments(_sides(spark, d), _SIGN), _SIGN)


@query(_SIDES + "SELECT s.ord, s.key, s.side FROM sides s WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.ord = s.ord AND s.key IN (p.removed_key, p.added_key))")
def unpaired_amendments(spark: SparkSession, d: str) -> DataFrame:
    sides = _sides(spark, d)
    return states.unpaired(sides, states.amendments(sides, _SIGN)).select("ord", "key", "side")


_MARKET = ["marketing_carrier_internal", "departure_station_code_iata", "arrival_station_code_iata"]
_M = ", ".join(_MARKET)


@query(
    _OBS
    + f""", per AS (SELECT ord, {_M}, count(DISTINCT key) AS keys FROM obs WHERE NOT ({NO_STATION}) AND marketing_carrier_internal IS NOT NULL GROUP BY ord, {_M})
SELECT ord, {_M}, 'ENTRY' AS kind, keys FROM per p WHERE ord > 0 AND NOT EXISTS (SELECT 1 FROM per q WHERE q.ord = p.ord - 1 AND {" AND ".join(f"q.{c} = p.{c}" for c in _MARKET)})
UNION ALL SELECT ord + 1, {_M}, 'EXIT', keys FROM per p WHERE ord < (SELECT max(o) FROM cal) AND NOT EXISTS (SELECT 1 FROM per q WHERE q.ord = p.ord + 1 AND {" AND ".join(f"q.{c} = p.{c}" for c in _MARKET)})"""
)
def market_entries_exits(spark: SparkSession, d: str) -> DataFrame:
    """Entries and exits of all consecutive deliveries; the engine's question answers for any two."""
    return states.consecutive_entries_and_exits(_observed(spark, d), _MARKET, deliveries_of(spark, d).count())


@query(_OBS + f"SELECT ord, count(DISTINCT ({_M})) AS markets FROM obs WHERE NOT ({NO_STATION}) GROUP BY ord")
def market_count(spark: SparkSession, d: str) -> DataFrame:
    return _good(spark, d).groupBy("ord").agg(F.countDistinct(*_MARKET).alias("markets"))


KNOWN, FLYING = "2026-05-13", "2026-06-10"
_WEEK = ["is_operating_monday", "is_operating_tuesday", "is_operating_wednesday", "is_operating_thursday", "is_operating_friday", "is_operating_saturday", "is_operating_sunday"]


def _dated(spark: SparkSession, d: str) -> DataFrame:
    days = deliveries_of(spark, d)
    s = _states(spark, d)
    return s.join(F.broadcast(days.select(F.col("ord").alias("open_ord"), F.col("day").alias("valid_from"))), "open_ord").join(F.broadcast(days.select(F.col("ord").alias("close_ord"), F.col("day").alias("valid_to"))), "close_ord", "left")


_DATED = _STATES + ", dated AS (SELECT st.*, c.* EXCLUDE (key, open_ord), x.day AS valid_from, y.day AS valid_to FROM st JOIN c ON c.key = st.key AND c.ord = st.open_ord JOIN cal x ON x.o = st.open_ord LEFT JOIN cal y ON y.o = st.close_ord)\n"


@query(_DATED + f"""SELECT {_M}, count(*) AS schedules, sum(weekly_frequency)::BIGINT AS weekly_frequency, sum(CASE WHEN total_seats IS NULL THEN 0 ELSE weekly_frequency * total_seats END) AS weekly_seats, bool_and(total_seats IS NOT NULL) AS all_seats_known
FROM dated WHERE valid_from <= DATE '{KNOWN}' AND (valid_to IS NULL OR DATE '{KNOWN}' < valid_to) AND effective_date <= DATE '{FLYING}' AND DATE '{FLYING}' <= discontinue_date AND is_operating_wednesday GROUP BY {_M}""")
def two_clock_capacity(spark: SparkSession, d: str) -> DataFrame:
    return states.capacity(_dated(spark, d), KNOWN, FLYING, _MARKET, _WEEK, "weekly_frequency", "total_seats", "effective_date", "discontinue_date")


@query(_DATED + """SELECT k.place AS knowledge, p.place AS operating, count(*) AS states, count(*) FILTER (k.place = 'INSIDE' AND p.place <> 'BEFORE') AS eligible FROM dated d
CROSS JOIN (VALUES ('BEFORE'), ('INSIDE'), ('AT_END')) k(place) CROSS JOIN (VALUES ('BEFORE'), ('INSIDE'), ('AT_END')) p(place) WHERE valid_to IS NOT NULL AND effective_date <= discontinue_date GROUP BY 1, 2""")
def both_clocks(spark: SparkSession, d: str) -> DataFrame:
    """For each closed state, days before, in and at the end of both clocks; only two of the nine combinations are eligible."""
    from chronoloom.functions.intervals import operates_within, visible_on

    s = _dated(spark, d).where("valid_to is not null and effective_date <= discontinue_date")
    c = states.both_clocks(F.col("valid_from"), F.col("valid_to"), F.col("effective_date"), F.col("discontinue_date"))
    x = s.withColumn("k", F.explode(c["knowledge"])).withColumn("p", F.explode(c["operating"]))
    ok = visible_on(F.col("valid_from"), F.col("valid_to"), F.col("k.day")) & operates_within(F.col("effective_date"), F.col("discontinue_date"), F.col("p.day"))
    return x.groupBy(F.col("k.at").alias("knowledge"), F.col("p.at").alias("operating")).agg(F.count("*").alias("states"), F.count_if(ok).alias("eligible"))


_CABINS = ["first_class_seats", "business_class_seats", "economy_class_seats"]


@query(_OBS + """SELECT all_known, none_negative, adds_up, included_fits, count(*) AS rows FROM (SELECT total_seats IS NOT NULL AND first_class_seats IS NOT NULL AND business_class_seats IS NOT NULL AND economy_class_seats IS NOT NULL AND premium_economy_seats IS NOT NULL AS all_known,
 least(total_seats, first_class_seats, business_class_seats, economy_class_seats, premium_economy_seats) >= 0 AS none_negative, first_class_seats + business_class_seats + economy_class_seats = total_seats AS adds_up, premium_economy_seats <= economy_class_seats AS included_fits FROM obs) GROUP BY ALL""")
def measure_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Observations by what holds of their seats; premium economy is included in economy."""
    return _observed(spark, d).groupBy(*states.part_facts("total_seats", _CABINS, "premium_economy_seats", "economy_class_seats")).agg(F.count("*").alias("rows"))


# -- Flights and plans -----------------------------------------------------------------------------------------------
def _actual(spark: SparkSession, d: str) -> DataFrame:
    return flights.actual(table(spark, d, "aircraft_flight"))


_FLIGHT_COLS = "aircraft_id, operating_carrier_code, marketing_carrier_code, flight_number, flight_departure_date, flight_departure_date_utc, departure_airport_code, arrival_airport_code, diverted_airport_code, is_cancelled, is_diverted, actual_gate_departure_time_utc, actual_gate_arrival_time_utc, actual_gate_departure_time_local, actual_gate_arrival_time_local, aircraft_type, aircraft_code_iata, aircraft_family, next_flight_id"
_LEGS = f"""WITH legs AS (SELECT *, CASE WHEN regexp_full_match(flight_number, '[0-9]+') THEN TRY_CAST(flight_number AS BIGINT) END AS number, CASE is_cancelled WHEN 0 THEN false WHEN 1 THEN true END AS cancelled, coalesce(diverted_airport_code, arrival_airport_code) AS continuity_code,
 (CASE is_diverted WHEN 0 THEN false WHEN 1 THEN true END) = (diverted_airport_code IS NOT NULL) AS diversion_agrees
FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY {" + ".join(f"(CASE WHEN {c.strip()} IS NULL THEN 0 ELSE 1 END)" for c in _FLIGHT_COLS.split(","))} DESC, {", ".join(c.strip() + " NULLS LAST" for c in _FLIGHT_COLS.split(","))}) AS n FROM aircraft_flight WHERE flight_id IS NOT NULL) WHERE n = 1),
facts AS (SELECT l.flight_id, l.next_flight_id AS target, NOT l.cancelled AS flown, l.actual_gate_departure_time_utc IS NOT NULL AND l.actual_gate_arrival_time_utc IS NOT NULL AS timed, l.next_flight_id <> l.flight_id AS names_other, t.flight_id IS NOT NULL AS target_exists,
 NOT t.cancelled AS target_flown, t.aircraft_id = l.aircraft_id AS same_aircraft, t.flight_departure_date = l.flight_departure_date AS same_day, t.actual_gate_departure_time_utc >= l.actual_gate_arrival_time_utc AS in_order, t.departure_airport_code = l.continuity_code AS connects
 FROM legs l LEFT JOIN legs t ON t.flight_id = l.next_flight_id WHERE l.next_flight_id IS NOT NULL),
outcome AS (SELECT *, coalesce(flown AND timed AND names_other AND target_exists AND target_flown AND same_aircraft AND same_day AND in_order AND connects, false) AS holds FROM facts)
"""


@query(_LEGS + "SELECT flight_id, number, cancelled, diversion_agrees, continuity_code FROM legs")
def actual_flights(spark: SparkSession, d: str) -> DataFrame:
    return _actual(spark, d).select("flight_id", "number", "cancelled", "diversion_agrees", "continuity_code")


@query(_LEGS + "SELECT * FROM outcome")
def rotation_links(spark: SparkSession, d: str) -> DataFrame:
    return flights.link_facts(_actual(spark, d))


@query(_LEGS + """, ok AS (SELECT flight_id, target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY flight_id) AS n FROM outcome WHERE holds) WHERE n = 1),
nodes AS (SELECT flight_id AS n FROM ok UNION SELECT target FROM ok),
heads AS (SELECT n FROM nodes WHERE n NOT IN (SELECT target FROM ok)),
chain AS (WITH RECURSIVE c(flight_id, head, position) AS (SELECT n, n, 1 FROM heads UNION ALL SELECT ok.target, c.head, c.position + 1 FROM c JOIN ok ON ok.flight_id = c.flight_id) SELECT * FROM c)
SELECT flight_id, head, CAST(position AS BIGINT) AS position FROM chain""")
def rotation_chains(spark: SparkSession, d: str) -> DataFrame:
    """Places in chains of links of which all facts hold, from 1 at the head; a target of several links is taken by the smallest."""
    ok = flights.link_facts(_actual(spark, d)).where("holds")
    both = ok.select("flight_id", "target").unionByName(ok.select(F.col("target").alias("flight_id"), F.lit(None).cast("long").alias("target")))
    return graph.chains(both, "flight_id", "target")


@query(_LEGS + f"SELECT {', '.join(flights.FACTS)}, count(*) AS links, count(DISTINCT target) AS targets FROM outcome GROUP BY ALL")
def rotation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Links by what is known about them."""
    return flights.link_facts(_actual(spark, d)).groupBy(*flights.FACTS).agg(F.count("*").alias("links"), F.countDistinct("target").alias("targets"))


@query("""SELECT historical_source_row_id, operating_date, CAST(operating_date AS TIMESTAMP) + CAST(passenger_departure_local_time AS INTERVAL) - to_minutes(CAST(departure_utc_offset_minutes AS BIGINT)) AS departure_utc,
 CAST(operating_date + CAST(arrival_day_indicator AS INTEGER) AS TIMESTAMP) + CAST(passenger_arrival_local_time AS INTERVAL) - to_minutes(CAST(arrival_utc_offset_minutes AS BIGINT)) AS arrival_utc,
 CASE WHEN operating_date IS NULL OR passenger_departure_local_time IS NULL THEN 'NO_LOCAL_TIME' WHEN departure_utc_offset_minutes IS NULL THEN 'UNRESOLVED_UTC_DATE' ELSE 'OFFSET_DERIVED' END AS utc_status FROM passenger_historical""")
def utc_derivation(spark: SparkSession, d: str) -> DataFrame:
    return flights.with_utc(table(spark, d, "passenger_historical")).select("historical_source_row_id", "operating_date", "departure_utc", "arrival_utc", "utc_status")


_K = flights.PASSENGER_KEY
_CLEAN = ", ".join(f"nullif(upper(trim({c})), '') AS {c}" if c not in ("flight_number", "operating_date") else c for c in _K)
_PASS = f"""WITH clean AS (SELECT historical_source_row_id, publish_date, {_CLEAN} FROM passenger_historical),
st AS (SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _K)}) AS missing FROM clean)
"""


@query(_PASS + f"SELECT * EXCLUDE (nth, missing) FROM (SELECT {', '.join(_K)}, historical_source_row_id, publish_date, missing, count(*) OVER w AS rows, CAST(count(DISTINCT historical_source_row_id) OVER w AS INTEGER) AS ids, row_number() OVER (PARTITION BY {', '.join(_K)} ORDER BY publish_date DESC NULLS LAST, historical_source_row_id NULLS LAST) AS nth FROM st WHERE missing = '' WINDOW w AS (PARTITION BY {', '.join(_K)})) WHERE nth = 1")
def passenger_canonical(spark: SparkSession, d: str) -> DataFrame:
    return flights.passenger_canonical(flights.passenger_status(table(spark, d, "passenger_historical")))


@query(_PASS + "SELECT CASE WHEN historical_source_row_id IS NULL THEN 'QUARANTINED' ELSE 'INVALID_KEY' END AS reason, missing, count(*) AS occurrences FROM st WHERE missing <> '' GROUP BY 1, 2")
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    return flights.quarantine(flights.passenger_status(table(spark, d, "passenger_historical")))


def _compatible(spark: SparkSession, d: str) -> DataFrame:
    iata = table(spark, d, "airport_reference").groupBy("airport_id").agg(F.min("airport_code_iata").alias("iata"))
    at = lambda c, o: F.broadcast(iata.select(F.col("airport_id").alias(c), F.col("iata").alias(o)))
    legs = _actual(spark, d).join(at("departure_airport_code", "origin"), "departure_airport_code").join(at("arrival_airport_code", "destination"), "arrival_airport_code")
    return flights.compatibility(flights.planned_legs(table(spark, d, "passenger_historical")), legs)


_PLANNED = r"""plan AS (SELECT * FROM (SELECT historical_source_row_id AS id, operating_date, flight_number, upper(trim(departure_station_code_iata)) AS dep, upper(trim(arrival_station_code_iata)) AS arr, intermediate_stop_station_codes_iata AS f,
 row_number() OVER (PARTITION BY historical_source_row_id ORDER BY publish_date DESC NULLS LAST, departure_station_code_iata NULLS LAST, arrival_station_code_iata NULLS LAST, intermediate_stop_station_codes_iata NULLS LAST) AS n FROM passenger_historical WHERE historical_source_row_id IS NOT NULL) WHERE n = 1),
route AS (SELECT id, operating_date, flight_number, list_concat(list_concat([dep], coalesce(list_filter(list_transform(regexp_extract_all(f, '"[^"]*"|''[^'']*''|“[^”]*”|[A-Za-z0-9]+'), lambda x: trim(regexp_replace(upper(x), '^["''“]|["''”]$', '', 'g'))), lambda x: x <> ''), [])), [arr]) AS r FROM plan),
planned AS (SELECT id AS historical_source_row_id, operating_date, flight_number, CAST(i AS INTEGER) AS leg_index, CAST(len(r) - 1 AS INTEGER) AS legs, r[i] AS origin, r[i + 1] AS destination FROM (SELECT *, unnest(range(1, len(r))) AS i FROM route))
"""
_COMPAT = _LEGS + ", " + _PLANNED + """, iata AS (SELECT airport_id, min(airport_code_iata) AS iata FROM airport_reference GROUP BY 1),
compat AS (SELECT l.flight_id, p.historical_source_row_id, p.leg_index FROM planned p JOIN legs l ON l.flight_departure_date = p.operating_date AND l.number = p.flight_number JOIN iata x ON x.airport_id = l.departure_airport_code AND x.iata = p.origin JOIN iata y ON y.airport_id = l.arrival_airport_code AND y.iata = p.destination)
"""


@query("WITH " + _PLANNED + "SELECT * FROM planned")
def planned_legs(spark: SparkSession, d: str) -> DataFrame:
    return flights.planned_legs(table(spark, d, "passenger_historical"))


@query(_COMPAT + "SELECT * FROM compat")
def fulfilment_compatibility(spark: SparkSession, d: str) -> DataFrame:
    return _compatible(spark, d)


@query(_COMPAT + "SELECT flight_id, historical_source_row_id FROM compat GROUP BY ALL HAVING flight_id IN (SELECT flight_id FROM compat GROUP BY 1 HAVING count(DISTINCT historical_source_row_id) = 1) AND historical_source_row_id IN (SELECT historical_source_row_id FROM compat GROUP BY 1 HAVING count(DISTINCT flight_id) = 1)")
def fulfilment_candidates(spark: SparkSession, d: str) -> DataFrame:
    return flights.one_to_one(_compatible(spark, d), "flight_id", "historical_source_row_id")


@query(_COMPAT + "SELECT count(*) AS legs FROM legs WHERE flight_id NOT IN (SELECT flight_id FROM compat)")
def unmatched_legs(spark: SparkSession, d: str) -> DataFrame:
    return _actual(spark, d).join(_compatible(spark, d), "flight_id", "left_anti").agg(F.count("*").alias("legs"))


@query(_COMPAT + """, e AS (SELECT flight_id AS a, historical_source_row_id AS b FROM compat UNION SELECT historical_source_row_id, flight_id FROM compat),
reach AS (WITH RECURSIVE r(n, m) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m) SELECT n, min(m) AS component FROM r GROUP BY n)
SELECT n AS node, component FROM reach""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the graph of compatible legs and plan rows, whose ids lie in separate ranges."""
    return graph.components(_compatible(spark, d), "flight_id", "historical_source_row_id")


# -- Further derivations ---------------------------------------------------------------------------------------------
@query("SELECT CASE WHEN valid_to IS NULL THEN 'MISSING' WHEN valid_to = DATE '9999-12-31' THEN 'UNKNOWN_FUTURE' WHEN valid_to = DATE '9999-01-01' THEN 'OPEN' WHEN year(valid_to) >= 9999 THEN 'OTHER_9999' ELSE 'CLOSED' END AS kind, count(*) AS rows FROM aircraft_dimension_daily_assignment GROUP BY 1")
def sentinel_dates(spark: SparkSession, d: str) -> DataFrame:
    """How ends of intervals are written; the two sentinels are never taken for each other."""
    from chronoloom.functions.canon import OPEN_END, UNKNOWN_FUTURE

    is_day = lambda x: F.col("valid_to") == F.lit(x).cast("date")
    kind = F.when(F.col("valid_to").isNull(), "MISSING").when(is_day(UNKNOWN_FUTURE), "UNKNOWN_FUTURE").when(is_day(OPEN_END), "OPEN").when(F.year("valid_to") >= 9999, "OTHER_9999").otherwise("CLOSED")
    return table(spark, d, "aircraft_dimension_daily_assignment", "valid_to").groupBy(kind.alias("kind")).agg(F.count("*").alias("rows"))


@query(_E + "SELECT dimension, entity, day AS valid_from, declared_to, derived_to FROM (SELECT x.dimension, x.entity, x.day, x.declared_to, lead(x.day) OVER (PARTITION BY x.dimension, x.entity ORDER BY x.day) AS derived_to FROM (SELECT l.*, (SELECT max(valid_to) FROM aircraft_dimension_daily_assignment a WHERE a.aircraft_id = l.entity AND a.dimension = l.dimension AND a.aircraft_history_id = l.aircraft_history_id) AS declared_to FROM lastday l) x) WHERE derived_to IS NOT NULL AND derived_to IS DISTINCT FROM declared_to")
def interval_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Versions whose declared end isn't the begin of their successor: overlaps and gaps."""
    declared = table(spark, d, "aircraft_dimension_daily_assignment").groupBy("dimension", F.col("aircraft_id").alias("entity"), "aircraft_history_id").agg(F.max("valid_to").alias("declared_to"))
    order = [F.col(c).desc_nulls_first() for c in ORDER]
    last = resolve.first_row(_events(spark, d), ["dimension", "entity", "day"], order).join(declared, ["dimension", "entity", "aircraft_history_id"])
    return versioning.close_disagreements(last.withColumnRenamed("day", "valid_from"), "declared_to").select("dimension", "entity", "valid_from", "declared_to", "derived_to")


@query(_LEGS + _E.replace("WITH e AS", ", e AS", 1) + """SELECT outcome, count(*) AS legs FROM (SELECT CASE WHEN v.value IS NULL OR l.aircraft_type IS NULL THEN 'UNKNOWN' WHEN v.value = l.aircraft_type THEN 'SAME' ELSE 'DIFFERENT' END AS outcome
FROM legs l LEFT JOIN daily v ON v.dimension = 'aircraft_type' AND v.entity = l.aircraft_id AND v.valid_from <= l.flight_departure_date AND l.flight_departure_date < v.valid_to) GROUP BY outcome""")
def type_discrepancy(spark: SparkSession, d: str) -> DataFrame:
    """The type flown against the type in force on the local day, three-valued."""
    v = _versions(spark, d).where("dimension = 'aircraft_type'").select(F.col("entity").alias("aircraft_id"), "valid_from", "valid_to", "value")
    legs = _actual(spark, d).select("flight_id", "aircraft_id", "flight_departure_date", "aircraft_type")
    x = legs.join(v, (legs.aircraft_id == v.aircraft_id) & (v.valid_from <= legs.flight_departure_date) & (legs.flight_departure_date < v.valid_to), "left")
    outcome = F.when(F.col("value").isNull() | F.col("aircraft_type").isNull(), "UNKNOWN").when(F.col("value") == F.col("aircraft_type"), "SAME").otherwise("DIFFERENT")
    return x.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("legs"))


@query(_DATED.replace("WITH days AS", _LEGS.rstrip() + ", iata AS (SELECT airport_id, min(airport_code_iata) AS iata FROM airport_reference GROUP BY 1), days AS", 1) + """SELECT l.flight_id, s.key, s.open_ord FROM legs l JOIN iata x ON x.airport_id = l.departure_airport_code JOIN iata y ON y.airport_id = l.arrival_airport_code JOIN dated s ON s.flight_number = l.number AND s.departure_station_code_iata = x.iata AND s.arrival_station_code_iata = y.iata
WHERE s.valid_from <= l.flight_departure_date AND (s.valid_to IS NULL OR l.flight_departure_date < s.valid_to) AND s.effective_date <= l.flight_departure_date AND l.flight_departure_date <= s.discontinue_date
 AND [s.is_operating_monday, s.is_operating_tuesday, s.is_operating_wednesday, s.is_operating_thursday, s.is_operating_friday, s.is_operating_saturday, s.is_operating_sunday][isodow(l.flight_departure_date)]""")
def schedule_schedules_flight(spark: SparkSession, d: str) -> DataFrame:
    """Legs with the states that were known on their day and operate on it: an equi-join with a half-open, an inclusive and a weekday clause."""
    from chronoloom.functions.intervals import on_weekday, operates_within, visible_on

    iata = table(spark, d, "airport_reference").groupBy("airport_id").agg(F.min("airport_code_iata").alias("iata"))
    at = lambda c, o: F.broadcast(iata.select(F.col("airport_id").alias(c), F.col("iata").alias(o)))
    legs = _actual(spark, d).select("flight_id", F.col("number").alias("flight_number"), F.col("flight_departure_date").alias("on"), "departure_airport_code", "arrival_airport_code")
    legs = legs.join(at("departure_airport_code", "departure_station_code_iata"), "departure_airport_code").join(at("arrival_airport_code", "arrival_station_code_iata"), "arrival_airport_code")
    x = legs.join(_dated(spark, d), ["flight_number", "departure_station_code_iata", "arrival_station_code_iata"])
    day = F.col("on")
    return x.where(visible_on(F.col("valid_from"), F.col("valid_to"), day) & operates_within(F.col("effective_date"), F.col("discontinue_date"), day) & on_weekday(day, _WEEK)).select("flight_id", "key", "open_ord")


@query(_PASS + f"SELECT DISTINCT c.historical_source_row_id AS canonical_row_id, s.historical_source_row_id AS source_row_id FROM st s JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(_K)} ORDER BY publish_date DESC NULLS LAST, historical_source_row_id NULLS LAST) AS nth FROM st WHERE missing = '') WHERE nth = 1) c ON {' AND '.join(f's.{c} = c.{c}' for c in _K)} WHERE s.missing = '' AND s.historical_source_row_id IS NOT NULL AND c.historical_source_row_id IS NOT NULL")
def passenger_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Every row id with the row that stands for its key."""
    rows = flights.passenger_status(table(spark, d, "passenger_historical"))
    one = flights.passenger_canonical(rows).select(*_K, F.col("historical_source_row_id").alias("canonical_row_id"))
    return rows.where("status = 'VALID'").select(*_K, F.col("historical_source_row_id").alias("source_row_id")).join(one, _K).select("canonical_row_id", "source_row_id").dropna().distinct()


@query(_OBS + f""", k AS (SELECT key, ord, row({_COLS}) AS r FROM obs), chg AS (SELECT coalesce(q.ord, p.ord + 1) AS ord, CASE WHEN p.ord IS NULL THEN 'added' WHEN q.ord IS NULL THEN 'removed' WHEN p.r IS DISTINCT FROM q.r THEN 'changed' END AS change_type FROM k p FULL JOIN k q ON p.key = q.key AND q.ord = p.ord + 1)
SELECT cal.day AS publish_date, change_type, count(*) AS keys FROM chg JOIN cal ON cal.o = chg.ord WHERE ord > 0 AND change_type IS NOT NULL GROUP BY ALL""")
def change_summary(spark: SparkSession, d: str) -> DataFrame:
    """Keys by delivery and kind of change."""
    days = deliveries_of(spark, d)
    per = snapshots.diff(_observed(spark, d), days.count(), CONTENT).groupBy("ord", "change_type").agg(F.count("*").alias("keys"))
    return per.join(F.broadcast(days), "ord").select(F.col("day").alias("publish_date"), "change_type", "keys")


@query(
    _OBS
    + f""", k AS (SELECT key, ord, {_COLS} FROM obs),
met AS (SELECT coalesce(q.ord, p.ord + 1) AS ord, coalesce(q.key, p.key) AS key, p.ord AS po, q.ord AS qo FROM k p FULL JOIN k q ON p.key = q.key AND q.ord = p.ord + 1),
chg AS (SELECT *, CASE WHEN po IS NULL THEN 'added' WHEN qo IS NULL THEN 'removed' ELSE 'changed' END AS change_type FROM met WHERE ord > 0 AND ord <= (SELECT max(o) FROM cal))
SELECT ord, key, change_type, '__presence__' AS field, CASE WHEN po IS NULL THEN 'ABSENT' ELSE 'PRESENT' END AS old_value, CASE WHEN qo IS NULL THEN 'ABSENT' ELSE 'PRESENT' END AS new_value,
 change_type = 'added' AND EXISTS (SELECT 1 FROM k x WHERE x.key = chg.key AND x.ord < chg.ord) AS reappears FROM chg WHERE change_type <> 'changed'
"""
    + "".join(f" UNION ALL SELECT c.ord, c.key, 'changed', '{f}', CAST(p.{f} AS VARCHAR), CAST(q.{f} AS VARCHAR), false FROM chg c JOIN k p ON p.key = c.key AND p.ord = c.po JOIN k q ON q.key = c.key AND q.ord = c.qo WHERE c.change_type = 'changed' AND p.{f} IS DISTINCT FROM q.{f}" for f in CONTENT)
)
def schedule_field_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every change from one delivery to the next with old and new value, added and removed keys by their presence."""
    return snapshots.field_changes(_observed(spark, d), deliveries_of(spark, d).count(), CONTENT)


_SKIPS = "SELECT y.o AS ord, (SELECT count(*) FROM schedule_snapshot_calendar c WHERE c.expected_publish_date > x.day AND c.expected_publish_date < y.day) > 0 AS gap FROM cal x JOIN cal y ON y.o = x.o + 1"


@query(_STATES + f", skips AS ({_SKIPS}) SELECT st.key, st.open_ord, coalesce(a.gap, false) AS opens_after_gap, coalesce(b.gap, false) AS closes_after_gap FROM st LEFT JOIN skips a ON a.ord = st.open_ord LEFT JOIN skips b ON b.ord = st.close_ord")
def state_gap_flags(spark: SparkSession, d: str) -> DataFrame:
    """States whose opening or closing is only known to lie in a gap between deliveries."""
    return states.gap_flags(_states(spark, d), snapshot_comparisons(spark, d))


@query(_OBS + f", m AS (SELECT {_M}, count(DISTINCT key) AS keys FROM obs WHERE NOT ({NO_STATION}) GROUP BY {_M}) SELECT * FROM (SELECT {_M}, keys, CAST(row_number() OVER (ORDER BY keys DESC, {', '.join(c + ' NULLS LAST' for c in _MARKET)}) AS INTEGER) AS rank FROM m) WHERE rank <= 10")
def largest_markets(spark: SparkSession, d: str) -> DataFrame:
    """The ten markets with the most schedule keys."""
    per = _good(spark, d).groupBy(*_MARKET).agg(F.countDistinct("key").alias("keys"))
    return states.top(per, "keys", 10, *_MARKET)


@query("SELECT DISTINCT unnest([flight_id, next_flight_id]) AS node, unnest(['NEXT', 'PREVIOUS']) AS relation, unnest([next_flight_id, flight_id]) AS other FROM aircraft_flight WHERE flight_id IS NOT NULL AND next_flight_id IS NOT NULL")
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links and their inverses, one hop."""
    return graph.edges_both_ways(table(spark, d, "aircraft_flight", "flight_id", "next_flight_id"), "flight_id", "next_flight_id")


@query("""WITH RECURSIVE f AS (SELECT flight_id, min(next_flight_id) AS nxt, min(aircraft_id) AS aircraft_id, min(flight_departure_date) AS flight_departure_date FROM aircraft_flight WHERE flight_id IS NOT NULL GROUP BY flight_id),
l AS (SELECT f.flight_id, f.nxt FROM f JOIN f g ON g.flight_id = f.nxt AND g.aircraft_id = f.aircraft_id AND g.flight_departure_date = f.flight_departure_date),
r(s, c) AS (SELECT flight_id, nxt FROM l UNION SELECT r.s, l.nxt FROM r JOIN l ON l.flight_id = r.c),
oncycle AS (SELECT s AS n FROM r WHERE s = c)
SELECT f.aircraft_id, f.flight_departure_date, f.flight_id, min(r.c) AS cycle FROM oncycle JOIN r ON r.s = oncycle.n JOIN f ON f.flight_id = oncycle.n GROUP BY 1, 2, 3""")
def rotation_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Flights on endless rotations within one aircraft and day."""
    return graph.cycles(table(spark, d, "aircraft_flight", "flight_id", "next_flight_id", "aircraft_id", "flight_departure_date"), "flight_id", "next_flight_id", ["aircraft_id", "flight_departure_date"])


@query(_E + """SELECT dimension, entity, day AS left_day, value AS left_to, (SELECT b.day FROM audit b WHERE b.dimension = x.dimension AND b.entity = x.entity AND b.ordinal = x.back) AS return_day, back - ordinal AS between FROM (
 SELECT *, lag(value) OVER (PARTITION BY dimension, entity ORDER BY ordinal) AS was, min(CASE WHEN value = 'In Service' THEN ordinal END) OVER (PARTITION BY dimension, entity ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back FROM audit) x
 WHERE was = 'In Service' AND value IS DISTINCT FROM 'In Service'""")
def first_returns(spark: SparkSession, d: str) -> DataFrame:
    """Departures from service with the first return to it, however many versions lie between."""
    return versioning.first_return(versioning.audit(_events(spark, d), ORDER), "In Service")


@query(_STATES + "SELECT open_kind, close_kind, count(*) AS states, sum(seen)::BIGINT AS observations FROM st GROUP BY CUBE (open_kind, close_kind)")
def state_kinds(spark: SparkSession, d: str) -> DataFrame:
    """States by how they open and close, with all subtotals; null stands for any."""
    return _states(spark, d).cube("open_kind", "close_kind").agg(F.count("*").alias("states"), F.sum("seen").alias("observations"))


@query(_SIDES + f"""SELECT DISTINCT sha256(concat_ws('|', CAST(ord AS VARCHAR), {_S})) AS group_id, ord, {_S}, side, CASE side WHEN 'removed' THEN removed_key ELSE added_key END AS key FROM counted CROSS JOIN (VALUES ('removed'), ('added')) v(side) WHERE partners_removed > 1 OR partners_added > 1""")
def ambiguous_members(spark: SparkSession, d: str) -> DataFrame:
    return states.ambiguous_members(states.amendments(_sides(spark, d), _SIGN), _SIGN)


@query("""SELECT CASE WHEN c.expected_publish_date IS NULL THEN 'OUTSIDE' WHEN c.is_present AND c.is_complete THEN 'COUNTS' ELSE 'INCOMPLETE' END AS delivery, s.schedule_key IS NOT NULL AS has_key, s.departure_station_code_iata IS NOT NULL AND s.arrival_station_code_iata IS NOT NULL AS has_stations, count(*) AS rows
FROM schedule_snapshot s LEFT JOIN (SELECT DISTINCT expected_publish_date, is_present, is_complete FROM schedule_snapshot_calendar) c ON c.expected_publish_date = s.publish_date GROUP BY 1, 2, 3""")
def delivered_rows(spark: SparkSession, d: str) -> DataFrame:
    """All delivered rows by what keeps them from counting."""
    cal = table(spark, d, "schedule_snapshot_calendar", "expected_publish_date", "is_present", "is_complete").distinct()
    rows = table(spark, d, "schedule_snapshot", "schedule_key", "publish_date", "departure_station_code_iata", "arrival_station_code_iata")
    x = rows.join(F.broadcast(cal), F.col("publish_date") == F.col("expected_publish_date"), "left")  # one row a delivery
    delivery = F.when(F.col("expected_publish_date").isNull(), "OUTSIDE").when(F.col("is_present") & F.col("is_complete"), "COUNTS").otherwise("INCOMPLETE")
    return x.groupBy(delivery.alias("delivery"), F.col("schedule_key").isNotNull().alias("has_key"), F.expr(f"not ({NO_STATION})").alias("has_stations")).agg(F.count("*").alias("rows"))


def _roles(spark: SparkSession, d: str) -> DataFrame:
    claims = resolve.candidates(table(spark, d, "airline_reference"), "airline_id", _METHODS)
    order = [F.col("publish_date").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("departure_station_code_iata", "arrival_station_code_iata", "intermediate_stop_station_codes_iata", "operating_carrier_internal", "marketing_carrier_internal")]]
    plans = resolve.first_row(table(spark, d, "passenger_historical").where("historical_source_row_id is not null"), ["historical_source_row_id"], order)
    code = lambda c: F.upper(F.trim(c))
    planned = plans.select("historical_source_row_id", code("operating_carrier_internal").alias("operating"), code("marketing_carrier_internal").alias("marketing"))
    return flights.with_roles(_compatible(spark, d), planned, _actual(spark, d).select("flight_id", "operating_carrier_code", "marketing_carrier_code"), claims)


_ROLES = _COMPAT + """, one AS (SELECT code, min(id) AS id FROM (SELECT carrier_code_iata AS code, airline_id AS id FROM airline_reference UNION SELECT carrier_code_icao, airline_id FROM airline_reference UNION SELECT airline_id, airline_id FROM airline_reference) WHERE code IS NOT NULL GROUP BY code HAVING count(DISTINCT id) = 1),
codes AS (SELECT * FROM (SELECT historical_source_row_id AS id, upper(trim(operating_carrier_internal)) AS oc, upper(trim(marketing_carrier_internal)) AS mc, row_number() OVER (PARTITION BY historical_source_row_id ORDER BY publish_date DESC NULLS LAST, departure_station_code_iata NULLS LAST, arrival_station_code_iata NULLS LAST, intermediate_stop_station_codes_iata NULLS LAST, operating_carrier_internal NULLS LAST, marketing_carrier_internal NULLS LAST) AS n FROM passenger_historical WHERE historical_source_row_id IS NOT NULL) WHERE n = 1),
roles AS (SELECT c.flight_id, c.historical_source_row_id, c.leg_index, o.id = l.operating_carrier_code AS operating_agrees, m.id = l.marketing_carrier_code AS marketing_agrees
 FROM compat c JOIN codes k ON k.id = c.historical_source_row_id JOIN legs l ON l.flight_id = c.flight_id LEFT JOIN one o ON o.code = k.oc LEFT JOIN one m ON m.code = k.mc)
"""


@query(_ROLES + "SELECT * FROM roles")
def fulfilment_roles(spark: SparkSession, d: str) -> DataFrame:
    """Compatible legs and plan rows with whether their carriers agree, role by role."""
    return _roles(spark, d)


@query(_ROLES + ", agreed AS (SELECT DISTINCT flight_id, historical_source_row_id FROM roles WHERE operating_agrees OR marketing_agrees) SELECT * FROM agreed WHERE flight_id IN (SELECT flight_id FROM agreed GROUP BY 1 HAVING count(*) = 1) AND historical_source_row_id IN (SELECT historical_source_row_id FROM agreed GROUP BY 1 HAVING count(*) = 1)")
def exact_fulfilment(spark: SparkSession, d: str) -> DataFrame:
    """Legs and plan rows that agree in a carrier and in nothing with any other."""
    return flights.one_to_one(_roles(spark, d).where("operating_agrees or marketing_agrees"), "flight_id", "historical_source_row_id")
