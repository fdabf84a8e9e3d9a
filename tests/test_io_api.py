import hashlib
import json
from datetime import date, datetime

import pytest
from pyspark.sql import types as T

from chronoloom.api import Engine, Refusal, as_date, as_id, month_end
from chronoloom.operators import flights as FL
from chronoloom.operators import orphans
from chronoloom.sources import files
from chronoloom.sources.tables import SchemaMismatch, table
from chronoloom.streaming import deliveries, pending

SF = "/root/testdata/sf0.001"


def test_csv_round_trip_and_strictness(spark, tmp_path):
    schema = T.StructType([files.field("id", T.LongType(), "X-01", False), files.field("name", T.StringType(), "X-02"), files.field("day", T.DateType(), "X-03")])
    df = spark.createDataFrame([(2, 'a "b",\nc', date(9999, 12, 31)), (1, None, None)], schema)
    files.write_csv(df, str(tmp_path / "out"), ["id"])
    back = files.read_csv(spark, str(tmp_path / "out"), schema)
    assert sorted(map(tuple, back.collect())) == [(1, None, None), (2, 'a "b",\nc', date(9999, 12, 31))]
    (tmp_path / "bad.csv").write_text("id,nome,day\n1,x,2020-01-01\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path / "bad.csv"), schema).collect()
    assert files.load(df, str(tmp_path / "t"), 2) == 2
    with pytest.raises(files.PackageError):
        files.load(df, str(tmp_path / "t"), 3)
    with pytest.raises(files.PackageError):
        files.checked(df, T.StructType(schema.fields[:2]))
    assert files.inventory({"t": df})[0] == ("t", "id", "bigint", False, "X-01")


def test_fingerprint_and_preflight(spark, tmp_path):
    a, b = (spark.createDataFrame(r, "x long, y string") for r in ([(1, "a"), (2, None), (2, None)], [(2, None), (1, "a"), (2, None)]))
    assert files.fingerprint(a).first() == files.fingerprint(b).first() != files.fingerprint(a.distinct()).first()
    (tmp_path / "f").write_text("data")
    said = {"files": {"f": {"sha256": hashlib.sha256(b"data").hexdigest(), "rows": 1}}}
    (tmp_path / "manifest.json").write_text(json.dumps(said))
    assert files.preflight(str(tmp_path))["f"]["rows"] == 1
    (tmp_path / "f").write_text("other")
    with pytest.raises(files.PackageError):
        files.preflight(str(tmp_path))
    with pytest.raises(SchemaMismatch):
        table(spark, SF, "region", "nothing")


def test_keyed_stream_tells_what_begins_and_ends_to_wait(spark, tmp_path):
    pending.keyed_state(spark)
    events = [("reference", 10, "a", 1, "p"), ("reference", 11, "a", 2, "p"), ("reference", 11, "a", 2, "p"), ("arrived", 10, None, None, None)], [("arrived", 11, None, None, None), ("deleted", 10, None, None, None), ("reference", 12, "b", 3, None)], [("arrived", 10, None, None, None), ("deleted", 10, None, None, None), ("reference", None, "b", 3, "q")]
    want = [{("a", 2, 11, "p", True)}, {("a", 2, 11, "p", False), ("a", 1, 10, "p", True), ("b", 3, 12, "unknown", True)}, {("a", 1, 10, "p", False)}]
    source, seen = tmp_path / "in", []
    for rows, expected in zip(events, want):
        spark.createDataFrame(rows, pending.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        out = pending.changes(spark.readStream.schema(pending.EVENTS).parquet(str(source)))
        query = out.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append({tuple(r) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "keyed")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        assert seen[-1] == expected


def test_stream_of_increments_equals_one_batch(spark, tmp_path):
    events = [("reference", 10, "a", 1, "p"), ("reference", 11, "a", 2, "p"), ("arrived", 10, None, None, None)], [("arrived", 11, None, None, None), ("deleted", 10, None, None, None), ("reference", 12, "b", 3, "q")]
    source = tmp_path / "in"
    for i, rows in enumerate(events):
        spark.createDataFrame(rows, pending.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        pending.start(spark.readStream.schema(pending.EVENTS).parquet(str(source)), str(tmp_path / "run")).awaitTermination(120)
        state = pending.state_at(spark, str(tmp_path / "run"), i)
        assert {(r.source_table, r.ref_id, r.key) for r in state.waiting.collect()} == [{("a", 2, 11)}, {("a", 1, 10), ("b", 3, 12)}][i]
    counts = spark.read.parquet(str(tmp_path / "run/counts"))
    assert {(r.batch, r.source_table, r.orphans) for r in counts.collect()} == {(0, "a", 1), (1, "a", 1), (1, "b", 1)}
    assert orphans.snapshot_counts(orphans.OrphanState.empty(spark)).count() == 0


def test_watermarked_windows(spark, tmp_path):
    rows = [("k", datetime(2026, 1, 1, 0, m)) for m in (0, 1, 1, 30, 59)]
    spark.createDataFrame(rows, "k string, t timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    deliveries.append(deliveries.late_rows(stream, "t", "k", "5 minutes", "10 minutes"), "closed_windows", str(tmp_path / "c")).awaitTermination(120)
    assert sorted((r.window.start.minute, r.rows) for r in spark.table("closed_windows").collect()) == [(0, 3), (30, 1)]
    deliveries.append(deliveries.first_seen(stream, "t", ["k", "t"], "5 minutes"), "first_rows", str(tmp_path / "d")).awaitTermination(120)
    assert spark.table("first_rows").count() == 4


def test_parameters():
    assert as_id("12") == 12 and as_date("2026-01-31", "M") == month_end("2026-01-31") == date(2026, 1, 31)
    for bad, code in (((as_id, ""), "MISSING_AIRCRAFT_ID"), ((as_id, "x"), "INVALID_AIRCRAFT_ID"), ((month_end, "2026-01-30"), "INVALID_MONTH_END"), ((lambda v: as_date(v, "M"), "2026-13-01"), "INVALID_DATE")):
        with pytest.raises(Refusal) as e:
            bad[0](bad[1])
        assert e.value.code == code


def test_questions(spark):
    engine = Engine(spark, SF)
    aircraft = table(spark, SF, "aircraft_flight").where("aircraft_id is not null and flight_departure_date is not null").first()
    known = table(spark, SF, "aircraft_dimension_daily_assignment").first().aircraft_id
    asked = {
        "aircraft_as_of": {"aircraft_id": known, "as_of_date": "2026-03-15"}, "status_reversion_spells": {"aircraft_id": known}, "fleet_storage_spell_distribution": {}, "month_end_fleet_composition": {"start": "2025-11-30", "end": "2026-03-31"}, "type_engine_histories": {"aircraft_id": known},
        "schedule_changes": {"start": "2026-03-02", "end": "2026-03-16"}, "market_entries_and_exits": {"latest": "2026-03-16", "comparison": "2026-03-09"}, "market_count_at": {"day": "2026-03-09", "carrier_role": "operating"}, "route_capacity": {"knowledge": "2026-05-13", "operating": "2026-06-10"}, "actual_rotation": {"aircraft_id": aircraft.aircraft_id, "flight_departure_date": aircraft.flight_departure_date},
    }
    assert set(asked) == set(Engine.CATALOG)
    for name, parameters in asked.items():
        e = engine.invoke(name, **parameters)
        assert e["status"] == "OK" and e["row_count"] == len(e["rows"]) and e["columns"], name
    assert engine.invoke("aircraft_as_of", aircraft_id=known, as_of_date="2026-03-15")["row_count"] == 1
    assert engine.invoke("aircraft_as_of", aircraft_id=-1, as_of_date="2026-03-15")["error_code"] == "INVALID_AIRCRAFT_ID"
    assert engine.invoke("aircraft_as_of", aircraft_id=1, as_of_date="2026-03-15")["rows"][0]["aircraft_status_status"] == "OUTSIDE_EXISTENCE"
    assert engine.invoke("market_count_at", day="2026-02-16")["error_code"] == "ENDPOINT_MISSING"
    assert engine.invoke("market_count_at", day="2026-05-04")["error_code"] == "ENDPOINT_INCOMPLETE"
    assert engine.invoke("market_count_at", day="2026-03-09", carrier_role="x")["error_code"] == "INVALID_CARRIER_ROLE"
    assert engine.invoke("month_end_fleet_composition", start="2026-03-31", end="2025-11-30")["error_code"] == "INVALID_MONTH_END_RANGE"
    assert engine.invoke("actual_rotation", aircraft_id=1, flight_departure_date="2026-01-01")["status"] == "NOT_FOUND"
    assert engine.invoke("nothing")["error_code"] == "UNKNOWN_QUESTION"


def test_links_and_utc(spark):
    t = datetime(2026, 1, 1, 8)
    leg = "flight_id long, aircraft_id long, flight_departure_date date, departure_airport_code string, continuity_code string, actual_gate_departure_time_utc timestamp_ntz, actual_gate_arrival_time_utc timestamp_ntz, cancelled boolean, next_flight_id long"
    day = date(2026, 1, 1)
    ok = lambda i, n, **m: tuple((dict(i=i, a=1, d=day, f="A", c="A", off=t, on=t, x=False, n=n) | m).values())
    rows = [ok(1, 2), ok(2, None), ok(3, 3), ok(4, 99), ok(5, 6), ok(6, 7, a=2), ok(7, 2, a=2, d=date(2026, 1, 2)), ok(8, 2, on=datetime(2026, 1, 1, 9)), ok(9, 2, c="B"), ok(10, 2, x=True), ok(11, 2, x=None), ok(12, 2, on=None), ok(13, 10)]
    got = {r.flight_id: r for r in FL.link_facts(spark.createDataFrame(rows, leg)).collect()}
    assert set(got) == set(range(1, 14)) - {2} and [i for i, r in got.items() if r.holds] == [1]
    untrue = {i: {n for n in FL.FACTS if r[n] is not True} for i, r in got.items()}
    about_target = {"target_exists", "target_flown", "same_aircraft", "same_day", "in_order", "connects"}
    assert untrue == {1: set(), 3: {"names_other"}, 4: about_target, 5: {"same_aircraft"}, 6: {"same_day"}, 7: {"same_aircraft", "same_day"}, 8: {"in_order"}, 9: {"connects"}, 10: {"flown"}, 11: {"flown"}, 12: {"timed", "in_order"}, 13: {"target_flown"}}
    assert got[11].flown is None and got[12].in_order is None and got[4].same_day is None
    plan = spark.createDataFrame([(day, "01:00:00", "23:30:00", 120.0, -60.0, 1), (day, "01:00:00", None, float("nan"), None, None), (None, "01:00:00", None, 0.0, None, None)], "operating_date date, passenger_departure_local_time string, passenger_arrival_local_time string, departure_utc_offset_minutes double, arrival_utc_offset_minutes double, arrival_day_indicator long")
    assert [(r.departure_utc, r.arrival_utc, r.utc_status) for r in FL.with_utc(plan).collect()] == [(datetime(2025, 12, 31, 23), datetime(2026, 1, 3, 0, 30), "OFFSET_DERIVED"), (None, None, "UNRESOLVED_UTC_DATE"), (None, None, "NO_LOCAL_TIME")]
