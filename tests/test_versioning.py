from datetime import date

from pyspark.sql import functions as F

from chronoloom.functions.canon import canonical, display_number, flag, row_digest, source_date
from chronoloom.functions.intervals import ladder, on_weekday, operates_within, overlap, visible_on
from chronoloom.operators import versioning as V

EVENT = "dimension string, entity long, day date, value string, seq long, id long, existence_from date, existence_to date"
d = date


def events(spark, rows):
    return spark.createDataFrame([("s", e, day, v, q, i, d(2020, 1, 1), end) for i, (e, day, v, q, end) in enumerate(rows)], EVENT)


ROWS = [(1, d(2020, 1, 1), "A", 10, None), (1, d(2020, 2, 1), "A", 10, None), (1, d(2020, 3, 1), "B", 10, None), (1, d(2020, 3, 1), "A", 20, None), (1, d(2020, 4, 1), "B", None, None), (1, d(2020, 5, 1), "A", 1, None), (2, d(2020, 1, 1), None, 1, d(2020, 6, 1)), (2, d(2020, 7, 1), "A", 1, d(2020, 6, 1)), (1, d(2020, 6, 1), "B", 1, None)]


def test_audit_keeps_every_change_and_daily_the_last_of_the_day(spark):
    e = events(spark, ROWS)
    got = [(r.day.month, r.value, r.ordinal) for r in V.audit(e, ["seq", "id"]).where("entity = 1").orderBy("ordinal").collect()]
    assert got == [(1, "A", 1), (3, "B", 2), (3, "A", 3), (4, "B", 4), (5, "A", 5), (6, "B", 6)]
    daily = V.daily(e, ["seq", "id"], "existence_to")
    assert [(r.valid_from.month, r.valid_to.isoformat(), r.value) for r in daily.where("entity = 1").orderBy("valid_from").collect()] == [(1, "2020-04-01", "A"), (4, "2020-05-01", "B"), (5, "2020-06-01", "A"), (6, "9999-01-01", "B")]
    assert [(r.valid_from.month, r.valid_to.isoformat(), r.value) for r in daily.where("entity = 2").collect()] == [(1, "2020-06-01", None)]
    spells = V.reversion_spells(V.audit(e, ["seq", "id"]).select("dimension", "entity", "day", "value", "seq", "id"), ["seq", "id"], "A", ["B"])
    assert [(r.start_day.month, r.days, r.same_day) for r in spells.orderBy("start_day").collect()] == [(3, 0, True), (4, 30, False)]


def test_as_of_statuses(spark):
    e = events(spark, ROWS)
    existence = spark.createDataFrame([(1, d(2020, 1, 1), None), (2, d(2019, 1, 1), d(2020, 6, 1)), (3, None, None)], "entity long, existence_from date, existence_to date")
    got = {(r.entity, r.as_of.isoformat()): (r.status, r.value) for r in V.as_of_status(V.daily(e, ["seq", "id"], "existence_to"), existence, ["s"], ["2019-06-01", "2020-02-01", "2020-06-01"]).collect()}
    assert got[1, "2019-06-01"] == ("OUTSIDE_EXISTENCE", None) and got[1, "2020-02-01"] == ("OK", "A") and got[1, "2020-06-01"] == ("OK", "B")
    assert got[2, "2019-06-01"] == ("NO_RECORDED_STATE", None) and got[2, "2020-02-01"] == ("UNKNOWN_STATE", None) and got[2, "2020-06-01"] == ("OUTSIDE_EXISTENCE", None)
    assert {got[3, x][0] for x in ("2019-06-01", "2020-02-01")} == {"OUTSIDE_EXISTENCE"}


def test_composition_history_and_distribution(spark):
    v = spark.createDataFrame([("t", 1, d(2020, 1, 1), d(2020, 3, 1), "X"), ("s", 1, d(2020, 1, 31), d(9999, 1, 1), "On"), ("t", 1, d(2020, 3, 1), d(9999, 1, 1), None), ("t", 2, d(2020, 1, 1), None, "X")], "dimension string, entity long, valid_from date, valid_to date, value string")
    assert [(r.month_end.month, r.label, r.entities) for r in V.composition(v, "t", ("s", "On"), "2020-01-01", "2020-03-01").orderBy("month_end").collect()] == [(1, "X", 1), (2, "X", 1), (3, None, 1)]
    assert [(r.value, r.previous, r.is_change) for r in V.with_previous(v).where("dimension = 't' and entity = 1").orderBy("valid_from").collect()] == [("X", None, False), (None, "X", True)]
    got = V.distribution(spark.createDataFrame([(0,), (5,), (5,), (99,)], "n int"), "n", [("none", 0), ("some", 10), ("many", 50), ("more", None)])
    assert [(r.bucket, r.n, r.share) for r in got.orderBy("bucket_order").collect()] == [("none", 1, 0.25), ("some", 2, 0.5), ("many", 0, 0.0), ("more", 1, 0.25)]
    assert V.close_disagreements(v, "valid_to").count() == 0


def test_intervals_and_canonical_texts(spark):
    one = spark.range(1)
    x = lambda s: F.lit(s).cast("date")
    got = one.select(
        visible_on(x("2020-01-01"), x("2020-01-02"), x("2020-01-01")), visible_on(x("2020-01-01"), x("2020-01-02"), x("2020-01-02")), visible_on(x("2020-01-01"), x(None), x("2020-01-09")), operates_within(x("2020-01-01"), x("2020-01-02"), x("2020-01-02")), overlap(x("2020-01-01"), x("2020-01-02"), x("2020-01-02"), x("2020-01-05")),
        on_weekday(x("2026-06-10"), [F.lit(i == 2) for i in range(7)]), on_weekday(x("2026-06-10"), [F.lit(None).cast("boolean")] * 7), ladder(F.lit(None).cast("int"), [("a", None)]), source_date(x("9999-12-31")), source_date(x("9999-01-01")), flag(F.lit(2)), flag(F.lit(1)), display_number(F.lit(180.0)), display_number(F.lit(1.5)),
    ).first()
    assert list(got) == [True, False, True, True, True, True, False, None, None, d(9999, 1, 1), None, True, "180", "1.5"]
    df = spark.createDataFrame([(180.0, None, True, d(2020, 1, 2), "é"), (None, "", None, None, None)], "f double, s string, b boolean, t date, u string")
    kinds = {f.name: f.dataType for f in df.schema}
    assert [tuple(r) for r in df.select(*[canonical(F.col(c), kinds[c]) for c in df.columns]).collect()] == [("180.0", None, "true", "2020-01-02", "é"), (None, "", None, None, None)]
    import hashlib

    want = hashlib.sha256("1:fV5:180.01:sN1:uV2:é".encode()).hexdigest()
    assert df.select(row_digest(df.schema, "f", "s", "u")).first()[0] == want
