from datetime import date as d

from pyspark.sql import functions as F

from chronoloom.operators import resolve as R
from chronoloom.operators import states as S
from chronoloom.operators.graph import chains, components


def test_states_open_and_close(spark):
    obs = spark.createDataFrame([("k", 0, "a"), ("k", 1, "a"), ("k", 2, "b"), ("k", 4, "b"), ("m", 5, None)], "key string, ord int, c string")
    got = [(r.key, r.open_ord, r.close_ord, r.open_kind, r.close_kind, r.seen, r.c) for r in S.states(obs, ["c"], 6).orderBy("key", "open_ord").collect()]
    assert got == [("k", 0, 2, "INITIAL", "CONTENT_CHANGE", 2, "a"), ("k", 2, 3, "CONTENT_CHANGE", "ABSENCE", 1, "b"), ("k", 4, 5, "REAPPEARANCE", "ABSENCE", 1, "b"), ("m", 5, None, "INITIAL", "OPEN", 1, None)]
    assert S.lineage(obs.withColumn("h", F.lit("x")), ["c"], "h").count() == 5


def test_amendments(spark):
    side = "ord int, key string, side string, sig string, first date, last date"
    rows = [(1, "r1", "removed", "A", d(2026, 1, 1), d(2026, 2, 1)), (1, "a1", "added", "A", d(2026, 2, 1), d(2026, 3, 1)), (1, "r2", "removed", "B", d(2026, 1, 1), d(2026, 2, 1)), (1, "a2", "added", "B", d(2026, 1, 5), d(2026, 3, 1)), (1, "a3", "added", "B", d(2026, 1, 7), d(2026, 3, 1)), (1, "r4", "removed", "C", d(2026, 1, 1), d(2026, 1, 31)), (1, "a4", "added", "C", d(2026, 2, 1), d(2026, 3, 1)), (1, "r5", "removed", None, d(2026, 1, 1), d(2026, 1, 31))]
    sides = spark.createDataFrame(rows, side)
    pairs = S.amendments(sides, ["sig"])
    assert {(r.removed_key, r.added_key, r.partners_removed, r.partners_added) for r in pairs.collect()} == {("r1", "a1", 1, 1), ("r2", "a2", 2, 1), ("r2", "a3", 2, 1)}
    assert [tuple(r) for r in S.ambiguous_groups(pairs, ["sig"]).collect()] == [(1, "B", 3, "r2", "a2,a3")]
    assert {r.key for r in S.unpaired(sides, pairs).collect()} == {"r4", "a4", "r5"}
    obs = spark.createDataFrame([("r1", 0, "A", d(2026, 1, 1), d(2026, 2, 1)), ("a1", 1, "A", d(2026, 2, 1), d(2026, 3, 1))], "key string, ord int, sig string, f date, l date")
    changes = spark.createDataFrame([(1, "r1", "removed"), (1, "a1", "added"), (1, "x", "changed")], "ord int, key string, change_type string")
    assert {(r.key, r.first.month) for r in S.amendment_sides(changes, obs, ["sig"], "f", "l").collect()} == {("r1", 1), ("a1", 2)}


def test_parts_and_comparisons(spark):
    df = spark.createDataFrame([(10.0, 4.0, 6.0, 1.0), (10.0, 4.0, 5.0, 1.0), (10.0, None, 6.0, 1.0), (10.0, -4.0, 14.0, 1.0), (10.0, 4.0, 6.0, 7.0)], "t double, a double, b double, p double")
    facts = [tuple(r) for r in df.select(*S.part_facts("t", ["a", "b"], "p", "b")).collect()]  # all known, none negative, adds up, included fits
    assert facts == [(True, True, True, True), (True, True, False, True), (False, True, None, True), (True, False, True, True), (True, True, True, False)]
    nothing = spark.createDataFrame([(10.0, 4.0, 6.0, None), (10.0, 4.0, 6.0, -1.0)], "t double, a double, b double, p double")
    assert [tuple(r) for r in nothing.select(*S.part_facts("t", ["a", "b"], "p", "b")).collect()] == [(False, True, True, None), (True, False, True, True)]
    days = spark.createDataFrame([(0, d(2026, 1, 5)), (1, d(2026, 1, 26))], "ord int, day date")
    expected = spark.createDataFrame([(d(2026, 1, x),) for x in (5, 12, 19, 26)], "expected date")
    assert [(r.ord, r.skipped, r.days) for r in S.comparisons(days, expected).collect()] == [(1, 2, 21)]


def test_markets_and_capacity(spark):
    obs = spark.createDataFrame([("k1", 0, "A"), ("k2", 1, "A"), ("k3", 0, "B"), ("k4", 1, "C"), ("k5", 1, "C"), ("k6", 1, None)], "key string, ord int, m string")
    assert {(r.m, r.kind, r["keys"]) for r in S.entries_and_exits(obs, ["m"], 0, 1).collect()} == {("B", "EXIT", 1), ("C", "ENTRY", 2)}
    dated = spark.createDataFrame([("A", d(2026, 1, 1), None, d(2026, 2, 1), d(2026, 3, 1), True, 2, 100.0), ("A", d(2026, 1, 1), None, d(2026, 2, 1), d(2026, 3, 1), True, 3, None), ("A", d(2026, 1, 1), d(2026, 1, 9), d(2026, 2, 1), d(2026, 3, 1), True, 7, 1.0), ("A", d(2026, 1, 1), None, d(2026, 2, 1), d(2026, 3, 1), None, 7, 1.0)], "m string, valid_from date, valid_to date, f date, l date, w boolean, n long, seats double")
    assert [tuple(r) for r in S.capacity(dated, "2026-01-09", "2026-03-01", ["m"], ["w"] * 7, "n", "seats", "f", "l").collect()] == [("A", 2, 5, 200.0, False)]


def test_codes_and_definitions(spark):
    ref = spark.createDataFrame([("1", "A", "X"), ("1", "A", None), ("2", "B", "X"), ("3", None, "C")], "id string, iata string, icao string")
    out = R.outcomes(R.candidates(ref, "id", {"IATA": "iata", "ICAO": "icao"}))
    assert {(r.method, r.code, r.id, r.ids) for r in out.collect()} == {("IATA", "A", "1", "1"), ("IATA", "B", "2", "2"), ("ICAO", "X", None, "1,2"), ("ICAO", "C", "3", "3")}
    rows = spark.createDataFrame([("X",), ("C",), ("Q",), ("",), (None,)], "c string")
    assert {r.c: r.who_status for r in R.resolve(rows, "c", out, "ICAO", "who").collect()} == {"X": "AMBIGUOUS", "C": "EXACT", "Q": "UNRESOLVED", "": "INVALID_INPUT", None: "INVALID_INPUT"}
    assert {r.icao: (r.definitions, r.iata) for r in R.definition(ref, "icao", ["iata"]).collect()} == {"X": (2, None), "C": (1, None)}
    assert [tuple(r) for r in R.violations(ref, ["id"]).collect()] == [("1", 2)]


def test_components_and_chains(spark):
    edges = [(i, i + 1) for i in range(0, 50) if i % 10 != 9] + [(70, 60), (60, 70), (80, 80), (None, 3), (9, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: (0 if i < 10 or 30 <= i < 40 else i // 10 * 10) for i in range(50)} | {60: 60, 70: 60, 80: 80}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    links = spark.createDataFrame([(1, 2), (2, 3), (3, None), (5, 3), (6, 7), (7, 6), (8, 8)], "n long, f long")
    assert {(r.n, r["head"], r.position) for r in chains(links, "n", "f").collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 3), (5, 5, 1), (8, 8, 1)}


def test_entries_and_exits_of_all_deliveries(spark):
    rows = [(1, 0, "A"), (1, 1, "A"), (1, 2, "A"), (2, 0, "B"), (2, 2, "B"), (3, 1, "C"), (4, 1, "C"), (5, 1, None), (6, 3, "A")]
    obs = spark.createDataFrame(rows, "key long, ord int, m string")
    got = {(r.ord, r.m, r.kind, r["keys"]) for r in S.consecutive_entries_and_exits(obs, ["m"], 5).collect()}
    assert got == {(1, "B", "EXIT", 1), (2, "B", "ENTRY", 1), (3, "B", "EXIT", 1), (1, "C", "ENTRY", 2), (2, "C", "EXIT", 2), (4, "A", "EXIT", 1)}
