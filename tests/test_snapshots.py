import random
from datetime import date, timedelta

import pytest

from chronoloom.operators import history as H
from chronoloom.operators import snapshots as S

DAYS = [date(2026, 1, 5) + timedelta(days=7 * i) for i in range(6)]
FIELDS = ["a", "b", "key2"]


def frames(spark, rows, present=(True,) * 6):
    cal = spark.createDataFrame([(d, p, True) for d, p in zip(DAYS, present)] + [(DAYS[0], present[0], True)], "day date, here boolean, full boolean")
    raw = spark.createDataFrame(rows, "k string, day date, a long, b string, key2 double, rank long, ord string, key string")
    days = S.eligible(cal, "day", "here", "full")
    return days, S.canonical(raw, days, "k", "day", S.ranking("rank", True), FIELDS)


def random_rows(seed):
    r = random.Random(seed)
    return [(f"k{k}", d, r.choice([1, 1, 1, None]), r.choice(["x", "y", None]), r.choice([1.0, 1.0, None]), r.choice([1, 2, None]), "clash", "clash") for k in range(12) for d in DAYS for _ in range(r.choice([0, 1, 1, 2]))] + [(None, DAYS[0], 1, "x", 1.0, 1, "", ""), ("k1", None, 1, "x", 1.0, 1, "", ""), ("k1", date(2020, 1, 1), 1, "x", 1.0, 1, "", "")]


def plain(rows, present):
    """{ordinal: {key: fields}} with the row of the highest rank, nulls last, then the least fields, nulls first."""
    days = [d for d, p in zip(DAYS, present) if p]
    low = lambda v: (v is not None, v if v is not None else 0)
    out = {i: {} for i in range(len(days))}
    order = lambda x: (x[5] is None, -(x[5] or 0), low(x[2]), (x[3] is not None, x[3] or ""), low(x[4]))
    for r in sorted((r for r in rows if r[0] and r[1] in days), key=order):
        out[days.index(r[1])].setdefault(r[0], r[2:5])
    return out


@pytest.mark.parametrize("present", [(True,) * 6, (True, True, False, True, True, True)])
def test_diff_and_history_against_plain_python(spark, present):
    rows = random_rows(3)
    rows += rows[:10]
    days, state = frames(spark, rows, present)
    want = plain(rows, present)
    n = len(want)
    assert {(r.key, r.ord): (r.a, r.b, r.key2) for r in state.collect()} == {(k, o): v for o, s in want.items() for k, v in s.items()}
    changes = {(r.ord, r.key): (r.change_type, tuple(r.changed)) for r in S.diff(state, n, FIELDS, report_fields=True).collect()}
    expected = {}
    for o in range(1, n):
        for k in want[o].keys() | want[o - 1].keys():
            x, y = want[o - 1].get(k), want[o].get(k)
            if x != y:
                expected[o, k] = ("added", ()) if x is None else ("removed", ()) if y is None else ("changed", tuple(f for f, p, q in zip(FIELDS, x, y) if p != q))
    assert changes == expected
    log = H.change_log(state, n, FIELDS)
    spans, vers, attr = set(), set(), set()
    for k in {k for s in want.values() for k in s}:
        for column in (None, 0, 1, 2):
            value = lambda o: None if k not in want.get(o, {}) else (want[o][k] if column is None else (want[o][k][column],))  # noqa: B023, E731
            o = 0
            while o < n:
                if value(o) is None:
                    o += 1
                    continue
                start = o
                while value(o) == value(start):
                    o += 1
                end = None if o >= n else o
                text = lambda v: None if v is None else str(v)
                if column is None:
                    spans.add((k, start, end))
                    vers.add((k, start, end, *map(text, value(start))))
                else:
                    attr.add((k, column, start, end, text(value(start)[0])))
    assert {tuple(r) for r in H.boundaries(log).collect()} == spans
    assert {tuple(r) for r in H.versions(log, FIELDS).collect()} == vers
    assert {tuple(r) for r in H.attribute_intervals(log, 3).collect()} == attr


def test_empty(spark):
    days, state = frames(spark, [])
    assert state.count() == S.diff(state, 6, FIELDS).count() == H.boundaries(H.change_log(state, 6, FIELDS)).count() == 0
