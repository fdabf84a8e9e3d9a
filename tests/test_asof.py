import random
from datetime import date, timedelta

import pytest

from chronoloom.operators.asof import as_of_join

D0 = date(2026, 1, 1)
VERSION = "aircraft long, dim string, f date, t date, pub date, seq long, vid long, note string, e_id long"


def join(spark, ev, ver, **more):
    e = spark.createDataFrame(ev, "fid long, aircraft long, day date, note string, id long")
    v = spark.createDataFrame(ver, VERSION)
    out = as_of_join(e, v, event_id="fid", entity="aircraft", event_day="day", version_entity="aircraft", dimension="dim", valid_from="f", valid_to="t", published="pub", sequence="seq", version_id="vid", **more)
    return out


def brute(ev, ver):
    out = set()
    for f, a, d, *_ in ev:
        best = {}
        for va, dim, vf, vt, pub, seq, vid, *_ in ver:
            if None in (f, a, d, va, dim, vf, pub) or va != a or not vf <= d or pub > d or (vt and vt.year < 9999 and vt <= d):
                continue
            rank = (pub, -1 if seq is None else seq, -1 if vid is None else vid)
            best[dim] = max(best.get(dim, rank), rank)
        out |= {(f, dim, r[2]) for dim, r in best.items()}
    return out


def rows(n, m, seed, hot=0.0):
    r = random.Random(seed)
    day = lambda k: D0 + timedelta(days=r.randrange(k))
    who = lambda: 1 if r.random() < hot else r.randrange(1, 9)
    ev = [(i, r.choice([None, who()]) if r.random() < 0.1 else who(), None if r.random() < 0.05 else day(90), "x", 0) for i in range(n)]
    ver = []
    for i in range(m):
        a = day(90)
        ver.append((who(), r.choice(["status", "type"]), a - timedelta(days=20), r.choice([None, date(9999, 12, 31), date(9999, 1, 1), a + timedelta(days=r.randrange(-25, 30))]), a + timedelta(days=r.randrange(-40, 10)), r.choice([None, 10, 20]), i, "y", 1))
    return ev + ev[:5], ver + ver[:5]


@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_against_brute_force(spark, hot):
    ev, ver = rows(300, 120, 5, hot)
    got = {tuple(r) for r in join(spark, ev, ver, hot_rows=20 if hot else 10**6).collect()}
    assert got == brute(ev, ver)


def test_one_hot_day_is_salted(spark):
    ver = [(1, "s", D0, None, D0, 1, 7, "", 0), (1, "s", D0, D0, D0, 9, 8, "", 0)]
    ev = [(i, 1, D0, "", 0) for i in range(100)]
    assert {tuple(r) for r in join(spark, ev, ver, hot_rows=10).collect()} == {(i, "s", 7) for i in range(100)}


def test_payload_and_empty(spark):
    ev, ver = [(1, 1, D0, "event", 5)], [(1, "s", D0, None, D0, 1, 7, "version", 9)]
    assert [tuple(r) for r in join(spark, ev, ver, payload=("note", "f")).collect()] == [(1, "s", 7, "version", D0)]
    assert join(spark, [], ver).count() == join(spark, ev, []).count() == join(spark, [], []).count() == 0


def test_an_entity_of_many_versions_is_cut_into_slices(spark):
    """Few events but many versions, most of the same times, some over everything; hot by its versions alone."""
    r = random.Random(8)
    day = lambda k: D0 + timedelta(days=k)
    ver = [(1, r.choice(["s", "t"]), day(r.randrange(90)), r.choice([None, day(r.randrange(60, 120))]), day(r.randrange(90)), r.choice([None, 1, 2]), i, "", 0) for i in range(600)]
    ver += [(1, "s", D0, None, D0, 1, 10_000 + i, "", 0) for i in range(200)] + [(2, "s", D0, None, D0, 1, 5, "", 0)]
    ev = [(i, 1 + i % 2, day(r.randrange(100)), "", 0) for i in range(40)]
    assert {tuple(x) for x in join(spark, ev, ver, hot_rows=50).collect()} == brute(ev, ver)
