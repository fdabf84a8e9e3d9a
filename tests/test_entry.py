"""Every registered query against its SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import norm

SF = "/root/testdata/sf0.001"
CORE = [n for n in entry.queries() if entry.queries()[n].__module__.startswith("chronoloom.plans")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect()) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["schedule_key", "valid_from", "valid_to"] and df.count() > 0
