import pytest

from chronoloom.operators.packed import split_packed

CASES = {
    "JEB": ["JEB"], "a, b;c": ["A", "B", "C"], '"ZN,4",x': ["ZN,4", "X"], "[“ZK/2” | b]": ["ZK/2", "B"], "'ZV 3'": ["ZV 3"], ",,": [], "  ": [], "": [], None: [], "a->b": ["A", "B"], ";a,": ["A"], "('x')": ["X"],
    '" a "': ["A"], '""': [], '"" a': ["A"], 'a "b': ["A", "B"], '"a""b",c': ['A"B', "C"], "a\nb\tc": ["A", "B", "C"], "“a”，“b”": ["A", "B"], "é ñ": ["É", "Ñ"], "a" * 5000: ["A" * 5000], ",".join(["x"] * 3000): ["X"] * 3000, '"a;b" c d': ["A;B", "C", "D"],
}


def test_cases(spark):
    rows = [(i, f, "clash", 1) for i, f in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows + [(None, "a,b", "x", 2)], "id long, field string, value string, position int")
    got = {}
    for r in split_packed(df, "id", "field").collect():
        got.setdefault(r.id, {})[r.position] = r.value
    for i, want in enumerate(CASES.values()):
        assert got.get(i, {}) == dict(enumerate(want, 1)), list(CASES)[i][:40]


def test_empty(spark):
    assert split_packed(spark.createDataFrame([], "id long, field string"), "id", "field").count() == 0


@pytest.mark.parametrize("quote", ['""', "''", "“”", "«»"])
def test_what_stands_in_quotes_is_one_value(spark, quote):
    df = spark.createDataFrame([(1, f"{quote[0]}a, b/c{quote[1]} d")], "id long, field string")
    assert [r.value for r in split_packed(df, "id", "field").orderBy("position").collect()] == ["A, B/C", "D"]
