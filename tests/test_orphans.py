import pytest

from chronoloom.operators import orphans as O


def refs(spark, rows):
    return spark.createDataFrame(rows, O.REFERENCE)


def keys(spark, *k):
    return spark.createDataFrame([(x,) for x in k], "key long")


def waiting(state):
    return sorted((r.source_table, r.ref_id, r.key, r.period) for r in state.waiting.collect())


def test_arrivals_resolve_and_deletions_reopen(spark):
    s = O.advance(O.OrphanState.empty(spark), refs(spark, [("a", 1, 10, "2026-01"), ("a", 2, 11, "2026-01"), ("a", 2, 11, "2026-01")]), keys(spark, 10, None)).kept()
    assert waiting(s) == [("a", 2, 11, "2026-01")]
    s = O.advance(s, refs(spark, [("b", 3, 12, "2026-02")]), arrived=keys(spark, 11)).kept()
    assert waiting(s) == [("b", 3, 12, "2026-02")]
    s = O.advance(s, deleted=keys(spark, 10, 11, 77)).kept()
    assert waiting(s) == [("a", 1, 10, "2026-01"), ("a", 2, 11, "2026-01"), ("b", 3, 12, "2026-02")]
    s = O.advance(s, arrived=keys(spark, 11, 12), deleted=keys(spark, 11)).kept()
    assert waiting(s) == [("a", 1, 10, "2026-01")]
    assert [tuple(r) for r in O.snapshot_counts(s).collect()] == [("a", "2026-01", 1, 1)]
    assert waiting(O.advance(s)) == waiting(s)


def test_increments_equal_one_batch(spark):
    all_refs = [("t", i, i % 37, f"2026-{i % 5 + 1:02d}") for i in range(200)]
    parents = [k for k in range(37) if k % 3]
    whole = O.advance(O.OrphanState.empty(spark), refs(spark, all_refs), keys(spark, *parents))
    s = O.OrphanState.empty(spark)
    for part in range(4):
        s = O.advance(s, refs(spark, all_refs[part::4]), keys(spark, *parents[3 - part :: 4])).kept()
    assert waiting(s) == waiting(whole) == sorted(r for r in all_refs if r[2] not in parents)


def test_references_without_key_or_id(spark):
    df = spark.createDataFrame([(1, None, None), (None, 5, None), (2, 6, None)], "id long, target long, day date")
    assert [tuple(r) for r in O.references(df, "t", "id", "target", "day").collect()] == [("t", 2, 6, "unknown")]


@pytest.mark.parametrize(
    ("text", "number"),
    [("12", 12), (" 12\t", 12), ("+12", 12), ('"12"', 12), ("12.0", 12), ("12.", 12), ("1,234,567", 1234567), ("1,234.00", 1234), ("1.234.567", 1234567), ("1.2E3", 1200), ("1.25e1", None), ("007", 7), ("１２", 12), ("-3", -3), ("12.5", None), ("n/a", None), ("", None), (None, None), ("9" * 30, None), ("1 234", 1234)],
)
def test_whole_numbers(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(O.whole_number("t")).first()[0] == number


def spans_of(spark, references, arrived, deleted=None):
    at = "source_table string, ref_id long, key long, period string, at int"
    frame = lambda rows: spark.createDataFrame(rows, "key long, at int")
    return O.replay(spark.createDataFrame(references, at), frame(arrived), None if deleted is None else frame(deleted))


def test_replay_equals_increments_one_by_one_whatever_the_order(spark):
    references = [("t", i, i % 23, f"2026-{i % 4 + 1:02d}", i % 4) for i in range(160)] + [("t", 0, 0, "2026-01", 0)] * 3
    arrived = [(k, (k * 5) % 6) for k in range(23) if k % 4] + [(k, 4) for k in range(0, 23, 6)] + [(None, 1)]
    deleted = [(k, 2) for k in range(0, 23, 3)] + [(k, 5) for k in range(1, 23, 7)] + [(None, 0)]
    for gone in (None, deleted):
        spans = spans_of(spark, references, arrived, gone)
        rows, state = spans.collect(), O.OrphanState.empty(spark)
        for at in range(6):
            state = O.advance(state, refs(spark, [r[:4] for r in references if r[4] == at]), keys(spark, *[k for k, t in arrived if t == at]), keys(spark, *[k for k, t in gone or [] if t == at])).kept()
            assert waiting(state) == sorted((r.source_table, r.ref_id, r.key, r.period) for r in rows if r.from_at <= at and (r.to_at is None or at < r.to_at))
        assert sorted(map(tuple, O.waiting_at_end(spans).collect())) == waiting(state)
        counted = {(r.at, r.period): (r.orphans, r.missing_keys) for r in O.counts_by_increment(spans, spark.createDataFrame([(5,)], "at int")).collect()}
        last = {(5, r.period): (r.orphans, r.missing_keys) for r in O.snapshot_counts(state).collect()}
        assert counted == last
    # References that come later than their parents, or earlier, end in the same state.
    late = spans_of(spark, [(*r[:4], 5) for r in references], arrived)
    assert sorted(map(tuple, O.waiting_at_end(late).collect())) == sorted(map(tuple, O.waiting_at_end(spans_of(spark, references, arrived)).collect()))


def test_replay_of_nothing(spark):
    assert spans_of(spark, [], []).count() == spans_of(spark, [], [], []).count() == 0
    assert [tuple(r) for r in spans_of(spark, [("t", 1, 5, "p", 0), ("t", None, 5, "p", 0), ("t", 2, None, "p", 0)], []).collect()] == [("t", 1, 5, "p", 0, None)]
