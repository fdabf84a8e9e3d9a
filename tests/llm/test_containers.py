import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import containers as C
from chronoloom.llm.ranks import running


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 25), min_size=1, max_size=12), st.integers(60, 90))
def test_plan_holds_everything_within_the_capacity(histogram, capacity):
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    plan = C.plan_containers(lengths, counts, capacity, 20)
    held = np.zeros(len(lengths), np.int64)
    for often, content in plan:
        assert often > 0 and sum(int(lengths[i]) * k for i, k in content.items()) <= capacity
        for i, k in content.items():
            held[i] += often * k
    assert (held == counts).all()
    # Items longer than half the capacity need a container each, which the total length doesn't show.
    least = max(-(-int((lengths * counts).sum()) // capacity), int(counts[2 * lengths > capacity].sum()))
    assert least <= C.lower_bound(lengths, counts, capacity) <= sum(o for o, _ in plan)
    assert sum(o for o, _ in plan) <= 1.6 * least + 1


@pytest.mark.parametrize(("capacity", "longest"), [(256, 255), (100, 60), (2048, 700)])
def test_plans_of_many_items_are_as_good_as_best_fit_and_reach_the_bound_of_short_ones(capacity, longest):
    """A hundred times the items need a hundred times the containers, rounds don't grow, and no item is left to best fit."""
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, longest, 180))
    counts = rng.geometric(0.02, len(lengths)).astype(np.int64)
    for times in (1, 100):
        plan = C.plan_containers(lengths, counts * times, capacity)
        used, bound, best_fit = sum(o for o, _ in plan), C.lower_bound(lengths, counts * times, capacity), sum(o for o, _ in C.best_fit(lengths, counts * times, capacity))
        assert bound <= used <= best_fit * 1.001 and len(plan) <= C.ROUNDS + 2 * len(lengths)
        if longest < capacity * 0.7:
            assert used <= bound * 1.001 + 1


def test_best_pattern_is_optimal():
    lengths, prices, most = np.array([3, 5, 7]), np.array([3.0, 5.5, 7.2]), np.array([2, 1, 2])
    got = C.best_pattern(lengths, prices, most, 14)
    best = max(a * 3.0 + b * 5.5 + c * 7.2 for a in range(3) for b in range(2) for c in range(3) if 3 * a + 5 * b + 7 * c <= 14)
    assert abs(sum(prices[i] * k for i, k in got.items()) - best) < 1e-9


def test_items_are_placed_whole(spark):
    sizes = spark.createDataFrame([("s", 10), ("l", 100), ("none", None), ("zero", 0)], "size_name string, capacity_tokens int")
    items = [(i, n) for i, n in enumerate([0, 1, 3, 10, 10, 11, 25, 7, 7, 7, 99, 100, 205, 0, 4, 6] + [5] * 40)]
    got = C.fill_containers(spark.createDataFrame(items, "doc_id long, tokens long"), sizes, item_rows=10).collect()
    for name, capacity in (("s", 10), ("l", 100)):
        load, pieces = {}, {}
        for r in got:
            if r.size_name == name:
                pieces.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
                if r.container >= 0:
                    load[r.container] = load.get(r.container, 0) + r.tokens
        assert max(load.values()) <= capacity and set(load) == set(range(len(load)))
        for i, n in items:
            p = sorted(pieces[i])
            assert sum(t for _, t in p) == n and [f for f, _ in p] == [sum(t for _, t in p[:k]) for k in range(len(p))]
            assert len(p) == max(1, -(-n // capacity))
        assert len(load) <= sum(n for _, n in items) / capacity * 1.1 + 2
    assert {r.size_name for r in got} == {"s", "l"}
    rates = {r.size_name: r for r in C.fill_rates(spark.createDataFrame(got), sizes).collect()}
    assert rates["s"].tokens == sum(n for _, n in items) and rates["s"].least <= rates["s"].containers


def test_empty(spark):
    sizes = spark.createDataFrame([("s", 10)], "size_name string, capacity_tokens int")
    assert C.fill_containers(spark.createDataFrame([], "doc_id long, tokens long"), sizes).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([(i, i % 2, i % 5) for i in range(200)], "id long, g long, n long")
    rows = running(df, ["g"], "id", "n", "at", 7).collect()
    for g in (0, 1):
        spans = sorted((r["at"], r.n) for r in rows if r.g == g and r.n)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
