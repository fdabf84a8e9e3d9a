import numpy as np
import pytest

from chronoloom.llm import mixture as M

TARGET = "mix_id string, source string, target_weight double, max_repeats int, tokens long"


def run(spark, docs, targets, **more):
    return M.mix_sources(spark.createDataFrame(docs, "doc_id long, source string, tokens long"), spark.createDataFrame(targets, TARGET), **more)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 1000])
def test_permutation(n):
    for key in (0, 5, 2**40):
        got = M.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_draws_are_multinomial():
    """Counts add up, repeat for the same seed, and vary over seeds as a multinomial draw does (chi-square, 5 sigma)."""
    mix = {"slots": 10_000, "weights": np.array([0.123, 0.377, 0.5])}
    counts = np.array([M.draw_counts(mix, "m", s, 64, 7) for s in range(157)])
    assert counts.sum(1).tolist() == [64] * 156 + [16]
    assert (counts == np.array([M.draw_counts(mix, "m", s, 64, 7) for s in range(157)])).all()
    drawn = np.array([M.draw_counts(mix, "m", 0, 64, seed) for seed in range(3000)])
    statistic = ((drawn - 64 * mix["weights"]) ** 2 / (64 * mix["weights"])).sum()  # chi-square with 2 degrees of freedom a draw
    assert abs(statistic - 6000) < 5 * np.sqrt(2 * 6000)
    assert (abs(drawn.mean(0) - 64 * mix["weights"]) < 5 * np.sqrt(64 * mix["weights"] * (1 - mix["weights"]) / 3000)).all()


def test_shares_caps_and_contents(spark):
    docs = [(i, "big", 50 + i % 90) for i in range(600)] + [(1000 + i, "small", 30) for i in range(40)] + [(2000, "big", 0), (2001, "unused", 99)]
    targets = [("m", "big", 3.0, None, 0), ("m", "small", 1.0, 4, 0), ("m", "absent", 1.0, 1, 0), ("m", "off", 0.0, 1, 0), ("m", "none", None, 1, 0), ("n", "small", 1.0, 1, 0)]
    selection, shares = run(spark, docs, targets, block_tokens=64, shard_slots=16)
    rows = selection.collect()
    used = {}
    for r in rows:
        used.setdefault((r.mix_id, r.source, r.block), set()).add(r.slot)
    assert max(len(v) for k, v in used.items() if k[:2] == ("m", "small")) <= 4
    assert max(len(v) for k, v in used.items() if k[0] == "n") == 1
    by = {(r.mix_id, r.source): r for r in shares.collect()}
    assert set(by) == {t[:2] for t in targets}
    assert abs(by["m", "big"].reached_share - 0.75) < 0.08 and by["m", "absent"].reached_share == 0 and by["m", "absent"].target_share == 0.2
    assert by["m", "small"].repeats <= 4 and by["n", "small"].reached_share == 1 and by["n", "small"].tokens == 1200
    # A block drawn is drawn whole: its pieces are those of its documents.
    size = {i: n for i, _, n in docs}
    for r in rows:
        assert 0 <= r.first_token and r.first_token + r.tokens <= size[r.doc_id] and r.tokens > 0
    once = {(r.doc_id, r.first_token): r.tokens for r in rows if r.mix_id == "n"}
    assert sum(once.values()) == 1200
    again, _ = run(spark, docs[::-1], targets, block_tokens=64, shard_slots=16)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_empty(spark):
    for docs, targets in (([], [("m", "a", 1.0, 1, 0)]), ([(1, "a", 5)], [])):
        selection, shares = run(spark, docs, targets)
        assert selection.count() == 0 and shares.count() == len(targets)
