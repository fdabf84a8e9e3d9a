import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from chronoloom.operators import hierarchy as H


def brute(links):
    """{node: (root, depth)} by walking."""
    out = {}
    for v in links:
        seen, x = [], v
        while True:
            seen.append(x)
            n = links[x]
            if n is None or n not in links:
                out[v] = (x, len(seen) - 1)
                break
            if n in seen:
                cycle = seen[seen.index(n) :]
                out[v] = (min(cycle), H.ON_CYCLE if v in cycle else H.TO_CYCLE)
                break
            x = n
    return out


def random_links(n, seed, wild=0.2):
    r = random.Random(seed)
    ids = r.sample(range(10 * n), n)
    return {v: (None if r.random() < 0.1 else r.choice(ids) if r.random() < wild else ids[min(n - 1, i + r.randrange(1, 4))] if r.random() < 0.95 else 10**7 + i) for i, v in enumerate(ids)}


@given(st.dictionaries(st.integers(0, 40), st.one_of(st.none(), st.integers(0, 45)), min_size=1))
def test_block_resolves_like_walking(links):
    v = np.array(sorted(links))
    has = np.array([links[x] is not None for x in v.tolist()])
    p = np.array([links[x] or 0 for x in v.tolist()])
    r, want = H.forest(v, p, has), brute(links)
    for i, x in enumerate(v.tolist()):
        kind, (root, depth) = r["kind"][i], want[x]
        if kind == H.OPEN:
            assert r["dist"][i] == depth + 1 and r["last"][i] == root and r["exit"][i] == links[root]
        else:
            assert r["last"][i] == root and (r["dist"][i] if kind == H.ROOT else {H.CYCLE: -1, H.TAIL: -2}[kind]) == depth


@pytest.mark.parametrize("merge_rows", [1_000_000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_merge_to_the_whole(spark, merge_rows, seed):
    links = random_links(300, seed)
    rows = [(v, p, v % 3) for v, p in links.items()]
    df = spark.createDataFrame(rows + rows[:20] + [(None, 5, 0)], "id long, up long, place long")
    got = {r.id: (r.root, r.depth) for r in H.resolve_hierarchy(df, "id", "up", "place", block_rows=40, merge_rows=merge_rows).collect()}
    assert got == brute(links)


def test_a_cycle_through_many_blocks(spark):
    n = 200
    links = {i: (i + 1) % n for i in range(n)} | {1000 + i: i for i in range(0, n, 7)} | {2000: 1000}
    df = spark.createDataFrame([(v, p) for v, p in links.items()], "id long, up long")
    got = {r.id: (r.root, r.depth) for r in H.resolve_hierarchy(df, "id", "up", block_rows=20).collect()}
    assert got == brute(links)


@pytest.mark.parametrize("merge_rows", [60, 5, 0])
def test_many_levels_of_merging(spark, merge_rows):
    """Tiny blocks and a tiny last one: long chains, wild links, cycles through many blocks with tails, all merged in several levels."""
    n = 150
    links = {i: (i + 1) % n for i in range(n)} | {1000 + i: i for i in range(0, n, 7)} | {2000: 1000} | {5000 + i: 5000 + (i * 37 + 11) % 151 for i in range(151)} | {9000 + i: 9001 + i for i in range(120)} | {k + 100_000: v and v + 100_000 for k, v in random_links(200, 9, 0.6).items()}
    df = spark.createDataFrame([(v, p, v % 5) for v, p in links.items()], "id long, up long, place long")
    got = {r.id: (r.root, r.depth) for r in H.resolve_hierarchy(df, "id", "up", "place", block_rows=20, merge_rows=merge_rows).collect()}
    assert got == brute(links)


def test_paths_and_descendants(spark):
    links = {1: 2, 2: 3, 3: None, 4: 3, 5: 99, 6: 7, 7: 6, 8: 7, 9: 9} | {100 + i: 101 + i for i in range(60)}
    df = spark.createDataFrame([(v, p, "x", v) for v, p in links.items()], "id long, up long, path string, root long")
    want = brute(links)
    got = {r.id: r for r in H.hierarchy_paths(df, "id", "up", block_rows=10).collect()}
    assert {k: (r.root, r.depth) for k, r in got.items()} == want
    for v, (root, depth) in want.items():
        path, x = [v], v
        while depth >= 0 and x != root:
            x = links[x]
            path.append(x)
        assert got[v].path == (path if depth >= 0 else None)
    below = dict.fromkeys(links, 0)
    for v in links:
        seen, x = {v}, links[v]
        while x in links and x not in seen:
            seen.add(x)
            below[x] += 1
            x = links[x]
    assert {v: r.descendants for v, r in got.items()} == below


@pytest.mark.parametrize("links", [{1: 2, 2: 3, 3: None, 4: 3, 5: 99, 6: 7, 7: 6, 8: 7, 9: 9, 10: 9, 11: 8} | {100 + i: 100 + (i + 1) % 30 for i in range(30)} | {200 + i: 201 + i for i in range(30)} | {230: 105}, {1: 2, 2: None}, {}])
def test_descendants_also_on_and_towards_cycles(spark, links):
    df = spark.createDataFrame([(v, p, v % 3) for v, p in links.items()], "id long, up long, v long")
    want = []
    for v in links:
        seen, x = {v}, links[v]
        while x in links and x not in seen:
            seen.add(x)
            want.append((x, v))
            x = links[x]
    assert sorted(tuple(r) for r in H.descendants(df, "id", "up", "v", block_rows=10).collect()) == sorted(want)


def test_empty_table_and_several_parents(spark):
    assert H.resolve_hierarchy(spark.createDataFrame([], "id long, up long"), "id", "up").count() == 0
    df = spark.createDataFrame([(1, 3), (1, 2), (2, None), (3, None)], "id long, up long")
    assert {r.id: r.root for r in H.resolve_hierarchy(df, "id", "up").collect()} == {1: 2, 2: 2, 3: 3}
