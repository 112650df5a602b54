"""Assignments over edges instead of matrices."""

import itertools
import tracemalloc

import numpy as np
import pandas as pd

from quern.operators import matching


def test_sparse_assignment_is_the_dense_one():
    rng = np.random.default_rng(6)
    for k in range(80):
        n, m = (int(x) for x in rng.integers(1, 7, 2))
        at = rng.choice(n * m, int(rng.integers(1, n * m + 1)), replace=False)
        cost = dict(zip([(int(i) // m, int(i) % m) for i in at], rng.random(len(at)) if k % 2 else rng.integers(0, 3, len(at)).astype(float)))
        sets = (x for size in range(min(n, m), 0, -1) for x in [list(itertools.combinations(cost, size))] for x in [[p for p in x if len({a for a, _ in p}) == len({b for _, b in p}) == size]] if x)
        best = next(sets)
        got = matching._solve(pd.DataFrame([(a, b, c) for (a, b), c in cost.items()], columns=["src_idx", "ref_idx", "cost"]), "cost")
        assert got.src_idx.is_unique and got.ref_idx.is_unique and len(got) == len(best[0])
        assert np.isclose(got.cost.sum(), min(sum(cost[e] for e in p) for p in best))


def test_one_large_component():
    """A chain of 20,000 sources, which a dense matrix would make 6 GB."""
    i = np.arange(20_000)
    edges = pd.DataFrame({"src_idx": np.concatenate([i, i]), "ref_idx": np.concatenate([i, i + 1]), "cost": np.concatenate([i % 7 + 1.0, i % 5 + 1.0])})
    tracemalloc.start()
    got = matching._solve(edges, "cost")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 20_000 and got.ref_idx.is_unique and peak < 100 << 20
    prefix = np.concatenate([[0], np.cumsum(i % 7 + 1.0)])
    suffix = np.concatenate([np.cumsum((i % 5 + 1.0)[::-1])[::-1], [0]])
    assert got.cost.sum() == (prefix + suffix).min()


def test_sizes_of_more_rows_than_a_matrix_takes(spark):
    n = 5200
    rng = np.random.default_rng(7)
    area, feret = rng.uniform(1, 1e6, n), rng.uniform(1, 1e3, n)
    rows = lambda order: spark.createDataFrame([(k, float(area[i]), float(feret[i]), float(i), 0.0) for k, i in enumerate(order)], "row_idx long, area_um2 double, feret_max_um double, x_um double, y_um double")
    shuffled = rng.permutation(n)
    got = matching.size_join(rows(range(n)), rows(shuffled))
    assert got.filter("x_um = row_idx and coord_match_cost < 1e-9").count() == got.count() == n


def test_size_assignment_is_optimal():
    rng = np.random.default_rng(8)
    for n, m in ((40, 60), (130, 140), (150, 150)):
        a, b = rng.normal(size=(n, 2)).round(1), rng.normal(1.0, 2.0, (m, 2)).round(1)
        a[::9, 0], b[::7, 1] = np.nan, np.nan
        cost = matching._size_costs(a, b)
        got, want = matching.size_assignment(a, b), matching.assignment(cost)
        assert len(set(got)) == n and np.isclose(cost[np.arange(n), got].sum(), cost[np.arange(n), want].sum())
