"""Smoothing of long tiles."""

import tracemalloc

import numpy as np

from quern.operators import imaging


def test_wide_smoothing_takes_the_memory_of_its_tile():
    tile = np.random.default_rng(9).random((20_000, 8))
    tracemalloc.start()
    got = imaging.gaussian(tile, 1200.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    r = 4800
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / 1200.0) ** 2)
    k /= k.sum()
    lines = np.concatenate([tile[r - 1 :: -1], tile, tile[: -r - 1 : -1]])
    rows = np.stack([k @ lines[y : y + 2 * r + 1] for y in (0, 777, 19_999)])
    at = np.where((np.arange(-r, 8 + r) % 16) < 8, np.arange(-r, 8 + r) % 16, 15 - np.arange(-r, 8 + r) % 16)
    want = np.stack([rows[:, at[x : x + 2 * r + 1]] @ k for x in range(8)], 1)
    assert np.allclose(got[[0, 777, 19_999]], want)
