"""Sums of latent vectors by window: equal to the grouped sum, without its cost."""

import numpy as np

from linesight.llm import decontaminate as D


def test_group_sums_equal_the_loop():
    rng = np.random.default_rng(3)
    vector = rng.standard_normal((50, 7)).astype(np.float32)
    sizes = rng.integers(1, 13, 400)
    f = rng.integers(0, 50, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    want = np.zeros((len(sizes), 7), np.float32)
    for g, (s, n) in enumerate(zip(starts, sizes, strict=True)):
        for x in f[s:s + n]:
            want[g] += vector[x]
    got = D._group_sums(vector, f, starts)
    assert got.dtype == np.float32 and np.array_equal(got, want)


def test_one_group_and_none():
    vector = np.arange(6, dtype=np.float32).reshape(3, 2)
    assert D._group_sums(vector, np.array([2, 0, 2]), np.array([0])).tolist() == [[8.0, 11.0]]
    assert D._group_sums(vector, np.zeros(0, int), np.zeros(0, int)).shape == (0, 2)
