import numpy as np

from passagemill.llm import maxent


def test_sums_of_runs_are_those_of_reduceat_to_the_bit():
    rng = np.random.default_rng(5)
    for most in (1, 4, 7, 300):
        times = rng.integers(1, most + 1, size=200)
        first = np.cumsum(times) - times
        values = rng.normal(size=(500, maxent.FAN)).astype(np.float32)
        at = rng.integers(0, 500, size=int(times.sum()))
        want = np.add.reduceat(values[at], first, axis=0)
        assert np.array_equal(maxent.run_sums(values, at, first, times), want)


def test_gradients_are_the_same_with_short_and_long_sort_keys():
    rng = np.random.default_rng(6)
    table = rng.normal(size=(3000, maxent.FAN)).astype(np.float32)
    rows, goal = rng.integers(0, 3000, size=(8192, 4)).astype(np.int32), rng.integers(0, maxent.FAN, size=8192)
    large = np.zeros((1 << 18, maxent.FAN), dtype=np.float32)
    large[:3000] = table
    for short, long in zip(maxent.gradient(table, rows, goal), maxent.gradient(large, rows, goal), strict=True):
        assert short.dtype == long.dtype and np.array_equal(short, long)
