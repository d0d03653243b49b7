"""The scan over a run of bars against the same rule bar by bar."""

import numpy as np
import pytest

from barwright.operators.recursion import RESULTS, STATE, affine_scan, run_by_bar, run_series
from barwright.streaming.signals import bounded_columns


def series(seed, n, flat=0.0, gaps=0.0, unknown=0.0):
    rng = np.random.default_rng(seed)
    slots = np.flatnonzero(rng.random(int(n / (1 - gaps)) + 1) >= gaps)[:n]
    close = 1000.0 + np.cumsum(np.where(rng.random(len(slots)) < flat, 0, rng.integers(-30, 31, len(slots))))
    move = np.where(rng.random(len(slots)) < flat, 0, 1)
    high, low = close + move * rng.integers(0, 20, len(slots)), close - move * rng.integers(0, 9, len(slots))
    for values in (high, low, close):
        values[rng.random(len(slots)) < unknown] = np.nan
    return slots, bounded_columns(slots, high, low, close)


def same(a, b):
    assert a.shape == b.shape
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.allclose(a, b, rtol=1e-11, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("reseed", [True, False])
@pytest.mark.parametrize("n,flat,gaps,unknown", [
    (1, 0, 0, 0), (2, 0, 0, 0), (127, 0, 0, 0), (129, 0, 0.1, 0), (3000, 0, 0, 0), (3000, 0.3, 0.02, 0), (2000, 0.99, 0, 0),
    (700, 1.0, 0, 0), (900, 0.1, 0.01, 0.02),
])
def test_scan_equals_bar_by_bar(n, flat, gaps, unknown, reseed):
    slots, cols = series(n + 7, n, flat, gaps, unknown)
    state = tuple([5.0, 4.0, 3.0, 2.0, 6.0, 1.0, 9.0, 8.0, 30.0, 4.0, 1.0, 1000.0, 950.0])
    last = len(slots) - 1
    for given in ({}, {0: state}, {last // 2: state}, {0: state, last: state}):
        same(run_series(slots, cols, given, reseed), run_by_bar(slots, cols, given, reseed))


def test_starts_that_do_not_settle_are_run_bar_by_bar(monkeypatch):
    from barwright.operators import recursion

    slots, cols = series(3, 500, flat=0.97)
    truth = run_by_bar(slots, cols)
    monkeypatch.setattr(recursion, "MOST_PASSES", 1)
    same(run_series(slots, cols), truth)


def test_affine_scan():
    rng = np.random.default_rng(1)
    for n in (1, 5, 128, 1000):
        add, keep, cut = rng.standard_normal((n, 3)), np.array([0.9, 0.5, 1.0]), rng.random(n) < 0.01
        cut[0] = True
        value, rows = None, []
        for i in range(n):
            value = add[i] if cut[i] else keep * value + add[i]
            rows.append(value)
        assert np.allclose(affine_scan(keep, add, cut), rows)


def test_columns():
    assert RESULTS[: len(STATE)] == STATE and STATE[8] == "adx" and STATE[9:] == ("af_steps", "rising", "ep", "psar")
