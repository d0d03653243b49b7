import math

import numpy as np
import pytest

from barwright.operators.recursion import RESULTS, STATE, apart, is_valid, run_series, step, step_stop
from barwright.streaming.signals import bounded_columns

NAN = math.nan


def run(slots, high, low, close, **options):
    arrays = [np.asarray(v, dtype=float) for v in (high, low, close)]
    slots = np.asarray(slots, dtype=np.int64)
    return run_series(slots, bounded_columns(slots, *arrays), **options)


def column(results, name):
    return results[:, RESULTS.index(name)].tolist()


def test_stop_turns_when_it_touches_the_bar():
    # falling, candidate 10 + 0.04 * (10 - 10) = 10
    assert step_stop(1, 0.0, 10.0, 10.0, 10.0, 10.0, 0.0) == (1.0, 1.0, 10.0, 10.0)
    assert step_stop(1, 0.0, 10.0, 11.0, 10.0, 10.0, 0.0)[1] == 0.0
    # rising
    assert step_stop(1, 1.0, 10.0, 10.0, 10.0, 10.0, 0.0) == (1.0, 0.0, 10.0, 10.0)
    assert step_stop(1, 1.0, 10.0, 9.0, 10.0, 10.0, 0.0)[1] == 1.0


def test_values_after_a_turn():
    # falling, extreme 8, stop 9 -> candidate 9 + 0.04 * (7 - 9) <= high 12
    steps, rising, ep, stop = step_stop(1, 0.0, 8.0, 9.0, 12.0, 7.0, 5.0)
    start = min(7.0, 7.0 - 0.1 * 5.0)
    assert (steps, rising, ep) == (1.0, 1.0, 12.0)
    assert stop == start + 0.02 * (12.0 - start)


def test_factor_grows_every_bar_up_to_ten_steps():
    state, seen = (1.0, 1.0, 100.0, 0.0), []
    for _ in range(14):
        state = step_stop(*state, 100.0, 99.0, 1.0)
        seen.append(state[0])
    assert seen == [min(k, 10) for k in range(2, 16)]


def test_unknown_extremes_stay_unknown():
    steps, rising, ep, stop = step_stop(1, 1.0, 10.0, 5.0, NAN, 9.0, NAN)
    assert rising == 1.0 and math.isnan(ep) and math.isnan(stop)


def test_averages_keep_their_share():
    state = (7.0, 14.0, 7.0, 14.0, 14.0, 28.0, 14.0, 28.0, 14.0, 1.0, 1.0, 10.0, 5.0)
    after = step(state, 0.0, 14.0, 0.0, 0.0, 0.0, 10.0, 9.0)
    assert after[:8] == (6.0, 13.0, 8.0, 14.0, 13.0, 26.0, 13.0, 27.0)
    assert after[8] == (100 * abs((13 - 26) / 39) + 14.0 * 13) / 14


def test_validity_needs_every_value():
    good = (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 20.0, 1.0, 1.0, 10.0, 5.0)
    assert is_valid(good)
    for at, value in ((8, NAN), (12, NAN)):
        assert not is_valid(good[:at] + (value,) + good[at + 1 :])
    assert not is_valid((0.0, 1.0, 0.0, 1.0) + good[4:])


def test_first_bar_is_invalid_so_the_second_is_seeded_too():
    results = run(range(5), [10, 12, 13, 12, 14], [9, 10, 11, 10, 12], [10, 11, 12, 11, 13])
    assert column(results, "seeded") == [1.0, 1.0, 0.0, 0.0, 0.0]


def test_missing_bar_starts_again():
    slots = [0, 1, 2, 3, 5, 6]
    results = run(slots, [10, 12, 13, 12, 14, 15], [9, 10, 11, 10, 12, 13], [10, 11, 12, 11, 13, 14])
    assert column(results, "seeded") == [1.0, 1.0, 0.0, 0.0, 1.0, 0.0]


def test_flat_bars_are_seeded_until_they_move():
    n = 20
    close = [10] * n + [11, 12]
    results = run(range(n + 2), [c + 1 for c in close], [c - 1 for c in close], close)
    assert column(results, "seeded")[:n + 1] == [1.0] * (n + 1)


def test_without_reseeding_a_chain_ends_at_a_gap_and_needs_a_given_state():
    slots = [0, 1, 2, 4]
    prices = [10, 12, 13, 12], [9, 10, 11, 10], [10, 11, 12, 11]
    assert np.isnan(run(slots, *prices, reseed=False)).all()
    start = run(slots, *prices)[1, : len(STATE)]
    results = run(slots, *prices, given={1: tuple(start)}, reseed=False)
    assert column(results, "seeded")[2] == 0.0
    assert np.isnan(results[3]).all()


def test_unknown_adx_is_permanent_without_reseeding():
    state = (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, NAN, 1.0, 1.0, 10.0, 5.0)
    results = run(range(4), [10, 12, 13, 12], [9, 10, 11, 10], [10, 11, 12, 11], given={0: state}, reseed=False)
    assert all(math.isnan(v) for v in column(results, "adx"))
    assert not any(math.isnan(v) for v in column(results, "psar"))


def test_series_laid_end_to_end_do_not_touch():
    slots = np.array([5, 6, 7, 0, 1, 90])
    moved = apart(slots, np.array([True, False, False, True, False, False]))
    assert moved.tolist()[:3] == [0, 1, 2]
    assert moved[3] - moved[2] > 28 and (moved[4:] - moved[3]).tolist() == [1, 90]


@pytest.mark.parametrize("seed", range(5))
def test_end_to_end_run_equals_separate_runs(seed):
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(6):
        n = int(rng.integers(1, 80))
        slots = np.flatnonzero(rng.random(2 * n) < 0.8)[:n] + int(rng.integers(0, 1000))
        low = rng.integers(50, 100, len(slots)).astype(float)
        high = low + rng.integers(0, 30, len(slots))
        parts.append((slots, high, low, np.clip(low + rng.integers(0, 30, len(slots)), low, high)))
    parts = [part for part in parts if len(part[0])]
    separate = [run(*part) for part in parts]
    columns = [bounded_columns(*part) for part in parts]
    joined = {name: np.concatenate([c[name] for c in columns]) for name in columns[0]}
    starts = np.concatenate([[True] + [False] * (len(part[0]) - 1) for part in parts])
    together = run_series(apart(np.concatenate([part[0] for part in parts]), starts), joined)
    assert np.array_equal(together, np.concatenate(separate), equal_nan=True)
