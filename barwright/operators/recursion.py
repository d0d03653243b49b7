"""The sequential part of the indicators: one bounded run of bars of one series, inside a task.

Everything that can be an expression or a window is computed by Spark before and after; only values that feed
on their own predecessor live here. NaN stands for NULL.
"""

from __future__ import annotations

import math

import numpy as np

from ..schemas import AF_MAX_STEPS, AF_STEP, LONG, LOOKBACK_BARS, SHORT

NAN = math.nan

# Carried values of a series, in the order of a state tuple.
SMOOTHED = ("ag7", "ag14", "al7", "al14", "dm14_p", "dm14_n", "atr14", "atr28")
STATE = SMOOTHED + ("adx", "af_steps", "rising", "ep", "psar")
# Values a run yields per bar: the state, the previous averaged moves, whether the bar was seeded.
RESULTS = STATE + ("pdm14_p", "pdm14_n", "seeded")
# Columns a run needs per bar.
INPUTS = ("high", "low", "close", "ph", "pl", "pc", "ep15_h", "ep15_l")


def is_valid(state: tuple) -> bool:
    """Whether the next bar may step from this one: both RSI, ADX and the stop are defined."""
    short, long = state[0] + state[2], state[1] + state[3]
    adx, stop = state[8], state[12]
    return short == short and short != 0 and long == long and long != 0 and adx == adx and stop == stop


def with_moves(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The columns a step takes in, from a bar's prices and those of the bar before it."""
    change = cols["close"] - cols["pc"]
    rise, drop = cols["high"] - cols["ph"], cols["pl"] - cols["low"]
    return cols | {
        "tr": cols["high"] - cols["low"],
        "c_diff_p": np.where(change >= 0, change, 0.0),
        "c_diff_n": np.where(change < 0, -change, 0.0),
        "dm_p": np.where(rise >= drop, rise, 0.0),
        "dm_n": np.where(drop > rise, drop, 0.0),
    }


def _known_mean(values: np.ndarray) -> np.ndarray:
    """Row means over the values that are not NaN; NaN where there is none."""
    known = ~np.isnan(values)
    count = known.sum(axis=1)
    total = np.where(known, values, 0.0).sum(axis=1)
    return np.divide(total, count, out=np.full(len(values), NAN), where=count > 0)


def _trailing_sums(values: np.ndarray, width: int) -> np.ndarray:
    padded = np.concatenate([np.zeros((len(values), width - 1)), values], axis=1)
    return np.lib.stride_tricks.sliding_window_view(padded, width, axis=1).sum(axis=2)


def seed_states(rows: np.ndarray, slots: np.ndarray, cols: dict[str, np.ndarray]) -> np.ndarray:
    """States of the bars at positions ``rows`` from plain means over their 28 slots, with their previous averaged
    moves (columns by ``STATE``, then two). The first bar in reach has no predecessor there: its moves are zero.
    """
    at = rows[:, None] - np.arange(LOOKBACK_BARS - 1, -1, -1)
    inside = (at >= 0) & (slots[np.maximum(at, 0)] > slots[rows][:, None] - LOOKBACK_BARS)
    at = np.maximum(at, 0)
    count = np.cumsum(inside, axis=1)
    moved = count > 1
    gain, loss, plus, minus = (np.where(moved, cols[name][at], 0.0) for name in ("c_diff_p", "c_diff_n", "dm_p", "dm_n"))
    found = count[:, -1]
    short, long = np.minimum(found, SHORT), np.minimum(found, LONG)
    width = np.maximum(np.minimum(count, LONG), 1)
    up, down = _trailing_sums(plus, LONG) / width, _trailing_sums(minus, LONG) / width
    total = up + down
    dx = np.divide(up - down, total, out=np.full(total.shape, NAN), where=inside & (total != 0))
    span = np.where(inside, cols["tr"][at], NAN)
    falling = loss[:, -1] > 0
    ep = np.where(falling, cols["low"][rows], cols["high"][rows])
    start = np.where(falling, cols["ep15_h"][rows], cols["ep15_l"][rows])
    before = np.where(found > 1, LOOKBACK_BARS - 2, LOOKBACK_BARS - 1)
    line = np.arange(len(rows))
    return np.stack(
        [
            gain[:, -SHORT:].sum(axis=1) / short,
            gain[:, -LONG:].sum(axis=1) / long,
            loss[:, -SHORT:].sum(axis=1) / short,
            loss[:, -LONG:].sum(axis=1) / long,
            up[:, -1],
            down[:, -1],
            _known_mean(span[:, -LONG:]),
            _known_mean(span),
            _known_mean(np.abs(dx[:, -LONG:]) * 100),
            np.ones(len(rows)),
            np.where(falling, 0.0, 1.0),
            ep,
            start + AF_STEP * (ep - start),
            up[line, before],
            down[line, before],
        ],
        axis=1,
    )


class Seeds:
    """Seed states of a run: bars without a predecessor at once, others in short batches when first asked for."""

    BATCH = 32
    CHUNK = 8192

    def __init__(self, slots: np.ndarray, cols: dict[str, np.ndarray]):
        self.slots, self.cols = slots, cols
        alone = np.ones(len(slots), dtype=bool)
        alone[1:] = np.diff(slots) > 1
        wanted = np.flatnonzero(alone)
        self.known: dict[int, list[float]] = {}
        for part in range(0, len(wanted), self.CHUNK):
            self._add(wanted[part : part + self.CHUNK])

    def _add(self, rows: np.ndarray) -> None:
        if len(rows):
            self.known.update(zip(rows.tolist(), seed_states(rows, self.slots, self.cols).tolist()))

    def at(self, i: int) -> list[float]:
        if i not in self.known:
            self._add(np.arange(i, min(i + self.BATCH, len(self.slots))))
        return self.known[i]


def step_stop(steps: float, rising: float, ep: float, stop: float, high: float, low: float, tr: float) -> tuple:
    """Next ``(steps, rising, ep, stop)`` of the parabolic stop.

    The factor grows on every bar without a turn. The stop turns when its next value touches the bar.
    """
    if not (high == high and low == low and ep == ep):
        return _step_unknown_stop(steps, rising, ep, stop, high, low)
    if steps < AF_MAX_STEPS:
        steps += 1.0
    if rising:
        if high > ep:
            ep = high
        candidate = stop + steps / 50.0 * (ep - stop)
        if candidate >= low:
            # the new extreme is the low: it cannot lie above the old one
            start = max(ep, high + 0.1 * tr)
            ep = min(ep, low)
            return 1.0, 0.0, ep, start + AF_STEP * (ep - start)
    else:
        if low < ep:
            ep = low
        candidate = stop + steps / 50.0 * (ep - stop)
        if candidate <= high:
            start = min(ep, low - 0.1 * tr)
            ep = max(ep, high)
            return 1.0, 1.0, ep, start + AF_STEP * (ep - start)
    return steps, rising, ep, candidate


def _step_unknown_stop(steps: float, rising: float, ep: float, stop: float, high: float, low: float) -> tuple:
    """The same step where the extreme or a price is unknown: what depends on it becomes unknown."""
    price = high if rising else low
    if ep != ep or price != price:
        ep = NAN
    else:
        ep = max(ep, price) if rising else min(ep, price)
    steps = min(steps + 1.0, AF_MAX_STEPS)
    candidate = stop + steps / 50.0 * (ep - stop)
    if (candidate >= low) if rising else (candidate <= high):
        return 1.0, 1.0 - rising, NAN, NAN
    return steps, rising, ep, candidate


def step(state: tuple, gain: float, loss: float, up: float, down: float, tr: float, high: float, low: float) -> tuple:
    """State of a bar that directly follows a valid one: each average keeps (n-1)/n of its old value."""
    ag7, ag14, al7, al14, plus, minus, atr14, atr28, adx, steps, rising, ep, stop = state
    plus, minus = (plus * 13 + up) / 14, (minus * 13 + down) / 14
    total = plus + minus
    dx = 100.0 * abs((plus - minus) / total) if total != 0 else NAN
    return (
        (ag7 * 6 + gain) / 7, (ag14 * 13 + gain) / 14, (al7 * 6 + loss) / 7, (al14 * 13 + loss) / 14,
        plus, minus, (atr14 * 13 + tr) / 14, (atr28 * 27 + tr) / 28, (dx + adx * 13) / 14,
        *step_stop(steps, rising, ep, stop, high, low, tr),
    )


def apart(slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Slots of several series laid end to end, shifted so that no series is in reach of the one before it."""
    first = np.flatnonzero(starts)
    last = np.append(first[1:], len(slots)) - 1
    spans = slots[last] - slots[first] + LOOKBACK_BARS + 1
    shift = np.concatenate([[0], np.cumsum(spans)[:-1]]) - slots[first]
    return slots + np.repeat(shift, np.append(first[1:], len(slots)) - first)


CHUNK = 32
MOST_PASSES = 8
AVERAGED = (
    ("c_diff_p", 7), ("c_diff_p", 14), ("c_diff_n", 7), ("c_diff_n", 14), ("dm_p", 14), ("dm_n", 14), ("tr", 14), ("tr", 28),
)


def affine_scan(keep: np.ndarray, add: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """All values of ``v[i] = keep * v[i-1] + add[i]`` (columns apart), starting anew with ``add[i]`` where ``cut[i]``.

    A step is an affine map, and maps compose to maps: all chunks of the rows are run at once from an unknown start, as a multiple
    of that start and a rest; then the chunk ends are chained, and every row gets its start. Chunks are counted from the last cut, so a
    value does not depend on what lies before it. ``cut[0]`` must be true.
    """
    n, k = add.shape
    first = np.flatnonzero(cut)
    own = np.cumsum(cut) - 1
    offset = np.arange(n) - first[own]
    chunks = -(-np.diff(np.append(first, n)) // CHUNK)
    begin = np.cumsum(chunks) - chunks
    chunk, place = begin[own] + offset // CHUNK, offset % CHUNK
    rest = np.zeros((int(chunks.sum()), CHUNK, k))
    rest[chunk, place] = add
    times = np.cumprod(np.broadcast_to(keep, (CHUNK, k)), axis=0)
    for i in range(1, CHUNK):
        rest[:, i] += keep * rest[:, i - 1]
    head = np.zeros(len(rest), dtype=bool)
    head[begin] = True
    start = np.zeros((len(rest), k))
    for c in np.flatnonzero(~head).tolist():
        start[c] = rest[c - 1, -1] if head[c - 1] else times[-1] * start[c - 1] + rest[c - 1, -1]
    values = np.where(head[:, None, None], rest, times * start[:, None] + rest)
    return values[chunk, place]


def _stops(state: np.ndarray, cut: np.ndarray, bars: list[list[float]]) -> None:
    """Fills the stop's columns between the rows that start anew: the one part that has no map to compose."""
    out, current = state[:, 9:13].tolist(), None
    for i, (anew, tr, high, low) in enumerate(zip(cut.tolist(), *bars)):
        current = out[i] if anew else step_stop(*current, high, low, tr)
        out[i] = current
    state[:, 9:13] = out


def _states(starts: np.ndarray, anew: np.ndarray, adds: np.ndarray, bars: list[list[float]]) -> np.ndarray:
    """States of all bars, given which of them start anew and from what."""
    n = len(anew)
    keep = np.array([(length - 1) / length for _, length in AVERAGED])
    state = np.empty((n, len(STATE)))
    state[:, :8] = affine_scan(keep, np.where(anew[:, None], starts[:, :8], adds), anew)
    plus, minus = state[:, 4], state[:, 5]
    total = plus + minus
    dx = 100.0 * np.abs(np.divide(plus - minus, total, out=np.full(n, NAN), where=total != 0))
    state[:, 8:9] = affine_scan(np.array([(LONG - 1) / LONG]), np.where(anew, starts[:, 8], dx / LONG)[:, None], anew)
    state[:, 9:] = starts[:, 9 : len(STATE)]
    _stops(state, anew, bars)
    return state


def run_series(
    slots: np.ndarray,
    cols: dict[str, np.ndarray],
    given: dict[int, tuple] | None = None,
    reseed: bool = True,
) -> np.ndarray:
    """Results (rows by ``RESULTS``) for bars in time order; NaN rows where a bar has no state.

    A bar steps if the slot before it has a valid state, and is seeded otherwise. Without ``reseed`` it steps from
    whatever the slot before holds and stays without state if that is missing. ``given`` states the true state of
    bars (by position) the run continues from.

    The averages are scans. Which bars start anew follows from their values: it is assumed, computed and corrected until it
    holds. Seeds tell by themselves whether the next bar may step, so one pass does unless a value becomes unknown on the way.
    """
    n, given = len(slots), given or {}
    if not n:
        return np.empty((0, len(RESULTS)))
    moved = with_moves(cols)
    alone, held = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
    alone[1:] = np.diff(slots) != 1
    held[list(given)] = True
    adds = np.stack([moved[name] / length for name, length in AVERAGED], axis=1)
    bars = [moved[name].tolist() for name in ("tr", "high", "low")]
    starts = np.full((n, len(STATE) + 2), NAN)
    for i, values in given.items():
        starts[i, : len(STATE)] = values
    anew, seeds = alone | held, Seeds(slots, moved) if reseed else None
    asked = np.flatnonzero(alone & ~held)
    for _ in range(MOST_PASSES):
        if reseed:
            for i in asked.tolist():
                # behind a seed that is not valid itself the next bar is seeded too
                while True:
                    anew[i], starts[i] = True, seeds.at(i)
                    if is_valid(starts[i]) or i + 1 == n or anew[i + 1]:
                        break
                    i += 1
        state = _states(starts, anew, adds, bars)
        if not reseed:
            break
        short, long = state[:, 0] + state[:, 2], state[:, 1] + state[:, 3]
        valid = (short > 0) & (long > 0) & ~np.isnan(state[:, 8]) & ~np.isnan(state[:, 12])
        behind = np.flatnonzero(~valid[:-1] & ~anew[1:]) + 1
        if not len(behind):
            break
        # what is unknown stays so up to the next start: the first of each run counts
        run = np.cumsum(anew)[behind]
        asked = behind[np.concatenate([[True], run[1:] != run[:-1]])]
    else:
        return run_by_bar(slots, cols, given, reseed)
    out = np.full((n, len(RESULTS)), NAN)
    out[:, : len(STATE)] = state
    stepped, seeded = np.flatnonzero(~anew), anew & ~held
    out[stepped, 13:15], out[stepped, 15] = state[stepped - 1, 4:6], 0.0
    if reseed:
        out[seeded, 13:15], out[seeded, 15] = starts[seeded, 13:15], 1.0
    else:
        # nothing to step from: no state, up to the next bar that is given
        first = np.flatnonzero(anew)
        out[seeded[first[np.searchsorted(first, np.arange(n), side="right") - 1]]] = NAN
    return out


def run_by_bar(
    slots: np.ndarray, cols: dict[str, np.ndarray], given: dict[int, tuple] | None = None, reseed: bool = True
) -> np.ndarray:
    """``run_series`` bar by bar: the plain form of the rule, and the way out where starts do not settle."""
    cols = with_moves(cols)
    given = given or {}
    blank = (NAN,) * len(RESULTS)
    out = []
    seeds = Seeds(slots, cols) if reseed else None
    state, usable, expected = None, False, None
    moves = zip(*(cols[name].tolist() for name in ("c_diff_p", "c_diff_n", "dm_p", "dm_n", "tr", "high", "low")))
    for i, (time, bar) in enumerate(zip(slots.tolist(), moves)):
        if usable and time == expected and i not in given:
            before = state
            state = step(before, *bar)
            out.append((*state, before[4], before[5], 0.0))
        elif i in given:
            state = given[i]
            out.append((*state, NAN, NAN, NAN))
        elif reseed:
            seeded = seeds.at(i)
            state = tuple(seeded[: len(STATE)])
            out.append((*seeded, 1.0))
        else:
            state = None
            out.append(blank)
        expected = time + 1
        usable = state is not None and (not reseed or is_valid(state))
    return np.array(out, dtype=float).reshape(len(out), len(RESULTS))
