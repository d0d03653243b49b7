import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators.forecast import PHI_LIMIT, Z95, _summaries, fit_symbols, forecast_next, with_differences
from helpers import candle, candles, walk


def brute_force(closes):
    """The same fit on one array: every theta, its best phi, residuals by their definition."""
    w = np.diff(closes, n=2)
    best = None
    for theta in sorted(np.arange(-99, 100) / 100.0, key=lambda t: (abs(t), t)):
        a = np.zeros(len(w))
        before = 0.0
        for t, value in enumerate(w):
            before = a[t] = value - theta * before
        shifted = np.concatenate([[0.0], a[:-1]])
        bottom = (shifted * shifted).sum()
        phi = (a * shifted).sum() / bottom if bottom else 0.0
        phi = max(-PHI_LIMIT, min(PHI_LIMIT, phi))
        residuals = []
        error = previous = 0.0
        for value in w:
            error = value - phi * previous - theta * error
            previous = value
            residuals.append(error)
        residuals = np.array(residuals)
        sse = (residuals**2).sum()
        misfit = round(sse / (w * w).sum(), 10)
        if best is None or misfit < best[0]:
            best = misfit, sse, theta, phi, residuals
    _, sse, theta, phi, residuals = best
    ahead = 2 * closes[-1] - closes[-2] + phi * w[-1] + theta * residuals[-1]
    spread = Z95 * np.sqrt(sse / len(w))
    mean = np.mean(closes)
    return {
        "next_pred": ahead, "lower": ahead - spread, "upper": ahead + spread, "mse": sse / len(w) / mean,
        "mae": np.abs(residuals).mean() / mean, "phi": phi, "theta": theta,
    }


ROWS = walk("A", range(150), 1) + walk("B", [s for s in range(300) if s % 3], 2) + walk("C", [0, 90, 91, 250], 3)


@pytest.mark.parametrize("block_seconds", [10**9, 40 * 300, 7 * 300, 300])
def test_fit_equals_brute_force_however_series_are_cut(spark, block_seconds):
    got = {r.symbol: r for r in fit_symbols(candles(spark, ROWS), block_seconds).collect()}
    for symbol in "ABC":
        closes = np.array([r[5] for r in sorted(ROWS, key=lambda r: r[1]) if r[0] == symbol])
        for name, value in brute_force(closes).items():
            assert got[symbol][name] == pytest.approx(value, rel=1e-8, abs=1e-8), (symbol, name)
        assert got[symbol].last_price == closes[-1]


def test_look_back_limits_the_fit(spark):
    recent = [r for r in ROWS if r[0] == "A" and r[1] >= 100 * 300]
    whole, part = candles(spark, [r for r in ROWS if r[0] == "A"]), candles(spark, recent)
    cut = forecast_next(whole, as_of=149 * 300, seconds=49 * 300).collect()
    assert cut == forecast_next(part, seconds=None).collect()
    assert cut != forecast_next(whole, seconds=None).collect()


def test_straight_line_is_continued(spark):
    row = fit_symbols(candles(spark, [candle("L", 300 * s, 1, 1, 10 + 3 * s) for s in range(50)])).first()
    assert (row.next_pred, row.lower, row.upper, row.mse, row.mae) == (160.0, 160.0, 160.0, 0.0, 0.0)


def test_symbols_in_one_block_are_compared_in_their_task(spark):
    rows = candles(spark, ROWS + [candle("S", 300, 1, 1, 5)] + [candle("L", 300 * s, 1, 1, 3 * s) for s in range(9)])
    for slots, symbols in ((10**6, "ABCLS"), (200, "ALS"), (40, "LS")):
        series = with_differences(rows.withColumn("block", F.expr(f"open_time div {300 * slots}")))
        handed = {r.symbol: (r.rows, r.blocks) for r in _summaries(series).groupBy("symbol").agg(
            F.count(F.lit(1)).alias("rows"), F.countDistinct("block").alias("blocks")).collect()}
        for symbol in "ABCLS":
            count, blocks = handed[symbol]
            assert count == 1 if symbol in symbols else count == 199 * blocks, (slots, symbol, count)
