from pyspark.sql import functions as F

from barwright.operators import indicators as ind
from barwright.operators.bars import resample
from barwright.operators.blocks import over_blocks
from barwright.operators.seeds import seed_all, seed_at, seed_latest
from barwright.sources import market
from helpers import assert_same, candle, candles, walk

KEY = ("bar_interval", "symbol", "bar_start")


def bars_of(spark, rows, label="5m"):
    return ind.with_slot(resample(candles(spark, rows), [label]))


def ordered(df):
    return df.orderBy("symbol", "slot").collect()


def test_previous_bar_is_the_bar_itself_at_the_start_and_out_of_reach(spark):
    rows = [candle("A", 300 * s, 10 + s, s, 5 + s) for s in (0, 1, 28, 56)]
    got = [(r.slot, r.ph, r.pl, r.pc) for r in ordered(ind.with_previous(bars_of(spark, rows)))]
    # slot 28 is 27 slots after 1: in reach; slot 56 is 28 slots after 28: not
    assert got == [(0, 10, 0, 5), (1, 10, 0, 5), (28, 11, 1, 6), (56, 66, 56, 61)]


def test_null_of_the_previous_bar_stays_null(spark):
    rows = [candle("A", 0, None, 1, 5), candle("A", 300, 9, 1, 5)]
    assert ordered(ind.with_previous(bars_of(spark, rows)))[1].ph is None


def test_moves_tie_counts_as_up_and_nothing_is_clamped(spark):
    rows = [candle("A", 0, 10, 5, 7), candle("A", 300, 12, 3, 7),  # both 2
            candle("B", 0, 10, 5, 7), candle("B", 300, 9, 6, 7),  # both -1
            candle("C", 0, 10, 5, 7), candle("C", 300, 8, 6, 6)]  # -2 and -1
    got = {r.symbol: r for r in ordered(ind.with_moves(ind.with_previous(bars_of(spark, rows)))) if r.slot == 1}
    assert (got["A"].dm_p, got["A"].dm_n) == (2.0, 0.0)
    assert (got["B"].dm_p, got["B"].dm_n) == (-1.0, 0.0)
    assert (got["C"].dm_p, got["C"].dm_n) == (0.0, -1.0)
    assert (got["C"].c_diff_p, got["C"].c_diff_n, got["C"].tr) == (0.0, 1.0, 2.0)


def test_seed_extremes_take_one_bar_more_than_step_extremes(spark):
    rows = [candle("A", 300 * s, 100 - s, 50 - s, 60 - s) for s in range(40)]
    last = ordered(ind.with_extremes(bars_of(spark, rows)))[-1]
    assert (last.ep14_h, last.ep15_h, last.ep28_h) == (100 - 26, 100 - 25, 100 - 12)
    assert (last.ep14_l, last.ep28_l) == (50 - 39, 50 - 39)


def test_extremes_do_not_reach_back_more_than_28_slots(spark):
    rows = [candle("A", 0, 500, 1, 60)] + [candle("A", 300 * s, 100, 50, 60) for s in (20, 40)]
    last = ordered(ind.with_extremes(bars_of(spark, rows)))[-1]
    assert (last.ep14_h, last.ep28_h, last.ep28_l) == (100.0, 100.0, 50.0)


def test_flat_series_has_no_rsi_and_a_zero_spread_is_a_cross(spark):
    rows = [candle("A", 300 * s, 10, 10, 10) for s in range(20)]
    last = ordered(ind.seed_signals(bars_of(spark, rows)))[-1]
    assert (last.rsi7, last.rsi14, last.dx14, last.adx) == (None, None, None, None)
    assert (last.di14_p, last.di14_line_cross, last.psar_type) == (None, 1, "UP")


def test_sar_seed_follows_the_last_close(spark):
    rows = [candle("A", 0, 20, 10, 15), candle("A", 300, 18, 8, 12), candle("B", 0, 20, 10, 15), candle("B", 300, 25, 11, 20)]
    got = {r.symbol: r for r in ordered(ind.seed_signals(bars_of(spark, rows))) if r.slot == 1}
    assert (got["A"].psar_type, got["A"].ep, got["A"].psar) == ("DOWN", 8.0, 20 + 0.02 * (8 - 20))
    assert (got["B"].psar_type, got["B"].ep, got["B"].psar) == ("UP", 25.0, 10 + 0.02 * (25 - 10))


def test_seed_of_every_bar_is_its_own_look_back(spark, sf_dir):
    # small blocks, gaps everywhere
    bars = ind.with_slot(resample(market.base_candles(spark, sf_dir), ["1h", "2h", "4h"]))
    every = seed_at(bars, bars.select("bar_interval", "symbol", "slot"))
    assert_same(seed_all(bars), every, KEY)
    assert_same(seed_all(bars, block=64), every, KEY)
    assert_same(seed_latest(bars), every.join(
        bars.groupBy("bar_interval", "symbol").agg(F.max("slot").alias("slot")), ["bar_interval", "symbol", "slot"]), KEY)


def test_windows_over_blocks_equal_windows_over_series(spark):
    rows = walk("A", range(300), 3) + walk("B", [s for s in range(400) if s % 7 and s % 11], 4)
    bars = bars_of(spark, rows)
    for columns in (ind.with_previous, ind.with_extremes):
        assert_same(over_blocks(bars, columns, block=32), columns(bars), KEY)


def test_rsi_is_between_0_and_100(spark, sf_dir):
    bars = ind.with_slot(resample(market.base_candles(spark, sf_dir, market.symbol_by_user()), ["1d"]))
    assert seed_all(bars).filter("rsi7 < 0 or rsi7 > 100 or rsi14 < 0 or rsi14 > 100").isEmpty()


def test_all_seed_windows_share_one_exchange_and_one_sort(spark):
    bars = bars_of(spark, walk("A", range(50)))
    plan = ind.seed_signals(bars)._jdf.queryExecution().executedPlan().toString()
    # one exchange for the bars, one for all windows
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("Sort [") == 1


def test_seeds_behind_gaps_shuffle_the_bars_once(spark, sf_dir):
    seeds = seed_all(ind.with_slot(resample(market.base_candles(spark, sf_dir), ["1h", "4h"])))
    plan = seeds._jdf.queryExecution().executedPlan().toString()
    # candles, their bars by common bucket, and the blocks; no join with the look-back
    assert plan.count("Exchange ") == 3 and "Join" not in plan


def test_seeds_behind_gaps_in_small_blocks(spark):
    rows = walk("A", [s for s in range(200) if s % 7 not in (2, 3) and not 60 < s < 100], 5)
    bars = ind.with_slot(resample(candles(spark, rows), ["5m"]))
    assert_same(seed_all(bars, 32), seed_at(bars, bars.select(*ind.SERIES, "slot")), ("symbol", "slot"))
