from pyspark.sql import functions as F

from barwright.operators.bars import candles_from_ticks, common_bucket, resample, resample_by_join, roll_up_tasks
from barwright.sources import market
from helpers import assert_same, candle, candles, one_row, walk


def test_bar_from_base_candles(spark):
    rows = [
        candle("A", 600, 12, 8, 10, open_=9), candle("A", 300, 11, 7, 8, open_=5), candle("A", 900, 30, 6, 20, open_=10),
        candle("A", 1200, 99, 1, 50),
    ]
    bar = one_row(resample(candles(spark, rows), ["15m"], end=1200).filter("bar_start = 0").drop("bar_seconds"))
    # the first candle of the bar came late: open_time is its time, bar_start is the grid
    assert (bar.bar_start, bar.close_time, bar.open_time) == (0, 900, 300)
    assert (bar.open, bar.high, bar.low, bar.close, bar.num_trades, bar.volume) == (5.0, 12.0, 7.0, 10.0, 2, 2.0)


def test_range_is_half_open_and_symbols_are_optional(spark):
    base = candles(spark, [candle(s, t, 1, 1, 1) for s in "AB" for t in (0, 300, 600)])
    assert {(r.symbol, r.bar_start) for r in resample(base, ["5m"], 300, 600).collect()} == {("A", 300), ("B", 300)}
    assert {r.symbol for r in resample(base, ["5m"], symbols=["A"]).collect()} == {"A"}
    wanted = spark.createDataFrame([("B",)], "symbol string")
    assert {r.symbol for r in resample(base, ["5m"], symbols=wanted).collect()} == {"B"}


def test_null_opening_value_is_kept(spark):
    rows = [("A", 0, None, 2.0, 1.0, 1.5, 1.0, 1.0, 1, 1.0, 1.0), ("A", 300, 3.0, 4.0, 3.0, 3.5, 1.0, 1.0, 1, 1.0, 1.0)]
    assert one_row(resample(candles(spark, rows), ["10m"])).open is None


def test_all_intervals_in_one_pass_equal_separate_passes(spark, sf_dir):
    base = market.base_candles(spark, sf_dir)
    together = resample(base, ["1h", "2h", "6h"])
    for label in ("1h", "2h", "6h"):
        assert_same(together.filter(f"bar_interval = '{label}'"), resample(base, [label]), ("symbol", "bar_start"))
    assert_same(together, resample_by_join(base, ["1h", "2h", "6h"]), ("bar_interval", "symbol", "bar_start"))


def test_coarse_bars_from_fine_bars_keep_sums(spark, sf_dir):
    base = market.base_candles(spark, sf_dir)
    sums = resample(base, ["1h", "1d"]).groupBy("bar_interval").sum("volume", "quote_asset", "num_trades", "buy_quote")
    first, second = [tuple(r)[1:] for r in sums.collect()]
    assert first == second


def test_prices_stay_inside_their_bar(spark, sf_dir):
    bars = resample(market.base_candles(spark, sf_dir, market.symbol_by_user()), ["4h"])
    assert bars.filter("low > least(open, close) or high < greatest(open, close)").isEmpty()


def test_partial_aggregation_reaches_both_sides_of_the_shuffle(spark, sf_dir):
    plan = candles_from_ticks(market.ticks(market.table(spark, sf_dir, "events")))._jdf.queryExecution().toString()
    assert "partial_min_by" in plan and "SortAggregate" not in plan


def test_several_lengths_shuffle_each_base_row_once(spark):
    base = candles(spark, [candle(s, 300 * t, 1, 1, t) for s in "AB" for t in range(100)])
    plan = resample(base, ["5m", "15m", "1h", "4h"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate") < plan.index("Exchange ")  # fanned out behind it


def test_several_lengths_hold_no_more_bars_in_a_task(spark):
    """P shuffle partitions for one length are P for each of several: adaptive execution does not join them again."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = candles(spark, [candle(f"S{s}", 300 * t, 1, 1, t) for s in range(40) for t in range(480)])
    bars = resample(base, ["5m", "10m", "15m", "30m"])
    held = [r["count"] for r in bars.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 40 * (480 + 240 + 160 + 80)
    assert len(held) > 2 * parts and max(held) <= 2 * sum(held) / (4 * parts)


def test_roll_up_tasks_follow_the_size_of_the_base_rows(spark, tmp_path, monkeypatch):
    parts, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    tasks = []
    for at, n in enumerate((4000, 16000)):
        candles(spark, walk("A", range(n), at)).coalesce(1).write.parquet(f"{tmp_path}/{at}")
        stored = spark.read.parquet(f"{tmp_path}/{at}")
        assert roll_up_tasks(stored, 4) == min(cores, 4 * parts)  # little to hold: no crowd of tiny tasks
        with monkeypatch.context() as m:
            m.setattr("barwright.operators.bars.ROLL_UP_BYTES", 10_000)
            m.setattr(type(spark.conf), "get", lambda *_: "100000")
            tasks.append(roll_up_tasks(stored, 4))
            assert abs(roll_up_tasks(stored, 8) - 2 * tasks[-1]) <= 1
    assert cores < 2 * tasks[0] < tasks[1] < 8 * tasks[0]
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path))
    assert roll_up_tasks(stream, 4) == 4 * parts


def test_common_bucket():
    assert common_bucket([3600, 7200, 10800]) == 21600
    assert common_bucket([3600]) is None
    assert common_bucket([86399, 86400]) is None


def test_lengths_without_a_common_bucket(spark):
    base = candles(spark, walk("A", range(300), 3))
    together = resample(base, {"x": 86399, "y": 86400})
    assert_same(together.filter("bar_interval = 'x'"), resample(base, {"x": 86399}), ("symbol", "bar_start"))
    assert_same(together.filter("bar_interval = 'y'"), resample(base, {"y": 86400}), ("symbol", "bar_start"))
