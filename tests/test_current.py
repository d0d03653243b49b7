"""State tables: catch-up reads what is new, whatever lies in the past."""

from pathlib import Path

from pyspark.sql import functions as F

from barwright.operators import serving
from barwright.plans.pipeline import catch_up_signals, ingest_candles, ingest_then_signals, rebuild_signals
from barwright.schemas import VALUE_COLUMNS
from barwright.session import scratch_path
from barwright.sources.current import VersionedTable
from barwright.sources.tables import candle_table, signal_table
from helpers import SIGNAL_KEY, assert_same, candles, walk, without_update_time

DAY = 288
INTERVALS = ("5m", "30m")


def tables(spark):
    return (
        candle_table(spark, scratch_path(spark, "test-candles")).provision(),
        signal_table(spark, scratch_path(spark, "test-signals")).provision(),
    )


def landed(spark, rows):
    text = [F.col(name).cast("string").alias(name) for name in VALUE_COLUMNS]
    return candles(spark, rows).select("symbol", ((F.col("open_time") + 60) * 1000).cast("string").alias("time"), *text)


def spoil(table, before: str) -> int:
    """Make every stored file of the days before a day unreadable."""
    files = [f for f in Path(table.path.removeprefix("file:")).rglob("*.parquet") if f.parent.name.removeprefix("day=") < before]
    for f in files:
        f.write_bytes(b"not a table")
    return len(files)


def test_a_run_reads_neither_old_signals_nor_old_candles(spark):
    rows = walk("A", range(12 * DAY), 1) + walk("B", range(12 * DAY), 2) + walk("GONE", range(2 * DAY), 3)
    prices, signals = tables(spark)
    cut = 11 * DAY * 300
    prices.insert_ignore(candles(spark, [r for r in rows if r[1] < cut]))
    catch_up_signals(prices, signals, cut, INTERVALS)
    whole = without_update_time(rebuild_signals(candles(spark, rows), INTERVALS, cut + 7200))
    expected = whole.filter(f"bar_start >= {cut}").cache()
    expected.count()
    # 28 slots of half an hour reach into the tenth day; a symbol that has ended long ago holds nothing back
    assert spoil(prices, "1970-01-11") and spoil(signals, "1970-01-11")
    ingest_then_signals(landed(spark, [r for r in rows if r[1] >= cut]), prices, signals, cut + 7200, INTERVALS)
    assert_same(without_update_time(signals.since(cut)), expected, SIGNAL_KEY, tolerance=1e-10)


def test_a_symbol_that_lags_loses_nothing_and_is_caught_up(spark):
    rows = walk("A", range(2 * DAY), 1) + walk("SLOW", range(2 * DAY), 2)
    prices, signals = tables(spark)
    half = DAY * 300
    early = [r for r in rows if r[1] < half or r[0] == "A"]
    for part in (early, rows):
        ingest_then_signals(landed(spark, part), prices, signals, 2 * half, INTERVALS)
    assert prices.rows().count() == len(rows)
    assert {(r.symbol, r.first_time, r.last_time) for r in prices.marks().collect()} == {
        (s, 0, (2 * DAY - 1) * 300) for s in ("A", "SLOW")}
    assert_same(without_update_time(signals.rows()), without_update_time(rebuild_signals(candles(spark, rows), INTERVALS, 2 * half)),
                SIGNAL_KEY, tolerance=1e-10)


def test_a_run_that_died_before_its_state_was_written_is_gone_on_with(spark, monkeypatch):
    rows = walk("A", range(600), 4)
    prices, signals = tables(spark)
    ingest_candles(landed(spark, rows), prices)
    catch_up_signals(prices, signals, 60_000, INTERVALS)
    old = signals.newest().collect()
    with monkeypatch.context() as patch:
        patch.setattr(type(signals), "replace_newest", lambda self, days: None)
        catch_up_signals(prices, signals, 120_000, INTERVALS)
    assert signals.newest().collect() == old
    catch_up_signals(prices, signals, 180_000, INTERVALS)
    assert_same(without_update_time(signals.rows()), without_update_time(rebuild_signals(candles(spark, rows), INTERVALS, 180_000)),
                SIGNAL_KEY, tolerance=1e-10)
    assert {r.bar_start for r in signals.newest().collect()} == {180_000 - 300, 178_200}


def test_tables_without_state_are_read_once_for_it(spark):
    rows = walk("A", range(500), 5) + walk("B", range(450), 6)
    prices, signals = tables(spark)
    catch_up_signals(candles(spark, rows), signals, 90_000, INTERVALS)
    again, stored = candle_table(spark, prices.path), signal_table(spark, scratch_path(spark, "filled")).provision()
    candles(spark, rows).withColumn("day", F.lit("1970-01-01").cast("date")).write.mode("append").partitionBy("day").parquet(prices.path)
    signals.rows().withColumn("day", F.lit("1970-01-01").cast("date")).write.mode("append").partitionBy("bar_interval", "day").parquet(stored.path)
    catch_up_signals(again, stored, 150_000, INTERVALS)
    assert_same(without_update_time(stored.rows()), without_update_time(rebuild_signals(candles(spark, rows), INTERVALS, 150_000)),
                SIGNAL_KEY, tolerance=1e-10)


def test_versions(spark):
    schema = spark.range(1).schema
    table = VersionedTable(spark, scratch_path(spark, "versions"), schema)
    assert not table.exists() and table.read().count() == 0
    for n in (1, 2, 3):
        table.replace(spark.range(n).union(table.read()))
    assert table.read().count() == 6 and len(table._versions()) == 2
    # a version that was not finished does not count
    half = Path(table._folder(9).removeprefix("file:"))
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"half")
    assert table.read().count() == 6


def test_an_insert_reads_the_days_of_its_batch_only(spark):
    prices, _ = tables(spark)
    rows = walk("A", range(5 * DAY), 1)
    prices.insert_ignore(candles(spark, rows))
    files = [f for f in Path(prices.path.removeprefix("file:")).rglob("*.parquet") if f.parent.name == "day=1970-01-03"]
    for f in files:
        f.write_bytes(b"not a table")
    days = prices.insert_ignore(candles(spark, [rows[0], rows[-1]]))
    assert [str(d) for d in days] == ["1970-01-01", "1970-01-05"]


def test_rsi_change_reads_backwards_only_as_far_as_a_symbol_needs(spark):
    late = [r for r in walk("LATEUSDT", range(30 * DAY), 2) if not 26 * DAY * 300 <= r[1] < (30 * DAY - 48) * 300]
    prices, signals = tables(spark)
    catch_up_signals(candles(spark, walk("AUSDT", range(30 * DAY), 1) + walk("GONEUSDT", range(DAY), 3) + late), signals, 30 * DAY * 300, ("4h",))
    for request, column in (("FOUR_HOUR", "rsi14"), ("FOUR_HOUR", "rsi7")):
        expected = serving.rsi_change(signals.rows(), column, request).collect()
        assert [r.symbol for r in expected] == ["AUSDT", "LATEUSDT"]
        assert serving.stored_rsi_change(signals, column, request).collect() == expected
    signals.newest()
    # the newest day, then 1, 2 and 4 days back: the earlier bar of LATEUSDT lies in the 26th day
    assert spoil(signals, "1970-01-23")
    assert serving.stored_rsi_change(signals).collect() == serving.rsi_change(signals.since(22 * DAY * 300)).collect()


def test_rsi_change_of_a_symbol_with_one_bar_and_of_an_empty_table(spark):
    prices, signals = tables(spark)
    assert serving.stored_rsi_change(signals).collect() == []
    prices, signals = tables(spark)
    once = walk("ONCEUSDT", range(6 * DAY - 48, 6 * DAY), 2)
    catch_up_signals(candles(spark, walk("AUSDT", range(6 * DAY), 1) + once), signals, 6 * DAY * 300, ("4h",))
    got = serving.stored_rsi_change(signals).collect()
    assert [r.symbol for r in got] == ["AUSDT"] and got == serving.rsi_change(signals.rows()).collect()
