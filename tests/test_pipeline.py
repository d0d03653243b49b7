import os

import pytest
from pyspark.sql import functions as F

from barwright.operators.bars import resample
from barwright.operators.fold import compute_signals
from barwright.operators.forecast import fit_symbols
from barwright.operators.watermarks import low_watermarks
from barwright.plans.pipeline import (
    catch_up_signals, continue_signals, ingest_then_signals, rebuild_signals, store_forecasts, sync_predictions,
)
from barwright.schemas import LANDED_CANDLES, PREDICTIONS, SIGNALS
from barwright.session import scratch_path, shared_dir
from barwright.sources import candles as src
from barwright.sources.tables import candle_table, first_per_key, insert_ignore, prediction_table, signal_table
from helpers import SIGNAL_KEY, assert_same, candle, candles, one_row, walk, without_update_time

ROWS = walk("A", range(400), 1) + walk("B", [s for s in range(400) if s % 17], 2) + walk("NEW", range(330, 400), 3)
INTERVALS = ("5m", "10m", "30m")


@pytest.fixture(scope="module")
def base(spark):
    return candles(spark, ROWS).cache()


def signals_path(spark):
    return signal_table(spark, scratch_path(spark, "test-signals")).provision()


def test_catch_up_in_stages_equals_one_shot(spark, base):
    table = signals_path(spark)
    for end in (60_000, 60_000, 75_100, 120_000):
        catch_up_signals(base, table, end, INTERVALS)
    stored = table.rows()
    assert stored.count() == stored.select(*SIGNAL_KEY).distinct().count()
    whole = rebuild_signals(base, INTERVALS, 120_000)
    assert_same(without_update_time(stored), without_update_time(whole), SIGNAL_KEY, tolerance=1e-10)


def test_a_symbol_that_arrives_late_with_all_its_history_is_complete(spark, base):
    table = signals_path(spark)
    catch_up_signals(base.filter("symbol <> 'A'"), table, 75_000, INTERVALS)
    catch_up_signals(base, table, 120_000, INTERVALS)
    assert_same(without_update_time(table.rows()), without_update_time(rebuild_signals(base, INTERVALS, 120_000)), SIGNAL_KEY, tolerance=1e-10)


def test_the_first_new_bar_steps_from_the_prices_that_were_stored(spark):
    rows = walk("A", range(201), 5)
    # the last two candles of the stored half-hour bar come later and change its high and close
    late = [candle("A", 192 * 300 - 300, 99_000, 990, 98_000)]
    before = [r for r in rows if not 190 * 300 <= r[1] < 192 * 300]
    after = [r for r in rows if r[1] != 192 * 300 - 300] + late
    table = signals_path(spark)
    catch_up_signals(candles(spark, before), table, 192 * 300, ["30m"])
    stored = table.rows().orderBy(F.desc("bar_start")).first()
    catch_up_signals(candles(spark, after), table, 198 * 300, ["30m"])
    new = table.rows().orderBy(F.desc("bar_start")).first()
    assert new.bar_start == stored.bar_start + 1800
    assert (new.ph, new.pl, new.pc) == (stored.high, stored.low, stored.close)
    assert new.atr14 == pytest.approx((stored.atr14 * 13 + new.tr) / 14)
    # extremes look at the bars as they are now
    assert new.ep14_h == 99_000
    assert table.rows().filter(F.col("bar_start") == stored.bar_start).first() == stored


def test_the_hourly_chain_twice_adds_nothing(spark, tmp_path):
    line = '{{"symbol": "btcusdt", "time": "{}", "open": "{}", "high": "{}", "low": "1", "close": "{}"}}\n'
    text = "".join(line.format((slot * 300 + 60) * 1000, slot, slot + 5, slot + slot % 7) for slot in range(100))
    (tmp_path / "in.json").write_text(text + '{"symbol": "btcusdt", "time": "16')
    landed = src.read_landed(spark, str(tmp_path))
    prices = candle_table(spark, scratch_path(spark, "test-candles")).provision()
    signals = signals_path(spark)
    for _ in range(2):
        ingest_then_signals(landed, prices, signals, 30_000, ["5m"])
    assert prices.rows().count() == 100 and signals.rows().count() == 100
    (lost,) = src.rejected(landed).collect()
    assert lost.reason == "malformed record" and lost.malformed.endswith('"16') and lost.file.endswith("in.json")


def test_unreadable_files_are_listed(spark, tmp_path):
    df = spark.createDataFrame([("A", "1700000060000") + ("1",) * 9], LANDED_CANDLES)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "in" / "part-bad.parquet").write_bytes(b"PAR1 not a parquet file PAR1")
    landed = src.read_landed(spark, str(tmp_path / "in"), "parquet")
    lost = src.unread_files(spark, str(tmp_path / "in"), landed).collect()
    assert [r.file.rsplit("/", 1)[1] for r in lost if not r.file.rsplit("/", 1)[1].startswith("_")] == ["part-bad.parquet"]


def test_an_insert_computes_its_batch_once_and_leaves_no_scratch(spark, base):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        runs.add(1)
        yield from batches

    table = prediction_table(spark, scratch_path(spark, "test-once")).provision()
    rows = base.limit(5).selectExpr("symbol", "open_time", *[f"close as {name}" for name in PREDICTIONS.names[2:]])
    before = set(os.listdir(f"{shared_dir(spark)}/barwright"))
    table.insert_ignore(rows.coalesce(1).mapInArrow(counted, rows.schema))
    assert runs.value == 1 and table.rows().count() == 5
    assert set(os.listdir(f"{shared_dir(spark)}/barwright")) == before


def test_catch_up_twice_adds_nothing(spark, base):
    table = signals_path(spark)
    catch_up_signals(base, table, 30_000, ["5m"])
    before = table.rows().count()
    catch_up_signals(base, table, 30_000, ["5m"])
    assert table.rows().count() == before == 100 + 94


def test_catch_up_of_some_symbols_leaves_the_others(spark, base):
    table = signals_path(spark)
    catch_up_signals(base, table, 30_000, ["5m"], symbols=["B"])
    assert {r.symbol for r in table.rows().select("symbol").distinct().collect()} == {"B"}


def test_open_bars_are_not_stored(spark, base):
    table = signals_path(spark)
    catch_up_signals(base, table, 30_300, ["30m"])
    assert table.rows().agg(F.max("bar_start")).first()[0] == 28_800 - 1800


@pytest.mark.parametrize("block,warmup", [(16384, 1152), (64, 28)])
def test_restart_equals_one_shot(spark, base, block, warmup):
    bars = resample(base, INTERVALS)
    stored = compute_signals(bars.filter("close_time <= 60000"))
    new = continue_signals(bars.filter("close_time > 60000"), stored, block=block, warmup=warmup)
    whole = compute_signals(bars).filter("bar_start + case bar_interval when '5m' then 300 when '10m' then 600 else 1800 end > 60000")
    assert_same(new, whole, SIGNAL_KEY, tolerance=1e-10)


def test_without_reseeding_a_broken_chain_stops(spark, base):
    bars = resample(base, ["5m"])
    stored = compute_signals(bars.filter("close_time <= 60000"))
    new = continue_signals(bars.filter("close_time > 60000"), stored, reseed=False)
    counts = {r.symbol: r["count"] for r in new.groupBy("symbol").count().collect()}
    # A has no gap; B misses slot 204; NEW was never stored
    assert counts == {"A": 200, "B": 4}


def test_restart_reads_28_slots_of_context_only(spark, base):
    bars = resample(base, ["5m"])
    stored = compute_signals(bars.filter("close_time <= 60000"))
    tail = stored.filter("bar_start >= 60000 - 28 * 300")
    new = bars.filter("close_time > 60000")
    assert_same(continue_signals(new, tail), continue_signals(new, stored), SIGNAL_KEY)


def test_low_watermarks(spark):
    rows = [("5m", "A", 3000), ("5m", "A", 2700), ("5m", "B", 2400), ("10m", "A", 1800)]
    signals = spark.createDataFrame(rows, "bar_interval string, symbol string, bar_start long")
    base = candles(spark, [candle("A", 3600, 1, 1, 1), candle("A", 9000, 1, 1, 1)])
    row = one_row(low_watermarks(base, signals, 4000, ["5m", "10m", "15m"]))
    assert row.asDict() == {"end_time": 3900, "time_5m": 3000, "time_10m": 3000, "time_15m": 3900}
    empty = one_row(low_watermarks(base.limit(0), signals.limit(0), 4000, ["5m"]))
    assert empty.asDict() == {"end_time": 3900, "time_5m": 3900}


def test_landed_records(spark, tmp_path):
    good = '{"symbol": "btcusdt", "time": "1700000060000", "open": "1.5", "high": "n/a", "num_trades": "7"}\n'
    (tmp_path / "a.json").write_text(good + '{"symbol": "btcusdt", "time": "soon", "open": "1"}\n')
    (tmp_path / "b.json").write_text('{"symbol": "ethusdt", "time": 1700000120000, "open": 2}\n')
    rows = src.normalize_landed(src.read_landed(spark, str(tmp_path))).orderBy("symbol").collect()
    assert [(r.symbol, r.open_time, r.open, r.high, r.low, r.num_trades) for r in rows] == [
        ("BTCUSDT", 1700000000, 1.5, 0.0, 0.0, 7), ("ETHUSDT", 1700000060, 2.0, 0.0, 0.0, 0)]


def test_a_corrupt_file_does_not_stop_the_others(spark, tmp_path):
    df = spark.createDataFrame([("A", "1700000060000") + ("1",) * 9], LANDED_CANDLES)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "in" / "part-bad.parquet").write_bytes(b"PAR1 not a parquet file PAR1")
    assert src.read_landed(spark, str(tmp_path / "in"), "parquet").count() == 1


def test_ingest_window(spark):
    base = candles(spark, [candle("A", t, 1, 1, 1) for t in (100, 7000, 7300)])
    assert one_row(src.ingest_window(base, 8000)).asDict() == {"start_time": 7301, "end_time": 7700}
    assert one_row(src.ingest_window(base, 80000)).start_time is None


def test_insert_ignore_keeps_the_first_row(spark):
    schema = "symbol string, open_time long, price int, arrival int"
    present = spark.createDataFrame([("A", 1, 10, 0)], schema)
    batch = spark.createDataFrame([("A", 1, 11, 1), ("A", 2, 12, 2), ("A", 2, 13, 1), ("B", 1, 14, 1)], schema)
    new = insert_ignore(present, batch, ["symbol", "open_time"], ["arrival"])
    assert {(r.symbol, r.open_time, r.price) for r in new.collect()} == {("A", 2, 13), ("B", 1, 14)}


def test_copies_of_one_key_collapse_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.lit("A").alias("symbol"), F.lit(1).alias("open_time"), F.col("id").alias("price"))
    one = first_per_key(rows, ["symbol", "open_time"])
    assert one_row(one).price == 0
    assert "partial_min_by" in one._jdf.queryExecution().executedPlan().toString()


def test_signal_table_prunes_partitions(spark, base):
    table = signals_path(spark)
    catch_up_signals(base, table, 60_000, INTERVALS)
    plan = table.since(50_000).filter("bar_interval = '5m'")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "bar_interval" in filters and "day" in filters
    assert "GreaterThanOrEqual(bar_start,50000)" in plan


def test_forecasts_and_sync_between_stores(spark, base):
    table = prediction_table(spark, scratch_path(spark, "test-predictions")).provision()
    for _ in range(2):
        store_forecasts(base, table)
    rows = {r.symbol: r for r in table.rows().collect()}
    assert set(rows) == {"A", "B", "NEW"} and rows["A"].open_time == 399 * 300
    assert rows["A"].lower < rows["A"].next_pred < rows["A"].upper
    local = table.rows().withColumn("open_time", F.timestamp_seconds(F.col("open_time") + 7 * 3600))
    stale = local.filter("symbol = 'A'").withColumns(
        {"open_time": F.col("open_time") - F.expr("interval 2 hours"), "symbol": F.lit("OLD")})
    free = local.filter("symbol = 'A'").withColumns({"last_price": F.lit(0.0), "symbol": F.lit("FREE")})
    copy = prediction_table(spark, scratch_path(spark, "test-copy")).provision()
    for _ in range(2):
        sync_predictions(local.unionByName(stale).unionByName(free), copy)
    assert_same(copy.rows(), table.rows(), ("symbol", "open_time"))
    assert copy.rows().columns == PREDICTIONS.names


def test_short_series_have_a_price_but_no_forecast(spark):
    prices = candles(spark, [candle("A", 0, 1, 1, 5), candle("B", 0, 1, 1, 5), candle("B", 300, 1, 1, 6)])
    rows = {r.symbol: r for r in fit_symbols(prices).collect()}
    assert rows["A"].last_price == 5.0 and rows["A"].next_pred is None
    assert rows["B"].last_price == 6.0 and rows["B"].next_pred is None


def test_signal_schema_is_complete():
    assert len(SIGNALS.names) == 47 + 2


def test_the_ledger_reports_files_that_were_cut_off(spark, tmp_path):
    import gzip

    line = '{{"symbol": "btcusdt", "time": "{}", "open": "1"}}\n'
    text = "".join(line.format((slot * 300 + 60) * 1000 if slot % 10 else "soon") for slot in range(5000)).encode()
    whole, cut = gzip.compress(text), gzip.compress(text)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "whole.json.gz").write_bytes(whole)
    (folder / "cut.json.gz").write_bytes(cut[: len(cut) // 2])
    (folder / "plain.json").write_bytes(text.rstrip(b"\n"))
    (folder / "short.json").write_bytes(text[: len(text) // 3])
    (folder / "dead.json.gz").write_bytes(b"not zipped at all")
    (folder / "none.json").write_bytes(b"")
    landed = src.read_landed(spark, str(folder))
    listed = spark.createDataFrame(
        [(f"{folder}/{name}", 0 if name == "none.json" else 5000) for name in sorted(os.listdir(folder)) if not name.startswith(".")],
        "file string, records long")
    rows = {r.file.rsplit("/", 1)[1]: r for r in src.file_ledger(spark, str(folder), landed, listed).collect()}
    assert {n: r.status for n, r in rows.items()} == {
        "whole.json.gz": "whole", "cut.json.gz": "cut off", "plain.json": "whole", "short.json": "cut off", "dead.json.gz": "unread",
        "none.json": "whole"}
    assert all(r.candles + r.rejected + r.lost == r.expected_records for r in rows.values())
    assert (rows["whole.json.gz"].candles, rows["whole.json.gz"].rejected) == (4500, 500)
    assert rows["short.json"].rejected > 0 and rows["dead.json.gz"].lost == 5000
    # without a list of the sender the sizes alone tell of zipped files
    alone = {r.file.rsplit("/", 1)[1]: r.status for r in src.file_ledger(spark, str(folder), landed).collect()}
    assert alone["cut.json.gz"] == "cut off" and alone["whole.json.gz"] == alone["plain.json"] == "whole"
