import pytest
from pyspark.sql import functions as F

from barwright.operators.bars import resample
from barwright.operators.fold import compute_signals
from barwright.schemas import CANDLES, SIGNALS
from barwright.session import scratch_path
from barwright.streaming.bars import stream_bars, stream_bars_fan_out
from barwright.streaming import signals as machine
from barwright.streaming.jobs import BARS, rocks, run_continued_signals
from barwright.streaming.signals import stream_signals
from helpers import SIGNAL_KEY, assert_same, candle, candles, walk

ROWS = walk("A", range(200), 1) + walk("B", [s for s in range(200) if s % 13 and not 60 < s < 95], 2) + walk("C", range(200), 3, flat=0.7)


def run(stream, out, progress):
    with rocks(stream.sparkSession):
        query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()


def land(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def read_stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_bars_close_with_the_watermark_and_late_rows_are_dropped(spark):
    source, out, progress = (scratch_path(spark, "stream-test") for _ in range(3))
    base = candles(spark, ROWS)
    stream = lambda: stream_bars(read_stream(spark, CANDLES, source), "15m", "5 minutes")
    for start, end in ((0, 70), (70, 140), (140, 200)):
        land(base.filter((F.col("open_time") >= start * 300) & (F.col("open_time") < end * 300)), source)
        run(stream(), out, progress)
    land(candles(spark, [candle("A", 300, 9999, 0, 1)]), source)
    run(stream(), out, progress)
    batch = resample(base, ["15m"]).drop("bar_seconds").filter(F.col("close_time") <= 199 * 300 - 300)
    assert_same(spark.read.schema(BARS).parquet(out), batch, SIGNAL_KEY)


@pytest.mark.parametrize("cuts", [(200,), (50, 51, 120, 200), (5, 70, 90, 200)])
def test_state_between_batches_equals_one_batch_job(spark, cuts):
    source, out, progress = (scratch_path(spark, "stream-test") for _ in range(3))
    bars = resample(candles(spark, ROWS), ["5m"])
    start = 0
    for end in cuts:
        part = bars.drop("bar_seconds").filter((F.col("bar_start") >= start * 300) & (F.col("bar_start") < end * 300))
        land(part.select(*BARS.names), source)
        start = end
        if end < 120:
            # stop and start again from the stored progress
            run(stream_signals(read_stream(spark, BARS, source)), out, progress)
    # a second delivery of old bars changes nothing
    land(bars.drop("bar_seconds").filter("bar_start < 3000").select(*BARS.names), source)
    run(stream_signals(read_stream(spark, BARS, source)), out, progress)
    stored = spark.read.schema(SIGNALS).parquet(out)
    assert_same(stored, compute_signals(bars), SIGNAL_KEY, tolerance=1e-10)


def test_a_stream_goes_on_from_stored_rows(spark):
    bars = resample(candles(spark, ROWS), ["5m"]).drop("bar_seconds").select(*BARS.names)
    whole = compute_signals(resample(candles(spark, ROWS), ["5m"]))
    source = scratch_path(spark, "stream-test")
    # some bars that are stored come again, and a symbol starts in the stream only
    stored = whole.filter("bar_start < 120 * 300 and symbol <> 'C'")
    land(bars.filter("bar_start >= 110 * 300 or symbol = 'C'"), source)
    got = run_continued_signals(spark, stored, read_stream(spark, BARS, source))
    assert_same(got, whole.filter("bar_start >= 120 * 300 or symbol = 'C'"), SIGNAL_KEY, tolerance=1e-10)


def test_rows_beyond_what_a_task_holds_are_put_down_in_ranges(spark):
    """Rows come in no order; what a task may hold is made small in the workers through the pickled module."""
    bars = resample(candles(spark, ROWS), ["5m"])
    source, out, progress = (scratch_path(spark, "stream-test") for _ in range(3))
    before = machine.HELD_ROWS, machine.RANGE_SLOTS
    machine.HELD_ROWS, machine.RANGE_SLOTS = 20, 16
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        bars.drop("bar_seconds").select(*BARS.names).orderBy(F.xxhash64("bar_start")).coalesce(1).write.parquet(source)
        run(stream_signals(read_stream(spark, BARS, source)), out, progress)
    finally:
        machine.HELD_ROWS, machine.RANGE_SLOTS = before
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert_same(spark.read.schema(SIGNALS).parquet(out), compute_signals(bars), SIGNAL_KEY, tolerance=1e-10)


def test_bars_of_all_lengths_come_from_one_read(spark):
    source, out, progress = (scratch_path(spark, "stream-test") for _ in range(3))
    base = candles(spark, ROWS)
    stream = lambda: stream_bars_fan_out(read_stream(spark, CANDLES, source), ("10m", "15m", "1h"), "5 minutes")
    for start, end in ((0, 70), (70, 71), (71, 140), (140, 200)):
        land(base.filter((F.col("open_time") >= start * 300) & (F.col("open_time") < end * 300)), source)
        run(stream(), out, progress)
    assert stream()._jdf.queryExecution().analyzed().toString().count("StreamingRelation") == 1
    # a row behind the watermark is dropped by all lengths alike
    land(candles(spark, [candle("A", 300, 9999, 0, 1)]), source)
    run(stream(), out, progress)
    closed = F.col("close_time") <= 199 * 300 - 300
    batch = resample(base, ["10m", "15m", "1h"]).drop("bar_seconds").filter(closed)
    assert_same(spark.read.schema(BARS).parquet(out), batch, SIGNAL_KEY)
