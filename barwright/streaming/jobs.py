"""Streaming jobs from a folder of event files to stored bars and signals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import BAR_COLUMNS, CANDLES
from ..session import scratch_path
from ..sources.market import ticks
from .bars import stream_bars_fan_out, tick_candles
from .signals import ROCKS, STORE, stream_signals

BARS = T.StructType(
    [
        T.StructField("bar_interval", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("bar_start", T.LongType()),
        T.StructField("close_time", T.LongType()),
        T.StructField("open_time", T.LongType()),
        *[CANDLES[name] for name in BAR_COLUMNS[5:]],
    ]
)


def run_to_files(stream: DataFrame, spark: SparkSession, label: str) -> str:
    """Run a stream over all files present and return the folder of its file sink."""
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", f"{out}-progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def open_events(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Event files of a folder as a stream of trades."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").options(**options)
    return ticks(files.parquet(folder))


def store_stream_bars(spark: SparkSession, folder: str, labels: Sequence[str], delay: str) -> str:
    trades = tick_candles(open_events(spark, folder))
    return run_to_files(stream_bars_fan_out(trades, labels, delay, "at"), spark, "stream-bars")


def run_stream_bars(spark: SparkSession, folder: str, labels: Sequence[str], delay: str) -> DataFrame:
    return spark.read.schema(BARS).parquet(store_stream_bars(spark, folder, labels, delay))


def run_stream_signals(spark: SparkSession, folder: str, labels: Sequence[str], delay: str) -> DataFrame:
    """Bars stored by one stream feed the stateful stream of a second."""
    bars = spark.readStream.schema(BARS).parquet(store_stream_bars(spark, folder, labels, delay))
    with rocks(spark):
        signals = stream_signals(bars)
        return spark.read.schema(signals.schema).parquet(run_to_files(signals, spark, "stream-signals"))


def run_continued_signals(spark: SparkSession, stored: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals of a stream of ``bars`` that goes on from ``stored`` rows, the batch job's."""
    with rocks(spark):
        signals = stream_signals(bars, stored)
        return spark.read.schema(signals.schema).parquet(run_to_files(signals, spark, "stream-signals"))
