"""Resampling of base candles (or ticks) to OHLCV bars.

One ``groupBy`` yields the whole bar: first open, last close, extremes and sums are all decomposable, so Spark
combines them on the map side and a symbol holding most of the rows sends only its partial bars to the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timegrid import bar_close, int_div
from ..schemas import BAR_COLUMNS, BAR_SECONDS, CANDLES
from ..session import estimated_bytes

SUMMED = ("volume", "quote_asset", "num_trades", "buy_base", "buy_quote")

# A common bucket of several bar lengths is this many of the longest bars at most.
MOST_LONGEST = 32

# Estimated bytes of fanned-out base rows for one task. Files count as they lie on disk; the two hash maps of a roll-up
# take some ten to twenty times that.
ROLL_UP_BYTES = 4 << 20


def interval_seconds(intervals: Iterable[str] | Mapping[str, int]) -> dict[str, int]:
    """Bar lengths for labels; a mapping states its own lengths."""
    if isinstance(intervals, Mapping):
        return dict(intervals)
    return {label: BAR_SECONDS[label] for label in intervals}


def in_range(df: DataFrame, start: int | None = None, end: int | None = None, closed: bool = False) -> DataFrame:
    """Rows with ``start <= open_time < end`` (``<= end`` if closed); pushed down to the scan."""
    if start is not None:
        df = df.filter(F.col("open_time") >= start)
    if end is not None:
        df = df.filter(F.col("open_time") <= end if closed else F.col("open_time") < end)
    return df


def only_symbols(df: DataFrame, symbols: DataFrame | Iterable[str] | None) -> DataFrame:
    """Optional symbol condition: a short list becomes ``IN``, a DataFrame a left semi join."""
    if symbols is None:
        return df
    if isinstance(symbols, DataFrame):
        return df.join(symbols.select("symbol"), "symbol", "left_semi")
    return df.filter(F.col("symbol").isin(list(symbols)))


def candles_from_ticks(ticks: DataFrame, length: int = 300) -> DataFrame:
    """Base candles from single trades with columns symbol, ts, sec, px, k and buyer (boolean).

    The candle is keyed by its grid time, so the result is a grid-aligned base series.
    """
    notional = F.col("k") * F.col("px")
    bought = F.col("buyer")
    candles = ticks.groupBy("symbol", (int_div(F.col("sec"), F.lit(length)) * length).alias("open_time")).agg(
        F.min_by("px", "ts").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "ts").alias("close"),
        F.sum("k").alias("volume"),
        F.sum(notional).alias("quote_asset"),
        F.count(F.lit(1)).alias("num_trades"),
        F.coalesce(F.sum(F.when(bought, F.col("k"))), F.lit(0)).alias("buy_base"),
        F.coalesce(F.sum(F.when(bought, notional)), F.lit(0)).alias("buy_quote"),
    )
    return candles.select(*[F.col(f.name).cast(f.dataType) for f in CANDLES])


def bar_aggregates() -> list[Column]:
    """Aggregates of one bar over its base candles."""
    return [
        F.min("open_time").alias("first_time"),
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        *[F.sum(name).alias(name) for name in SUMMED],
    ]


def with_interval(base: DataFrame, intervals: Iterable[str] | Mapping[str, int]) -> DataFrame:
    """One copy of each base row per bar length, with ``bar_interval`` and ``bar_seconds``."""
    lengths = interval_seconds(intervals)
    if len(lengths) == 1:
        ((label, seconds),) = lengths.items()
        return base.withColumns({"bar_interval": F.lit(label), "bar_seconds": F.lit(seconds).cast("long")})
    choices = F.array(
        *[
            F.struct(F.lit(label).alias("bar_interval"), F.lit(seconds).cast("long").alias("bar_seconds"))
            for label, seconds in lengths.items()
        ]
    )
    return base.select("*", F.inline(choices))


def common_bucket(lengths: Iterable[int]) -> int | None:
    """Shortest time that whole bars of every length fill, or None for one length or where it would be very long."""
    lengths = list(lengths)
    shared = math.lcm(*lengths)
    return shared if len(lengths) > 1 and shared <= MOST_LONGEST * max(lengths) else None


def roll_up_tasks(base: DataFrame, lengths: int) -> int:
    """Tasks for bars of so many lengths: a base row may become a bar of each, and a task holds all its bars.

    The number grows with the estimated size of the base rows, up to the session's shuffle partitions for every length.
    """
    spark = base.sparkSession
    most = lengths * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(base)
    if size is None:
        return most
    return min(most, max(spark.sparkContext.defaultParallelism, math.ceil(lengths * size / ROLL_UP_BYTES)))


def resample(
    base: DataFrame,
    intervals: Iterable[str] | Mapping[str, int],
    start: int | None = None,
    end: int | None = None,
    symbols: DataFrame | Iterable[str] | None = None,
) -> DataFrame:
    """Bars of every requested length in one pass over the base candles.

    ``open_time`` is the time of the bar's first base candle, ``bar_start`` and ``close_time`` are its grid edges.
    For several lengths the base candles are shuffled once, by symbol and the common bucket of all lengths, and every
    length is rolled up where they lie: each row travels once however many lengths there are, and a symbol that holds
    most of the rows is spread over its buckets. A task holds the bars of its rows, so ``roll_up_tasks`` states the number
    of tasks; left to adaptive execution it would follow the bytes of the base rows alone. One length, and lengths without
    a reasonable common bucket, combine their bars before the shuffle instead.
    """
    key = ["bar_interval", "bar_seconds", "symbol", "close_time"]
    rows = only_symbols(in_range(base, start, end), symbols)
    lengths = interval_seconds(intervals)
    shared = common_bucket(lengths.values())
    if shared:
        key.append("bucket")
        tasks = roll_up_tasks(base, len(lengths))
        rows = rows.withColumn("bucket", int_div(F.col("open_time"), F.lit(shared))).repartition(tasks, "symbol", "bucket")
    rows = with_interval(rows, intervals).withColumn("close_time", bar_close(F.col("open_time"), F.col("bar_seconds")))
    bars = rows.groupBy(*key).agg(*bar_aggregates())
    return bars.select(
        "bar_interval",
        "symbol",
        (F.col("close_time") - F.col("bar_seconds")).alias("bar_start"),
        "close_time",
        F.col("first_time").alias("open_time"),
        *BAR_COLUMNS[5:],
        "bar_seconds",
    )


def resample_by_join(base: DataFrame, intervals: Iterable[str] | Mapping[str, int]) -> DataFrame:
    """The same bars as a join of each bar's opening row with its other aggregates (cross-check of ``resample``).

    Both sides aggregate on the join key, so the join adds no shuffle of its own.
    """
    rows = with_interval(base, intervals).withColumn(
        "close_time", bar_close(F.col("open_time"), F.col("bar_seconds"))
    )
    key = ["bar_interval", "bar_seconds", "symbol", "close_time"]
    opening = rows.groupBy(*key).agg(F.min("open_time").alias("open_time"), F.min_by("open", "open_time").alias("open"))
    rest = rows.groupBy(*key).agg(*bar_aggregates()[2:])
    joined = opening.join(rest, key)
    return joined.withColumn("bar_start", F.col("close_time") - F.col("bar_seconds")).select(
        *BAR_COLUMNS, "bar_seconds"
    )
