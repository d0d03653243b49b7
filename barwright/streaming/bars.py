"""Bars over a stream: tumbling windows per symbol, emitted once when the watermark closes them.

A row that arrives after its bar was emitted is dropped, as an insert that finds its key is in the stored table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timegrid import bar_close
from ..operators.bars import SUMMED
from ..schemas import BAR_COLUMNS, BAR_SECONDS


def tick_candles(trades: DataFrame) -> DataFrame:
    """Single trades as one-row candles; ``at`` keeps their order inside a second."""
    price, size = F.col("px").cast("double"), F.col("k").cast("double")
    bought = F.col("buyer").cast("double")
    return trades.select(
        "symbol", F.col("sec").alias("open_time"), F.col("ts").alias("at"),
        *[price.alias(name) for name in ("open", "high", "low", "close")],
        size.alias("volume"), (size * price).alias("quote_asset"), F.lit(1).cast("long").alias("num_trades"),
        (size * bought).alias("buy_base"), (size * price * bought).alias("buy_quote"),
    )


def stream_bars_fan_out(candles: DataFrame, labels: Sequence[str], delay: str, order: Column | str = "open_time") -> DataFrame:
    """Streaming bars of several lengths from one read of the source.

    The candles are first brought to closed bars of the lengths' greatest common divisor; only these are fanned out, and a second
    event-time aggregation makes the bars of all lengths of them. Its state holds a few small bars for each open bar, whatever the
    traffic. A bar of any length comes out when the watermark passes its end, as in a query of its own.
    """
    seconds = [BAR_SECONDS[label] for label in labels]
    common = math.gcd(*seconds)
    timed = candles.withColumn("event_time", F.timestamp_seconds("open_time")).withWatermark("event_time", delay)
    small = timed.groupBy("symbol", F.window("event_time", f"{common} seconds")).agg(*_bar_columns(order))
    lengths = F.array(*[
        F.struct(F.lit(label).alias("bar_interval"), F.lit(n).cast("long").alias("bar_seconds")) for label, n in zip(labels, seconds)
    ])
    fanned = small.select("*", F.unix_timestamp("window.start").alias("small_start"), F.inline(lengths))
    close_time = bar_close(F.col("small_start"), F.col("bar_seconds"))
    # the end of a bar is event time too: it falls under the watermark of the candles
    ends = F.timestamp_seconds(close_time).alias("bar_end", metadata=timed.schema["event_time"].metadata)
    rows = fanned.select("symbol", "bar_interval", "bar_seconds", ends, *BAR_COLUMNS[4:])
    bars = rows.groupBy("symbol", "bar_interval", "bar_seconds", "bar_end").agg(*_bar_columns("open_time"))
    close = F.unix_timestamp("bar_end")
    return bars.withColumns({"bar_start": close - F.col("bar_seconds"), "close_time": close}).select(*BAR_COLUMNS)


def _bar_columns(order: Column | str) -> list[Column]:
    first, last = F.min_by("open", order), F.max_by("close", order)
    return [
        F.min("open_time").alias("open_time"), first.alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        last.alias("close"), *[F.sum(name).alias(name) for name in SUMMED],
    ]


def stream_bars(candles: DataFrame, label: str, delay: str, order: Column | str = "open_time") -> DataFrame:
    """Streaming bars of one length from a stream of candles.

    ``delay`` is how far a row may lie behind the newest one that was read before it. Rows of files or batches that overlap
    in time are lost if it is shorter than the overlap, and bars come later by it; there is no value that suits all feeds.
    """
    timed = candles.withColumn("event_time", F.timestamp_seconds("open_time")).withWatermark("event_time", delay)
    bars = timed.groupBy("symbol", F.window("event_time", f"{BAR_SECONDS[label]} seconds")).agg(*_bar_columns(order))
    return bars.withColumns(
        {
            "bar_interval": F.lit(label),
            "bar_start": F.unix_timestamp("window.start"),
            "close_time": F.unix_timestamp("window.end"),
        }
    ).select(*BAR_COLUMNS)
