"""Where each interval has to catch up from."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import interval_seconds


def stored_marks(
    base: DataFrame,
    signals: DataFrame,
    end: int,
    intervals: Iterable[str] | Mapping[str, int],
    base_length: int = 300,
) -> DataFrame:
    """One row: the end of the base data, and per interval the bar end the slowest series continues at.

    ``time_<label>`` is the least over symbols of the newest bar start plus two lengths, NULL without any row. Both tables reduce on the map side; the one-row results meet in a union and one conditional aggregate,
    not in a join.
    """
    lengths = interval_seconds(intervals)
    end = end // base_length * base_length
    data_end = base.filter(F.col("open_time") < end).agg((F.max("open_time") + base_length).alias("mark"))
    ahead = reduce(
        lambda col, item: col.when(F.col("bar_interval") == item[0], 2 * item[1]),
        lengths.items(),
        F.when(F.lit(False), 0),
    )
    stored = signals.filter((F.col("bar_start") < end) & F.col("bar_interval").isin(list(lengths)))
    newest = (
        stored.select(F.col("bar_interval").alias("kind"), "symbol", (F.col("bar_start") + ahead).alias("mark"))
        .groupBy("kind", "symbol")
        .agg(F.max("mark").alias("mark"))
        .select("kind", "mark")
        .unionByName(data_end.select(F.lit("base").alias("kind"), "mark"))
    )
    return newest.agg(
        F.coalesce(F.max(F.when(F.col("kind") == "base", F.col("mark"))), F.lit(end).cast("long")).alias("end_time"),
        *[F.min(F.when(F.col("kind") == label, F.col("mark"))).alias(f"time_{label}") for label in lengths],
    )


def low_watermarks(
    base: DataFrame,
    signals: DataFrame,
    end: int,
    intervals: Iterable[str] | Mapping[str, int],
    base_length: int = 300,
) -> DataFrame:
    """``stored_marks`` where an interval without any row continues at the end of the base data."""
    lengths = interval_seconds(intervals)
    return stored_marks(base, signals, end, lengths, base_length).select(
        "end_time", *[F.coalesce(f"time_{label}", "end_time").alias(f"time_{label}") for label in lengths]
    )
