"""Read queries over signals and predictions.

``signals`` holds all bar lengths; a request's interval name selects one, which prunes the table's partitions.
``as_of`` is the clock in epoch seconds; left out, it is the newest bar of the interval.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import percent_change, round_binary, round_scaled
from ..functions.text import coin_name
from ..schemas import (
    DAILY_LOOKBACK,
    OVERBOUGHT,
    OVERSOLD,
    PRICE_LOOKBACK,
    SNAPSHOT_LOOKBACK,
    TOP_LIMIT,
    rsi_column,
    served_interval,
)
from ..session import materialize
from ..sources.candles import clock, latest_time, look_back
from ..sources.tables import SignalTable

QUOTE = "USDT"
DAY = 86400


def for_interval(signals: DataFrame, label: str) -> DataFrame:
    return signals.filter(F.col("bar_interval") == label)


def latest_rows(rows: DataFrame, columns: list[str], time: str = "bar_start") -> DataFrame:
    """Newest row per symbol, by aggregates that combine before the shuffle."""
    return rows.groupBy("symbol").agg(
        F.max(time).alias(time), *[F.max_by(name, time).alias(name) for name in columns]
    )


def latest_rows_by_join(rows: DataFrame, time: str = "bar_start") -> DataFrame:
    """Whole rows whose ``(symbol, time)`` is the newest of the symbol: a left semi join on both columns."""
    newest = rows.groupBy("symbol").agg(F.max(time).alias(time))
    return rows.join(newest, ["symbol", time], "left_semi")


def coin_prices(
    signals: DataFrame,
    as_of: int | Column | None = None,
    recent: str = "5m",
    daily: str = "1d",
) -> DataFrame:
    """Latest close per coin and its change against the latest daily close, in percent."""
    now_rows = for_interval(signals, recent)
    day_rows = for_interval(signals, daily)
    as_of = clock(now_rows, as_of, "bar_start")
    now = latest_rows(look_back(now_rows, as_of, PRICE_LOOKBACK, "bar_start"), ["close"])
    day = latest_rows(look_back(day_rows, as_of, DAILY_LOOKBACK, "bar_start"), ["close"])
    # both sides are already partitioned by symbol: the join adds no shuffle
    joined = now.select("symbol", "close").join(day.select("symbol", F.col("close").alias("daily_close")), "symbol")
    change = (F.col("close") - F.col("daily_close")) * 100
    return joined.select(
        coin_name(F.col("symbol")).alias("coin"),
        round_binary(F.col("close"), 6).alias("price"),
        round_scaled(F.try_divide(change, F.col("daily_close")), 2).alias("price_change"),
    )


def snapshot_time(rows: DataFrame, as_of: int | Column | None = None) -> Column:
    """Newest bar of the last week that has any symbol."""
    times = (
        look_back(rows, as_of, SNAPSHOT_LOOKBACK, "bar_start")
        .groupBy("bar_start")
        .agg(F.count("symbol").alias("num"))
        .filter(F.col("num") > 0)
    )
    return latest_time(times, "bar_start")


def _ranked(signals: DataFrame, rsi: str, interval: str, as_of, keep, order) -> DataFrame:
    value = F.col(rsi_column(rsi))
    rows = for_interval(signals, served_interval(interval))
    return (
        rows.filter(value.isNotNull() & keep(value) & F.col("symbol").endswith(QUOTE))
        .filter(F.col("bar_start") == snapshot_time(rows, as_of))
        .orderBy(order(value), "symbol")
        .limit(TOP_LIMIT)
        .select("symbol", value.alias("rsi"), "close", "low", "high", F.col("bar_start").cast("string").alias("date_created"))
    )


def top_over_sold(signals: DataFrame, rsi: str = "rsi14", interval: str = "FOUR_HOUR", as_of=None) -> DataFrame:
    """The symbols with the lowest RSI under the threshold at the latest snapshot."""
    return _ranked(signals, rsi, interval, as_of, lambda v: v < OVERSOLD, lambda v: v.asc())


def top_over_bought(signals: DataFrame, rsi: str = "rsi14", interval: str = "FOUR_HOUR", as_of=None) -> DataFrame:
    """The symbols with the highest RSI over the threshold at the latest snapshot."""
    return _ranked(signals, rsi, interval, as_of, lambda v: v > OVERBOUGHT, lambda v: v.desc())


def rsi_change(signals: DataFrame, rsi: str = "rsi14", interval: str = "FOUR_HOUR") -> DataFrame:
    """RSI at the globally newest bar and its change against the symbol's own bar before, in percent.

    One aggregate replaces the self joins: a symbol's row at the newest time, and its newest row before it.
    """
    rows = for_interval(signals, served_interval(interval)).select("symbol", "bar_start", rsi_column(rsi))
    newest = latest_time(rows, "bar_start")
    marked = rows.filter(F.col("symbol").endswith(QUOTE)).select(
        "symbol", F.col(rsi_column(rsi)).alias("value"), "bar_start", (F.col("bar_start") == newest).alias("is_newest")
    )
    earlier = F.when(~F.col("is_newest"), F.col("bar_start"))
    pairs = marked.groupBy("symbol").agg(
        F.max(F.when(F.col("is_newest"), F.col("value"))).alias("rsi"),
        F.max_by("value", earlier).alias("previous"),
        F.max("is_newest").alias("has_newest"),
        F.max(earlier).alias("previous_time"),
    )
    return _changes(pairs.filter(F.col("has_newest") & F.col("previous_time").isNotNull()))


def _changes(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "symbol",
        round_binary(F.col("rsi"), 2).alias("rsi"),
        round_binary(percent_change(F.col("rsi"), F.col("previous")), 2).alias("percentage_change"),
    ).orderBy("symbol")


def stored_rsi_change(table: SignalTable, rsi: str = "rsi14", interval: str = "FOUR_HOUR") -> DataFrame:
    """``rsi_change`` of a signal table, without reading its history.

    The newest bars lie in the table's state. Their earlier bars are looked for backwards from the newest day: days further
    back are read only while symbols are left without one, and each reach is twice the one before.
    """
    label = served_interval(interval)
    state = for_interval(table.newest(), label)
    newest = state.agg(F.max("bar_start")).first()[0]
    wanted = materialize(
        state.filter(F.col("symbol").endswith(QUOTE) & (F.col("bar_start") == newest))
        .select("symbol", F.col(rsi_column(rsi)).alias("rsi")),
        "wanted",
    )
    found = [wanted.withColumn("previous", F.col("rsi")).limit(0)]
    before, first, reach = newest, (newest or 0) // DAY * DAY, DAY
    while not wanted.isEmpty():
        # from the first day on everything older comes along, also from before the epoch
        days = table.between(first, before) if first > 0 else table.before(before)
        earlier = for_interval(days, label).select("symbol", "bar_start", F.col(rsi_column(rsi)).alias("value"))
        met = earlier.join(wanted, "symbol").groupBy("symbol").agg(
            F.first("rsi").alias("rsi"), F.max_by("value", "bar_start").alias("previous")
        )
        found.append(materialize(met, "found"))
        wanted = materialize(wanted.join(found[-1], "symbol", "left_anti"), "wanted")
        if first <= 0:
            break
        before, first, reach = first, first - reach, 2 * reach
    return _changes(reduce(DataFrame.unionByName, found))


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """Predictions of the latest forecast time, with the expected change in percent."""
    rows = predictions.filter(F.col("open_time") == latest_time(predictions))
    return rows.select(
        "symbol",
        F.col("open_time").cast("string").alias("date"),
        round_binary(F.col("last_price"), 6).alias("price"),
        round_binary(F.col("next_pred"), 6).alias("prediction"),
        round_binary(percent_change(F.col("next_pred"), F.col("last_price")), 6).alias("price_change"),
    )
