"""Market tables derived from an event log: trades, base candles, and the stored tables read queries expect.

An event is a trade of its kind's (or its user's) symbol at a price in whole cents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timegrid import epoch_seconds
from ..operators.bars import candles_from_ticks
from ..operators.blocks import over_blocks
from ..operators.indicators import with_previous, with_slot
from ..schemas import LANDED_CANDLES, LOOKBACK_BARS, PATTERNS, PREDICTIONS

BASE_SECONDS = 3600
PATTERN_BARS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_by_kind() -> Column:
    quote = F.when(F.col("event_type") == "error", "BTC").otherwise("USDT")
    return F.concat(F.upper("event_type"), quote)


def symbol_by_user() -> Column:
    return F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("USDT"))


def ticks(events: DataFrame, symbol: Column | None = None) -> DataFrame:
    return events.select(
        (symbol_by_kind() if symbol is None else symbol).alias("symbol"),
        "ts",
        epoch_seconds(F.col("ts")).alias("sec"),
        F.round(F.col("value") * 100).cast("long").alias("px"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.col("event_id") % 2 == 0).alias("buyer"),
        "event_id",
    )


def base_candles(spark: SparkSession, sf_dir: str, symbol: Column | None = None) -> DataFrame:
    return candles_from_ticks(ticks(table(spark, sf_dir, "events"), symbol), BASE_SECONDS)


def landed_candles(trades: DataFrame) -> DataFrame:
    """Vendor-like text records: milliseconds, every value as text, some unusable or absent."""
    price = F.col("px").cast("string")
    opening = F.when(F.col("event_id") % 17 == 0, "n/a").when(F.col("event_id") % 19 != 0, price)
    bought = F.col("buyer").cast("int")
    values = {
        "symbol": F.lower("symbol"),
        "time": F.col("sec") * 1000,
        "open": opening,
        "high": price,
        "low": price,
        "close": price,
        "volume": F.col("k"),
        "quote_asset": F.col("k") * F.col("px"),
        "num_trades": F.lit(1),
        "buy_base": F.col("k") * bought,
        "buy_quote": F.col("k") * F.col("px") * bought,
    }
    return trades.select(*[values[f.name].cast("string").alias(f.name) for f in LANDED_CANDLES])


def naive_predictions(bars: DataFrame) -> DataFrame:
    """Stored prediction rows: each bar extrapolated from its predecessor (from itself where there is none)."""
    rows = over_blocks(with_slot(bars), with_previous)
    zero = F.lit(0.0)
    return rows.select(
        "symbol", F.col("bar_start").alias("open_time"), (F.col("close") * 2 - F.col("pc")).alias("next_pred"),
        F.col("close").alias("last_price"), zero.alias("lower"), zero.alias("upper"), zero.alias("mse"), zero.alias("mae"),
    ).select(*PREDICTIONS.names)


def price_patterns(bars: DataFrame) -> DataFrame:
    """Stored pattern rows: each symbol's last five closes beside those of the next symbol on the same day."""
    def printed(values: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("long").cast("string")), " "), F.lit("]"))

    def normal(values: Column) -> Column:
        low, high = F.array_min(values), F.array_max(values)
        return F.transform(
            values, lambda x: F.when(high == low, F.lit(0)).otherwise(F.floor(F.try_divide((x - low) * 100, high - low)))
        )

    def rows_of(*vectors: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(" ", *[printed(v) for v in vectors]), F.lit("]"))

    def last_bars(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        frame = Window.partitionBy(*keys).orderBy("slot").rowsBetween(-(PATTERN_BARS - 1), 0)
        return rows.withColumns(
            {
                "closes": F.collect_list("close").over(frame),
                "opens": F.collect_list("open").over(frame),
                "oldest": F.min("slot").over(frame),
            }
        )

    day = over_blocks(with_slot(bars), last_bars).filter(
        (F.size("closes") == PATTERN_BARS) & (F.col("oldest") > F.col("slot") - LOOKBACK_BARS)
    )
    beside = Window.partitionBy("bar_start").orderBy("symbol")
    paired = day.select(
        F.col("symbol").alias("symbol2"), F.col("bar_start").alias("end_date"), "closes",
        *[F.lead(name).over(beside).alias(alias) for name, alias in (
            ("symbol", "symbol1"), ("closes", "closes1"), ("opens", "opens1"))],
    ).filter(F.col("symbol1").isNotNull())
    start = F.col("end_date") - (PATTERN_BARS - 1) * 86400
    return paired.select(
        "symbol1", "symbol2", start.alias("start_date1"), start.alias("start_date2"), "end_date",
        rows_of(F.col("closes1"), F.col("opens1")).alias("prices1"),
        printed(F.col("closes")).alias("prices2"),
        rows_of(normal(F.col("closes1")), normal(F.col("opens1"))).alias("s1_norm"),
        printed(normal(F.col("closes"))).alias("s2_norm"),
    ).select(*PATTERNS.names)
