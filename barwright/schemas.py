"""Explicit schemas and the fixed values of the data model. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------------------------
# Bar lengths in seconds by label.
BAR_SECONDS = {
    "5m": 300,
    "10m": 600,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "2h": 7200,
    "3h": 10800,
    "4h": 14400,
    "6h": 21600,
    "1d": 86400,
}
# Bar lengths of the signal pipeline, and the names read requests use for the served ones.
PIPELINE_INTERVALS = ("5m", "10m", "15m", "30m")
SERVED_INTERVALS = {"FOUR_HOUR": "4h", "ONE_HOUR": "1h", "THIRTY_MINUTE": "30m"}
DEFAULT_SERVED_INTERVAL = "1d"
RSI_COLUMNS = ("rsi7", "rsi14")
# Averaging lengths, look-back and parabolic SAR steps.
SHORT, LONG, LONGEST = 7, 14, 28
LOOKBACK_BARS = 28
AF_STEP, AF_MAX_STEPS = 0.02, 10
# Look-backs and limits of the read queries.
OVERSOLD, OVERBOUGHT, TOP_LIMIT = 30, 70, 100
SNAPSHOT_LOOKBACK = 7 * 86400
PRICE_LOOKBACK, DAILY_LOOKBACK = 100 * 3600, 20 * 86400
FORECAST_LOOKBACK = 90 * 86400
SYNC_LOOKBACK, SYNC_SHIFT = 2 * 3600, 7 * 3600
INGEST_LOOKBACK, INGEST_LAG = 3600, 300
# ----------------------------------------------------------------------------------------------------------

VALUE_COLUMNS = ("open", "high", "low", "close", "volume", "quote_asset", "num_trades", "buy_base", "buy_quote")


def _fields(kind: T.DataType, names: tuple[str, ...]) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


CANDLES = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("open_time", T.LongType())]
    + _fields(T.DoubleType(), ("open", "high", "low", "close", "volume", "quote_asset"))
    + _fields(T.LongType(), ("num_trades",))
    + _fields(T.DoubleType(), ("buy_base", "buy_quote"))
)

# Landed vendor records: everything is text until it has been coerced.
LANDED_CANDLES = T.StructType(
    _fields(T.StringType(), ("symbol", "time") + VALUE_COLUMNS)
)

BAR_COLUMNS = ("bar_interval", "symbol", "bar_start", "close_time", "open_time") + VALUE_COLUMNS

# Columns of a signal row after its bar columns, in storage order.
INDICATOR_COLUMNS = (
    "ph", "pl", "pc", "tr", "c_diff_p", "c_diff_n", "dm_p", "dm_n",
    "ep14_h", "ep14_l", "ep28_h", "ep28_l", "atr14", "atr28",
    "ag7", "ag14", "al7", "al14", "dm14_p", "dm14_n",
    "di14_diff", "di14_sum", "dx14", "rsi7", "rsi14", "di14_p", "di14_n",
)

SIGNALS = T.StructType(
    [
        T.StructField("bar_interval", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("bar_start", T.LongType()),
        T.StructField("update_time", T.LongType()),
        T.StructField("open_time", T.LongType()),
    ]
    + _fields(T.DoubleType(), ("open", "high", "low", "close", "volume", "quote_asset"))
    + _fields(T.LongType(), ("num_trades",))
    + _fields(T.DoubleType(), ("buy_base", "buy_quote"))
    + _fields(T.DoubleType(), INDICATOR_COLUMNS)
    + [
        T.StructField("di14_line_cross", T.IntegerType()),
        T.StructField("adx", T.DoubleType()),
        T.StructField("af", T.DecimalType(3, 2)),
        T.StructField("psar_type", T.StringType()),
        T.StructField("psar", T.DoubleType()),
        # declared but never filled: kept so that readers of the wide table find them
        T.StructField("psar_up", T.DoubleType()),
        T.StructField("psar_down", T.DoubleType()),
        T.StructField("ep", T.DoubleType()),
    ]
)
# Bars are keyed by grid time: the first candle of a bar may come late, its slot does not move.
SIGNAL_KEY = ("bar_interval", "symbol", "bar_start")

CANDLE_KEY = ("symbol", "open_time")

PREDICTIONS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("open_time", T.LongType())]
    + _fields(T.DoubleType(), ("next_pred", "last_price", "lower", "upper", "mse", "mae"))
)
PREDICTION_KEY = ("symbol", "open_time")

PATTERNS = T.StructType(
    _fields(T.StringType(), ("symbol1", "symbol2"))
    + _fields(T.LongType(), ("start_date1", "start_date2", "end_date"))
    + _fields(T.StringType(), ("prices1", "prices2", "s1_norm", "s2_norm"))
)


def served_interval(name: str | None) -> str:
    """Bar label behind a request's interval name; an unknown name means daily bars."""
    return SERVED_INTERVALS.get(name or "", DEFAULT_SERVED_INTERVAL)


def rsi_column(name: str) -> str:
    """Validated RSI column name."""
    column = name.lower()
    if column not in RSI_COLUMNS:
        raise ValueError(f"unknown RSI column {name!r}; expected one of {RSI_COLUMNS}")
    return column
