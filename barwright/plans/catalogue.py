"""The query catalogue: every operator over the tables of a data folder.

Symbols are event kinds (few, long, gap-free from 4h up) or users (many, short, full of gaps); base candles are hourly
and stand for the five-minute base of the pipeline, so intervals of 1, 2, 3 and 6 base candles mirror its fan-out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_matrix, parse_vector
from ..operators import bars as bar_ops
from ..operators import indicators as ind
from ..operators import patterns as pattern_ops
from ..operators import serving, steps
from ..operators.blocks import over_blocks
from ..operators.fold import compute_signals
from ..operators.forecast import fit_symbols, forecast_next
from ..operators.seeds import seed_all, seed_latest
from ..operators.watermarks import low_watermarks
from ..schemas import INDICATOR_COLUMNS, VALUE_COLUMNS
from ..session import scratch_path
from ..sources import candles, market, tables
from ..streaming.jobs import run_stream_bars, run_stream_signals
from .pipeline import (
    catch_up_signals, closed_bars, continue_signals, ingest_candles, ingest_then_signals, store_forecasts, sync_predictions,
)

Query = Callable[[SparkSession, str], DataFrame]

FAN_OUT = ("1h", "2h", "3h", "6h")
SERVED = ("4h", "1d")
ALL = (*FAN_OUT, *SERVED)
# Restart queries store everything up to this point of the series (share of its span, in days from the first day).
RESTART_AT = 20


def rounded(df: DataFrame, columns: Iterable[str], digits: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name), digits) for name in columns})


def _bars(spark: SparkSession, sf_dir: str, intervals: Iterable[str], symbol: Column | None = None) -> DataFrame:
    return bar_ops.resample(market.base_candles(spark, sf_dir, symbol), intervals)


def _slotted(spark: SparkSession, sf_dir: str, intervals: Iterable[str]) -> DataFrame:
    return ind.with_slot(_bars(spark, sf_dir, intervals))


def _signals(spark: SparkSession, sf_dir: str, intervals: Iterable[str], symbol: Column | None = None) -> DataFrame:
    return compute_signals(_bars(spark, sf_dir, intervals, symbol))


# --- ingest -------------------------------------------------------------------------------------------------


def ingest_normalize(spark, sf_dir):
    trades = market.ticks(market.table(spark, sf_dir, "events"))
    return candles.normalize_landed(market.landed_candles(trades))


def insert_ignore_merge(spark, sf_dir):
    trades = market.ticks(market.table(spark, sf_dir, "events"))
    rows = trades.select("symbol", F.col("event_id").alias("open_time"), F.col("px").alias("price"))
    present = rows.filter(F.col("open_time") % 3 == 0).withColumn("price", -F.col("price"))
    # two deliveries of every row, the second with another price: the first counts
    first, second = rows.withColumn("arrival", F.lit(1)), rows.withColumns(
        {"arrival": F.lit(2), "price": F.col("price") + 1}
    )
    schema = T.StructType([present.schema["symbol"], T.StructField("open_time", T.LongType()), T.StructField("price", T.LongType())])
    table = tables.KeyedTable(spark, scratch_path(spark, "prices"), schema, ["symbol", "open_time"], "open_time").provision()
    table.insert_ignore(present)
    table.insert_ignore(candles.gather([first, second]), ["arrival"])
    return table.rows()


def ingest_rejects(spark, sf_dir):
    """What became of the landed records: candles, or the reason of the reject."""
    landed = market.landed_candles(market.ticks(market.table(spark, sf_dir, "events")))
    number = F.col("num_trades").cast("long")
    landed = landed.withColumns({
        "time": F.when(F.col("close").cast("long") % 23 == 0, "soon").otherwise(F.col("time")),
        "symbol": F.when(F.col("close").cast("long") % 29 != 0, F.col("symbol")),
        "num_trades": number.cast("string"),
    })
    kept = candles.normalize_landed(landed).select(F.lit("candle").alias("outcome"), "num_trades")
    lost = candles.rejected(landed).select(F.col("reason").alias("outcome"), F.col("num_trades").cast("long").alias("num_trades"))
    return kept.unionByName(lost).groupBy("outcome").agg(F.count(F.lit(1)).alias("records"), F.sum("num_trades").alias("num_trades"))


def ingest_ledger(spark, sf_dir):
    """One landed file a symbol. The sender lists every record; of one symbol some records never arrived."""
    trades = market.ticks(market.table(spark, sf_dir, "events"))
    landed = market.landed_candles(trades).select(
        F.upper("symbol").alias("name"), "symbol", F.when(F.col("high").cast("long") % 23 == 0, "soon").otherwise(F.col("time")).alias("time"),
        *VALUE_COLUMNS, (F.col("time").cast("long") % 7000 == 0).alias("missing"),
    )
    folder = scratch_path(spark, "landed")
    arrived = landed.filter(~(F.col("missing") & (F.col("name") == "CLICKUSDT"))).drop("missing")
    arrived.repartition("name").write.partitionBy("name").option("compression", "gzip").json(folder)
    rows = candles.read_landed(spark, folder)
    named = lambda path: F.regexp_extract(path, "name=([^/]*)", 1)
    files = rows.select("file").distinct()
    sent = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("records"))
    expected = files.join(sent, named("file") == F.col("symbol")).select("file", "records")
    ledger = candles.file_ledger(spark, folder, rows, expected)
    return ledger.filter("file like '%.json.gz'").select(
        named("file").alias("symbol"), "expected_records", "candles", "rejected", "lost", "status"
    )


def ingest_start_mark(spark, sf_dir):
    return candles.ingest_window(market.base_candles(spark, sf_dir))


def _local_predictions(spark, sf_dir):
    rows = market.naive_predictions(_bars(spark, sf_dir, ["4h"]))
    return rows.withColumns(
        {
            "last_price": F.when((F.col("open_time") / 14400).cast("long") % 11 == 0, 0.0).otherwise(F.col("last_price")),
            "open_time": F.timestamp_seconds(F.col("open_time") + 7 * 3600),
        }
    )


def sync_shifted(spark, sf_dir):
    return tables.shifted_predictions(_local_predictions(spark, sf_dir))


def look_back_scan(spark, sf_dir):
    base = market.base_candles(spark, sf_dir)
    rows = candles.look_back(base, None, 7 * 86400)
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("open_time").alias("first_time"), F.sum("close").alias("close_sum")
    )


# --- bars ---------------------------------------------------------------------------------------------------


def bars_base(spark, sf_dir):
    return market.base_candles(spark, sf_dir)


def bars_multi_interval(spark, sf_dir):
    return _bars(spark, sf_dir, ALL).drop("bar_seconds")


def bars_many_symbols(spark, sf_dir):
    return _bars(spark, sf_dir, ALL, market.symbol_by_user()).drop("bar_seconds")


def bars_join_form(spark, sf_dir):
    return bar_ops.resample_by_join(market.base_candles(spark, sf_dir), FAN_OUT).drop("bar_seconds")


def bars_time_range(spark, sf_dir):
    """Half-open range and symbol condition of the bar source."""
    base = market.base_candles(spark, sf_dir)
    newest = candles.latest_time(base)
    wanted = base.groupBy("symbol").agg(F.max("high").alias("top")).filter(F.col("top") > 30000)
    rows = base.filter((F.col("open_time") >= newest - 10 * 86400) & (F.col("open_time") < newest - 86400))
    return bar_ops.resample(rows, ["4h"], symbols=wanted).drop("bar_seconds")


# --- window indicators --------------------------------------------------------------------------------------

KEY = ("bar_interval", "symbol", "bar_start")


def prev_bar(spark, sf_dir):
    return over_blocks(_slotted(spark, sf_dir, ALL), ind.with_previous).select(*KEY, "ph", "pl", "pc")


def _moves(spark, sf_dir):
    return ind.with_moves(over_blocks(_slotted(spark, sf_dir, ALL), ind.with_previous))


def true_range(spark, sf_dir):
    return _moves(spark, sf_dir).select(*KEY, "tr")


def gain_loss(spark, sf_dir):
    return _moves(spark, sf_dir).select(*KEY, "c_diff_p", "c_diff_n")


def directional_move(spark, sf_dir):
    return _moves(spark, sf_dir).select(*KEY, "dm_p", "dm_n")


def rolling_extremes_seed(spark, sf_dir):
    rows = over_blocks(_slotted(spark, sf_dir, ALL), ind.with_extremes)
    return rows.select(*KEY, F.col("ep15_h").alias("ep14_h"), F.col("ep15_l").alias("ep14_l"), "ep28_h", "ep28_l")


def rolling_extremes_step(spark, sf_dir):
    return over_blocks(_slotted(spark, sf_dir, ALL), ind.with_extremes).select(*KEY, "ep14_h", "ep14_l", "ep28_h", "ep28_l")


def _seed_columns(*columns: str) -> Query:
    def query(spark, sf_dir):
        rows = seed_all(_slotted(spark, sf_dir, ALL))
        exact = ("di14_line_cross", "psar_type")
        return rounded(rows.select(*KEY, *columns), [name for name in columns if name not in exact])

    return query


def _signal_output(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("af", F.col("af").cast("double")).select(
        *KEY, "open_time", "open", "high", "low", "close", "volume", "quote_asset", "num_trades", "buy_base",
        "buy_quote", *INDICATOR_COLUMNS, "di14_line_cross", "adx", "af", "psar_type", "psar", "ep",
    )
    return rounded(rows, [*INDICATOR_COLUMNS, "adx", "psar", "ep"])


def signal_seed_latest(spark, sf_dir):
    return _signal_output(seed_latest(_slotted(spark, sf_dir, ALL)))


def signal_seed_every_bar(spark, sf_dir):
    """Seed of every bar, each from its own 28 slots: exact in series with gaps too."""
    return _signal_output(seed_all(_slotted(spark, sf_dir, ALL)))


# --- recursion ----------------------------------------------------------------------------------------------


def _signal_columns(*columns: str) -> Query:
    def query(spark, sf_dir):
        rows = _signals(spark, sf_dir, ("1h", "4h")).withColumn("af", F.col("af").cast("double"))
        return rounded(rows.select(*KEY, *columns), [name for name in columns if name not in ("psar_type", "af")])

    return query


def signals_full(spark, sf_dir):
    return _signal_output(_signals(spark, sf_dir, ALL))


def signals_many_symbols(spark, sf_dir):
    return _signal_output(_signals(spark, sf_dir, ("4h", "1d"), market.symbol_by_user()))


def _newest_slot(bars: DataFrame) -> Column:
    return candles.latest_time(bars, "slot")


def _stored(spark, sf_dir, bars):
    return compute_signals(bars.drop("slot")).withColumn("slot", F.expr("bar_start div 14400"))


def signal_step_once(spark, sf_dir):
    """The newest bar of every symbol, stepped by one join from the stored rows of the bar before."""
    bars = _slotted(spark, sf_dir, ["4h"])
    return _signal_output(steps.step_once(bars, _stored(spark, sf_dir, bars), _newest_slot(bars)))


def symbols_to_seed(spark, sf_dir):
    bars = _slotted(spark, sf_dir, ["4h"])
    # the third slot of all: some symbols are ready by then
    third = bars.agg((F.min("slot") + 1).alias("third")).scalar()
    return steps.symbols_to_seed(bars, _stored(spark, sf_dir, bars), third).select("symbol")


def symbols_to_step(spark, sf_dir):
    bars = _slotted(spark, sf_dir, ["4h"])
    return steps.symbols_to_step(bars, _stored(spark, sf_dir, bars), _newest_slot(bars)).select("symbol")


def _days_in(bars: DataFrame, days: int) -> Column:
    return bars.agg((F.min("bar_start") + days * 86400).alias("cut")).scalar()


def low_watermark_row(spark, sf_dir):
    """Watermarks where each interval of each symbol was last stored at another time."""
    base = market.base_candles(spark, sf_dir)
    bars = bar_ops.resample(base, FAN_OUT)
    lag = F.length("symbol") * F.col("bar_seconds")
    signals = bars.filter(F.col("bar_start") < candles.latest_time(base) - lag)
    return low_watermarks(base, signals, 4102444800, FAN_OUT, market.BASE_SECONDS)


def _first_time(base: DataFrame) -> int:
    return base.agg(F.min("open_time")).first()[0]


def signals_catch_up(spark, sf_dir):
    """Stored in three runs. One symbol's candles arrive only for the last, another has a gap of 30 hours."""
    base = market.base_candles(spark, sf_dir)
    first = _first_time(base)
    gap = F.col("open_time").between(first + 10 * 86400, first + 10 * 86400 + 30 * 3600)
    base = base.filter(~((F.col("symbol") == "PURCHASEUSDT") & gap))
    table = tables.signal_table(spark, scratch_path(spark, "signals")).provision()
    for days, symbols in ((8, "symbol <> 'CLICKUSDT'"), (17, "symbol <> 'CLICKUSDT'"), (40000, "true")):
        catch_up_signals(base.filter(symbols), table, first + days * 86400, FAN_OUT, base_length=market.BASE_SECONDS)
    return _signal_output(table.rows())


def signals_catch_up_late(spark, sf_dir):
    """Candles of an hour come after their symbol's rows were stored beyond them: stored rows are not revised."""
    base = market.base_candles(spark, sf_dir)
    first = _first_time(base)
    late = F.col("open_time").between(first + 5 * 86400, first + 5 * 86400 + 4 * 3600)
    stored = tables.candle_table(spark, scratch_path(spark, "candles")).provision()
    table = tables.signal_table(spark, scratch_path(spark, "signals")).provision()
    for rows, days in ((base.filter(~late & (F.col("open_time") < first + 20 * 86400)), 20), (base, 40000)):
        stored.insert_ignore(rows)
        catch_up_signals(stored, table, first + days * 86400, FAN_OUT, base_length=market.BASE_SECONDS)
    return _signal_output(table.rows())


def _landed(base: DataFrame) -> DataFrame:
    text = [F.col(name).cast("string").alias(name) for name in VALUE_COLUMNS]
    return base.select(F.lower("symbol").alias("symbol"), ((F.col("open_time") + 60) * 1000).cast("string").alias("time"), *text)


def ingest_late_symbol(spark, sf_dir):
    """One symbol's files lag days behind the others': all its candles are stored when they come."""
    base = market.base_candles(spark, sf_dir)
    lags = (F.col("symbol") == "CLICKUSDT") & (F.col("open_time") >= _first_time(base) + 3 * 86400)
    table = tables.candle_table(spark, scratch_path(spark, "candles")).provision()
    for rows in (base.filter(~lags), base.filter(lags)):
        ingest_candles(_landed(rows), table)
    return table.rows()


def forecasts_stored(spark, sf_dir):
    """The forecast job, run twice: predictions are kept once."""
    prices = market.base_candles(spark, sf_dir).select("symbol", "open_time", "close")
    table = tables.prediction_table(spark, scratch_path(spark, "predictions")).provision()
    for _ in range(2):
        store_forecasts(prices, table, None, 20 * 86400)
    return rounded(table.rows(), ["next_pred", "lower", "upper", "mse", "mae"], 4)


def sync_job(spark, sf_dir):
    """The copy between prediction stores, run twice."""
    table = tables.prediction_table(spark, scratch_path(spark, "copy")).provision()
    for _ in range(2):
        sync_predictions(_local_predictions(spark, sf_dir), table)
    return table.rows()


def ingest_then_signals_twice(spark, sf_dir):
    """Landed files to candles to signals, the whole chain run twice."""
    landed = _landed(market.base_candles(spark, sf_dir))
    stored = tables.candle_table(spark, scratch_path(spark, "candles")).provision()
    signals = tables.signal_table(spark, scratch_path(spark, "signals")).provision()
    for _ in range(2):
        ingest_then_signals(landed, stored, signals, 4102444800, SERVED, market.BASE_SECONDS)
    return _signal_output(signals.rows())


def signals_restart(spark, sf_dir):
    """Signals of the last days, continued from rows stored before: equal to the one-shot result."""
    bars = _bars(spark, sf_dir, ALL)
    cut = _days_in(bars, RESTART_AT)
    stored = compute_signals(closed_bars(bars, cut))
    return _signal_output(continue_signals(bars, stored))


# --- forecast -----------------------------------------------------------------------------------------------


def forecast_fit(spark, sf_dir):
    bars = _bars(spark, sf_dir, ["4h"])
    fit = fit_symbols(bars.select("symbol", F.col("bar_start").alias("open_time"), "close"))
    return rounded(fit, ["next_pred", "lower", "upper", "mse", "mae", "phi"], 4)


def forecast_many_symbols(spark, sf_dir):
    bars = _bars(spark, sf_dir, ["4h"], market.symbol_by_user())
    fit = fit_symbols(bars.select("symbol", F.col("bar_start").alias("open_time"), "close"))
    return rounded(fit, ["next_pred", "lower", "upper", "mse", "mae", "phi"], 4)


def forecast_lookback(spark, sf_dir):
    prices = market.base_candles(spark, sf_dir).select("symbol", "open_time", "close")
    return rounded(forecast_next(prices, None, 20 * 86400), ["next_pred", "lower", "upper", "mse", "mae"], 4)


# --- read queries -------------------------------------------------------------------------------------------


def coin_prices(spark, sf_dir):
    return serving.coin_prices(_signals(spark, sf_dir, ("1h", "1d")), recent="1h")


def latest_semi_join(spark, sf_dir):
    rows = serving.for_interval(_signals(spark, sf_dir, ("4h",)), "4h")
    return rounded(serving.latest_rows_by_join(rows).select("symbol", "bar_start", "close", "rsi14"), ["rsi14"])


def _top(query, rsi: str, interval: str) -> Query:
    def run(spark, sf_dir):
        label = serving.served_interval(interval)
        signals = _signals(spark, sf_dir, (label,), market.symbol_by_user())
        return rounded(query(signals, rsi, interval), ["rsi"])

    return run


def rsi_change(spark, sf_dir):
    return serving.rsi_change(_signals(spark, sf_dir, ("4h",)), "rsi14", "FOUR_HOUR")


def rsi_change_daily(spark, sf_dir):
    return serving.rsi_change(_signals(spark, sf_dir, ("1d",), market.symbol_by_user()), "rsi7", "ONE_DAY")


def rsi_change_stored(spark, sf_dir):
    """The same from a stored signal table, by its newest rows and the days before them."""
    base = market.base_candles(spark, sf_dir)
    table = tables.signal_table(spark, scratch_path(spark, "signals")).provision()
    catch_up_signals(base, table, _first_time(base) + 40000 * 86400, ("4h",), base_length=market.BASE_SECONDS)
    return serving.stored_rsi_change(table, "rsi14", "FOUR_HOUR")


def _patterns(spark, sf_dir):
    return market.price_patterns(_bars(spark, sf_dir, ["1d"]))


def pattern_rows(spark, sf_dir):
    """All stored patterns with their vectors parsed, one row per position."""
    rows = _patterns(spark, sf_dir)
    vectors = rows.select(
        "symbol1", "symbol2", "end_date",
        F.posexplode(F.arrays_zip(
            parse_vector(F.col("prices2")).alias("original_price"),
            parse_vector(F.col("s2_norm")).alias("original_norm"),
            parse_matrix(F.col("prices1"))[0].alias("similar_close"),
            parse_matrix(F.col("prices1"))[1].alias("similar_open"),
            parse_matrix(F.col("s1_norm"))[0].alias("similar_norm"),
        )).alias("position", "v"),
    )
    return vectors.select("symbol1", "symbol2", "end_date", "position", "v.*")


def pattern_pairs(spark, sf_dir):
    return pattern_ops.original_pairs(_patterns(spark, sf_dir))


def pattern_detail(spark, sf_dir):
    detail = pattern_ops.pattern_detail(_patterns(spark, sf_dir), "PURCHASEUSDT")
    rows = detail.select(
        "original_symbol", "original_start_date", "original_end_date",
        F.col("similar_symbols")[0].alias("similar_symbol"),
        F.col("similar_start_dates")[0].alias("similar_start_date"),
        F.col("similar_end_dates")[0].alias("similar_end_date"),
        F.posexplode(F.arrays_zip("original_prices", "original_fibonacci", F.col("similar_prices")[0].alias("similar_prices"),
                                  F.col("similar_fibonacci")[1].alias("similar_fibonacci"))).alias("position", "v"),
    )
    return rows.select("*", "v.*").drop("v")


def predictions_latest(spark, sf_dir):
    return serving.latest_predictions(market.naive_predictions(_bars(spark, sf_dir, ["4h"])))


# --- streams ------------------------------------------------------------------------------------------------


# one file, read in one batch: no row is behind another batch
NO_DELAY = "0 seconds"


def stream_bars(spark, sf_dir):
    return run_stream_bars(spark, sf_dir, ["4h"], NO_DELAY)


def stream_bars_fan_out(spark, sf_dir):
    return run_stream_bars(spark, sf_dir, FAN_OUT, NO_DELAY)


def stream_signals(spark, sf_dir):
    return _signal_output(run_stream_signals(spark, sf_dir, ["4h"], NO_DELAY))


CATALOGUE: dict[str, Query] = {
    "ingest_normalize": ingest_normalize,
    "ingest_rejects": ingest_rejects,
    "insert_ignore_merge": insert_ignore_merge,
    "ingest_ledger": ingest_ledger,
    "ingest_start_mark": ingest_start_mark,
    "sync_shifted": sync_shifted,
    "look_back_scan": look_back_scan,
    "bars_base": bars_base,
    "bars_multi_interval": bars_multi_interval,
    "bars_many_symbols": bars_many_symbols,
    "bars_join_form": bars_join_form,
    "bars_time_range": bars_time_range,
    "prev_bar": prev_bar,
    "true_range": true_range,
    "gain_loss": gain_loss,
    "directional_move": directional_move,
    "rolling_extremes_seed": rolling_extremes_seed,
    "rolling_extremes_step": rolling_extremes_step,
    "atr_sma": _seed_columns("atr14", "atr28"),
    "rsi_sma": _seed_columns("ag7", "ag14", "al7", "al14", "rsi7", "rsi14"),
    "dm_sma": _seed_columns("dm14_p", "dm14_n"),
    "di_dx_sma": _seed_columns("di14_p", "di14_n", "di14_diff", "di14_sum", "dx14"),
    "adx_sma": _seed_columns("adx"),
    "di_cross_sma": _seed_columns("di14_line_cross"),
    "psar_seed": _seed_columns("psar_type", "ep", "psar"),
    "signal_seed_latest": signal_seed_latest,
    "signal_seed_every_bar": signal_seed_every_bar,
    "signal_step_once": signal_step_once,
    "wilder_smoothing": _signal_columns("ag7", "ag14", "al7", "al14", "dm14_p", "dm14_n", "atr14", "atr28"),
    "adx_recursive": _signal_columns("dx14", "adx"),
    "psar_recursive": _signal_columns("af", "ep", "psar_type", "psar"),
    "signals_full": signals_full,
    "signals_many_symbols": signals_many_symbols,
    "symbols_to_seed": symbols_to_seed,
    "symbols_to_step": symbols_to_step,
    "low_watermarks": low_watermark_row,
    "signals_restart": signals_restart,
    "signals_catch_up": signals_catch_up,
    "signals_catch_up_late": signals_catch_up_late,
    "ingest_late_symbol": ingest_late_symbol,
    "forecasts_stored": forecasts_stored,
    "sync_job": sync_job,
    "ingest_then_signals": ingest_then_signals_twice,
    "forecast_next": forecast_fit,
    "forecast_many_symbols": forecast_many_symbols,
    "forecast_lookback": forecast_lookback,
    "coin_prices": coin_prices,
    "latest_semi_join": latest_semi_join,
    "top_over_sold": _top(serving.top_over_sold, "RSI14", "FOUR_HOUR"),
    "top_over_bought": _top(serving.top_over_bought, "rsi7", "FOUR_HOUR"),
    "top_over_bought_daily": _top(serving.top_over_bought, "rsi7", "anything else"),
    "rsi_change": rsi_change,
    "rsi_change_daily": rsi_change_daily,
    "rsi_change_stored": rsi_change_stored,
    "pattern_rows": pattern_rows,
    "pattern_pairs": pattern_pairs,
    "pattern_detail": pattern_detail,
    "predictions_latest": predictions_latest,
    "stream_bars": stream_bars,
    "stream_bars_fan_out": stream_bars_fan_out,
    "stream_signals": stream_signals,
}
