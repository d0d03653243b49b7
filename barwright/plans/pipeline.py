"""Whole jobs: ingest, catch-up of the signal table, forecasts, and the copy between prediction stores."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bars import interval_seconds, only_symbols, resample
from ..operators.blocks import BLOCK_SLOTS, WARMUP_SLOTS
from ..operators.fold import carry_of, compute_signals, finish_signals, fold_blocks, no_carry
from ..operators.forecast import forecast_next
from ..operators.indicators import with_slot
from ..operators.recursion import STATE
from ..operators.steps import is_ready
from ..schemas import BAR_SECONDS, CANDLES, FORECAST_LOOKBACK, LOOKBACK_BARS, PIPELINE_INTERVALS, VALUE_COLUMNS
from ..session import materialize, scratch
from ..sources.candles import gather, normalize_landed
from ..sources.tables import CandleTable, KeyedTable, SignalTable, candle_marks, newest_rows, shifted_predictions

SERIES = ["bar_interval", "symbol"]


def closed_bars(bars: DataFrame, end: int | Column | None) -> DataFrame:
    """Bars that ended by ``end``; an open bar would be stored half done and never revised."""
    return bars if end is None else bars.filter(F.col("close_time") <= end)


def with_length(signals: DataFrame, lengths: Mapping[str, int] = BAR_SECONDS) -> DataFrame:
    """Stored rows with the length of their bars, which follows from the label."""
    by_label = F.create_map(*[F.lit(part) for item in lengths.items() for part in item])
    return signals.withColumn("bar_seconds", by_label[F.col("bar_interval")].cast("long"))


def with_state(stored: DataFrame) -> DataFrame:
    """Stored rows with the state columns that are kept in another form."""
    return stored.withColumns(
        {
            "af_steps": F.round(F.col("af").cast("double") * 50),
            "rising": F.when(F.col("psar_type") == "UP", 1.0).otherwise(0.0),
        }
    )


PRICES = ("high", "low", "close")


def newest_states(stored: DataFrame) -> DataFrame:
    """The state of each series: where its newest stored row is, that row's prices and recursive values."""
    rows = with_state(with_slot(with_length(stored)))
    names = [*STATE, *PRICES, "rsi7", "rsi14"]
    return rows.groupBy(*SERIES).agg(
        F.max("slot").alias("stored_slot"), *[F.max_by(name, "slot").alias(f"stored_{name}") for name in names]
    )


def continue_signals(
    bars: DataFrame,
    stored: DataFrame,
    update_time: Column | int = 0,
    reseed: bool = True,
    recomputed: bool = False,
    block: int = BLOCK_SLOTS,
    warmup: int = WARMUP_SLOTS,
) -> DataFrame:
    """Signals of the bars that are newer than the newest stored row of their series; all bars of a series without one.

    A bar steps from the stored row in the slot before it: from that row's state and from its high, low and close, also
    where late candles have changed the bar since. Trailing extremes and seeds need the 28 slots before the new bars:
    they come from the stored rows or, if ``recomputed``, from ``bars``, which then reach back so far.
    """
    newest = newest_states(stored)
    newer = F.coalesce(F.col("slot") > F.col("stored_slot"), F.lit(True))
    known = F.col("slot") == F.col("stored_slot")
    prices = [f"stored_{name}" for name in PRICES]
    columns = ["bar_interval", "symbol", "bar_start", "open_time", *VALUE_COLUMNS, "slot", "fresh", "carry", *prices]
    rows = with_slot(bars).join(newest, SERIES, "left")
    if recomputed:
        # a bar behind an incomplete row is seeded, and a seed sees recomputed bars only
        steps = known & is_ready("stored_")
        rows = rows.filter(newer | (F.col("slot") > F.col("stored_slot") - LOOKBACK_BARS)).withColumns(
            {"fresh": newer, "carry": F.when(known, carry_of("stored_")), **{name: F.when(steps, F.col(name)) for name in prices}}
        )
    else:
        unknown = {name: F.lit(None).cast("double") for name in prices}
        rows = rows.filter(newer).withColumns({"fresh": F.lit(True), "carry": no_carry(), **unknown})
        first_new = rows.groupBy(*SERIES).agg(F.min("slot").alias("first_new"), F.max("stored_slot").alias("stored_slot"))
        context = (
            with_state(with_slot(with_length(stored)))
            .join(first_new, SERIES)
            .filter(F.col("slot") > F.col("first_new") - LOOKBACK_BARS)
            .withColumns({"fresh": F.lit(False), "carry": F.when(known, carry_of()), **unknown})
        )
        rows = rows.select(*columns).unionByName(context.select(*columns))
    return finish_signals(fold_blocks(rows.select(*columns), reseed, block, warmup), update_time)


def pending_symbols(newest: DataFrame, marks: DataFrame, lengths: Mapping[str, int], end: int) -> DataFrame:
    """``symbol, needed_from, unseen`` of the symbols with candles for a bar that no series of theirs has yet.

    ``needed_from`` is where their base rows have to start: 28 slots before the oldest stored row that has to go on, or the first candle
    where a series has no row (``unseen``).
    """
    series = F.explode(F.array(*[
        F.struct(F.lit(label).alias("bar_interval"), F.lit(seconds).cast("long").alias("bar_seconds")) for label, seconds in lengths.items()
    ]))
    stored = newest.select(*SERIES, "bar_start")
    all_series = marks.filter(F.col("first_time") < end).select("symbol", "first_time", "last_time", series.alias("s")).select(
        "symbol", "first_time", "last_time", "s.*"
    )
    joined = all_series.join(stored, SERIES, "left")
    unseen = F.col("bar_start").isNull()
    goes_on = F.least(F.col("last_time"), F.lit(end - 1)) >= F.col("bar_start") + F.col("bar_seconds")
    start = F.when(unseen, F.col("first_time")).otherwise(F.col("bar_start") - LOOKBACK_BARS * F.col("bar_seconds"))
    return joined.filter(unseen | goes_on).groupBy("symbol").agg(F.min(start).alias("needed_from"), F.bool_or(unseen).alias("unseen"))


def catch_up_signals(
    base: DataFrame | CandleTable,
    table: SignalTable,
    end: int,
    intervals: Iterable[str] | Mapping[str, int] = PIPELINE_INTERVALS,
    symbols: DataFrame | Iterable[str] | None = None,
    base_length: int = 300,
    reseed: bool = True,
) -> None:
    """Bring the signal table up to ``end``: one job for all bars, symbols and intervals.

    Each series continues at its own newest stored row. Only symbols with candles behind that row take part. Their base rows are read
    from 28 slots before the oldest of these rows on, in whole days of a ``CandleTable``; series without a stored row start at their
    first candle and are read apart, so a new symbol does not send the others back to its past. Of the signal table the newest rows are
    read, and the days they were stored on since: rows that a run added which died before it wrote its state.
    """
    end = end // base_length * base_length
    lengths = interval_seconds(intervals)
    spark = table.spark
    with scratch(spark):
        marks = only_symbols(base.marks() if isinstance(base, CandleTable) else candle_marks(base.filter(F.col("open_time") < end)), symbols)
        stored = table.newest().filter(F.col("bar_interval").isin(list(lengths)))
        reach = materialize(pending_symbols(stored, marks, lengths, end), "pending")
        starts = {r["unseen"]: r["start"] for r in reach.groupBy("unseen").agg(F.min("needed_from").alias("start")).collect()}
        if not starts:
            return
        if False in starts:
            since = table.since(starts[False]).filter(F.col("bar_interval").isin(list(lengths)))
            stored = newest_rows(stored.unionByName(since))
        newest = materialize(stored.join(reach.select("symbol"), "symbol", "left_semi"), "newest")
        parts = []
        for unseen, start in starts.items():
            # one literal bound for all, which prunes; then each symbol's own
            rows = base.since(start) if isinstance(base, CandleTable) else base.filter(F.col("open_time") >= start)
            own = reach.filter(F.col("unseen") == unseen).select("symbol", "needed_from")
            rows = rows.filter(F.col("open_time") < end).join(own, "symbol").filter(F.col("open_time") >= F.col("needed_from"))
            parts.append(rows.select(*CANDLES.names))
        bars = closed_bars(resample(gather(parts), lengths), end)
        days = table.insert_ignore(continue_signals(bars, newest, end, reseed, recomputed=True))
        if days:
            table.replace_newest(days)


def ingest_candles(landed: DataFrame, table: CandleTable) -> None:
    """Append the landed candles that are new, whatever their time: a symbol that lags behind the others loses nothing.

    Where a fetch should start is ``ingest_window``; records in hand are never dropped by it.
    """
    table.insert_ignore(normalize_landed(landed))


def ingest_then_signals(
    landed: DataFrame,
    candles: CandleTable,
    signals: SignalTable,
    end: int,
    intervals: Iterable[str] | Mapping[str, int] = PIPELINE_INTERVALS,
    base_length: int = 300,
) -> None:
    """The hourly chain: landed files to candles, candles to signals. Its cost follows what is new. Running it again adds nothing."""
    ingest_candles(landed, candles)
    catch_up_signals(candles, signals, end, intervals, base_length=base_length)


def rebuild_signals(base: DataFrame, intervals: Iterable[str] | Mapping[str, int], end: int | None = None) -> DataFrame:
    """Signals of the whole base series."""
    return compute_signals(closed_bars(resample(base, intervals), end), 0 if end is None else end)


def store_forecasts(prices: DataFrame, table: KeyedTable, as_of=None, seconds: int | None = FORECAST_LOOKBACK) -> None:
    """Forecast every symbol from the last 90 days of a price table and keep predictions that are new."""
    with scratch(table.spark):
        table.insert_ignore(forecast_next(prices, as_of, seconds))


def sync_predictions(source: DataFrame, table: KeyedTable, as_of=None) -> None:
    table.insert_ignore(shifted_predictions(source, as_of))
