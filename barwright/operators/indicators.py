"""Indicator columns that depend on a bounded number of bars: window expressions only.

Bars come with ``bar_start`` and ``bar_seconds``. Frames by time use the bar's ordinal (``bar_start`` divided by
the length), so every column here looks back at most 28 bar slots. Time blocks (see ``fold``) rely on that bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import safe_div
from ..functions.timegrid import int_div
from ..schemas import AF_STEP, LONG, LONGEST, LOOKBACK_BARS, SHORT

SERIES = ("bar_interval", "symbol")


def with_slot(bars: DataFrame) -> DataFrame:
    return bars.withColumn("slot", int_div(F.col("bar_start"), F.col("bar_seconds")))


def _ordered(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("slot")


def with_previous(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """``ph``, ``pl``, ``pc``: the previous bar within reach, or the bar itself if there is none.

    Where a bar comes with the prices it was stored with (``stored_high`` and so on, else NULL), its successor sees those.
    """
    order = _ordered(keys)
    in_reach = F.lag("slot").over(order) > F.col("slot") - LOOKBACK_BARS

    def seen(source: str) -> Column:
        stored = f"stored_{source}"
        return F.coalesce(stored, source) if stored in bars.columns else F.col(source)

    return bars.withColumns(
        {
            name: F.when(in_reach, F.lag(seen(source)).over(order)).otherwise(F.col(source))
            for name, source in (("ph", "high"), ("pl", "low"), ("pc", "close"))
        }
    )


def positive_part(test: Column, value: Column) -> Column:
    """``value`` where the test holds, 0 where it does not or is NULL."""
    return F.when(test, value).otherwise(F.lit(0.0))


def with_moves(bars: DataFrame) -> DataFrame:
    """Range, gain and loss of the close, and up and down moves of the extremes against the previous bar.

    The moves are not clamped at zero: the larger one is kept even if both are negative, a tie counts as up.
    """
    change = F.col("close") - F.col("pc")
    rise, drop = F.col("high") - F.col("ph"), F.col("pl") - F.col("low")
    return bars.withColumns(
        {
            "tr": F.col("high") - F.col("low"),
            "c_diff_p": positive_part(change >= 0, change),
            "c_diff_n": positive_part(change < 0, -change),
            "dm_p": positive_part(rise >= drop, rise),
            "dm_n": positive_part(drop > rise, drop),
        }
    )


def with_extremes(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Trailing extremes over 14, 15 and 28 bars, never reaching back more than 28 slots.

    A seed row uses the 15-bar extreme, a stepped row the 14-bar one. All frames share one sort.
    """
    order = _ordered(keys)
    reach = order.rangeBetween(-(LOOKBACK_BARS - 1), 0)
    found = F.count(F.lit(1)).over(reach)
    bars = bars.withColumns(
        {
            "in_reach": found,
            "ep28_h": F.max("high").over(reach),
            "ep28_l": F.min("low").over(reach),
        }
    )
    columns = {}
    for label, rows in (("ep14", LONG), ("ep15", LONG + 1)):
        frame = order.rowsBetween(-(rows - 1), 0)
        enough = F.col("in_reach") >= rows
        columns[f"{label}_h"] = F.when(enough, F.max("high").over(frame)).otherwise(F.col("ep28_h"))
        columns[f"{label}_l"] = F.when(enough, F.min("low").over(frame)).otherwise(F.col("ep28_l"))
    return bars.withColumns(columns).drop("in_reach")


# --- seed columns: plain means over a partition that holds only the bars in reach ---------------------------


def _mean(name: str, rows: int, order: WindowSpec) -> Column:
    return F.avg(name).over(order.rowsBetween(-(rows - 1), 0))


def with_average_range(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    order = _ordered(keys)
    return bars.withColumns({"atr14": _mean("tr", LONG, order), "atr28": _mean("tr", LONGEST, order)})


def with_average_moves(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    order = _ordered(keys)
    return bars.withColumns(
        {
            "ag7": _mean("c_diff_p", SHORT, order),
            "ag14": _mean("c_diff_p", LONG, order),
            "al7": _mean("c_diff_n", SHORT, order),
            "al14": _mean("c_diff_n", LONG, order),
            "dm14_p": _mean("dm_p", LONG, order),
            "dm14_n": _mean("dm_n", LONG, order),
        }
    )


def with_previous_direction(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Previous bar's averaged moves, the bar's own for the first one."""
    order = _ordered(keys)
    first = F.lag("slot").over(order).isNull()
    return bars.withColumns(
        {
            f"p{name}": F.when(first, F.col(name)).otherwise(F.lag(name).over(order))
            for name in ("dm14_p", "dm14_n")
        }
    )


def with_direction(bars: DataFrame) -> DataFrame:
    """Directional indicators and their index, from averaged moves and range."""
    up, down, span = F.col("dm14_p"), F.col("dm14_n"), F.col("atr14")
    return bars.withColumns(
        {
            "di14_p": safe_div(up * 100, span),
            "di14_n": safe_div(down * 100, span),
            "di14_diff": safe_div((up - down) * 100, span),
            "di14_sum": safe_div((up + down) * 100, span),
            "dx14": F.abs(safe_div(up - down, up + down)) * 100,
        }
    )


def with_rsi(bars: DataFrame) -> DataFrame:
    """Relative strength; NULL where there was neither gain nor loss."""
    return bars.withColumns(
        {
            f"rsi{n}": safe_div(F.col(f"ag{n}") * 100, F.col(f"ag{n}") + F.col(f"al{n}"))
            for n in (SHORT, LONG)
        }
    )


def with_line_cross(bars: DataFrame) -> DataFrame:
    """1 where the direction lines met or changed sides since the previous bar; an unknown side counts as no."""
    now, before = F.col("dm14_p") - F.col("dm14_n"), F.col("pdm14_p") - F.col("pdm14_n")
    return bars.withColumn("di14_line_cross", F.when(before * now <= 0, 1).otherwise(0))


def with_adx_seed(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return bars.withColumn("adx", _mean("dx14", LONG, _ordered(keys)))


def with_sar_seed(bars: DataFrame) -> DataFrame:
    """Start of the parabolic stop: against the direction of the last close."""
    falling = F.col("c_diff_n") > 0
    extreme = F.when(falling, F.col("low")).otherwise(F.col("high"))
    start = F.when(falling, F.col("ep15_h")).otherwise(F.col("ep15_l"))
    return bars.withColumns(
        {
            "af": F.lit(AF_STEP).cast("decimal(3,2)"),
            "psar_type": F.when(falling, "DOWN").otherwise("UP"),
            "ep": extreme,
            "psar": start + (extreme - start) * AF_STEP,
        }
    )


def seed_signals(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Every seed column for every bar of partitions that already hold only bars in reach.

    All windows share one partitioning and one order, so the plan has a single exchange and a single sort.
    """
    rows = with_extremes(with_moves(with_previous(bars, keys)), keys)
    rows = with_direction(with_average_moves(with_average_range(rows, keys), keys))
    rows = with_adx_seed(with_previous_direction(rows, keys), keys)
    rows = with_sar_seed(with_line_cross(with_rsi(rows)))
    return rows.withColumns({"ep14_h": F.col("ep15_h"), "ep14_l": F.col("ep15_l")}).drop("ep15_h", "ep15_l")
