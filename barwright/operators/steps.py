"""One step of the recursive indicators as a join, and the selection of what may step.

The block fold covers whole series; these forms serve a single bar time: all symbols at once, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import greatest_or_null, least_or_null, safe_div
from ..schemas import AF_MAX_STEPS, AF_STEP, LONG, LOOKBACK_BARS
from .indicators import with_direction, with_extremes, with_line_cross, with_moves, with_rsi
from .recursion import SMOOTHED

SOURCES = {
    "ag7": ("c_diff_p", 7), "ag14": ("c_diff_p", 14), "al7": ("c_diff_n", 7), "al14": ("c_diff_n", 14),
    "dm14_p": ("dm_p", 14), "dm14_n": ("dm_n", 14), "atr14": ("tr", 14), "atr28": ("tr", 28),
}
VALID = ("rsi7", "rsi14", "adx", "psar")


def is_ready(row: str = "") -> Column:
    """A stored row the next bar may step from."""
    ready = F.lit(True)
    for name in VALID:
        ready = ready & F.col(f"{row}{name}").isNotNull()
    return ready


def symbols_to_seed(bars: DataFrame, stored: DataFrame, slot: int | Column) -> DataFrame:
    """Series with a bar at ``slot`` whose stored row one slot earlier is missing or incomplete."""
    now = bars.filter(F.col("slot") == slot).select("bar_interval", "symbol")
    return now.join(_ready_before(stored, slot), ["bar_interval", "symbol"], "left_anti")


def symbols_to_step(bars: DataFrame, stored: DataFrame, slot: int | Column) -> DataFrame:
    """Series with a bar at ``slot`` and a complete stored row one slot earlier."""
    now = bars.filter(F.col("slot") == slot).select("bar_interval", "symbol")
    return now.intersect(_ready_before(stored, slot))


def _ready_before(stored: DataFrame, slot: int | Column) -> DataFrame:
    return stored.filter((F.col("slot") == slot - 1) & is_ready()).select("bar_interval", "symbol")


def _smooth(name: str) -> Column:
    source, n = SOURCES[name]
    return (F.col(f"old_{name}") * (n - 1) + F.col(source)) / n


def step_once(bars: DataFrame, stored: DataFrame, slot: int | Column) -> DataFrame:
    """Signal columns of the bars at ``slot`` stepped from the stored rows of the slot before.

    Only the 28 slots in reach are read. A series without a stored row in the slot before yields nothing.
    """
    reach = bars.filter((F.col("slot") > slot - LOOKBACK_BARS) & (F.col("slot") <= slot))
    now = with_extremes(reach).drop("ep15_h", "ep15_l").filter(F.col("slot") == slot)
    before = stored.filter(F.col("slot") == slot - 1).select(
        "bar_interval", "symbol", F.col("high").alias("ph"), F.col("low").alias("pl"), F.col("close").alias("pc"),
        F.col("dm14_p").alias("pdm14_p"), F.col("dm14_n").alias("pdm14_n"),
        *[F.col(name).alias(f"old_{name}") for name in (*SMOOTHED, "adx", "af", "psar_type", "ep", "psar")],
    )
    rows = with_moves(now.join(before, ["bar_interval", "symbol"]))
    rows = rows.withColumns({name: _smooth(name) for name in SMOOTHED})
    rows = with_line_cross(with_rsi(with_direction(rows)))
    rows = rows.withColumn("adx", (F.col("dx14") + F.col("old_adx") * (LONG - 1)) / LONG)
    rows = step_stop(rows)
    return rows.drop("pdm14_p", "pdm14_n", *[name for name in rows.columns if name.startswith("old_")])


def step_stop(rows: DataFrame) -> DataFrame:
    """Parabolic stop of the next bar; it turns when its candidate touches the bar."""
    rising, high, low = F.col("old_psar_type") == "UP", F.col("high"), F.col("low")
    rows = rows.withColumns(
        {
            "reach_ep": F.when(rising, greatest_or_null(F.col("old_ep"), high)).otherwise(
                least_or_null(F.col("old_ep"), low)
            ),
            "steps": F.least(F.round(F.col("old_af") * 50).cast("int") + 1, F.lit(AF_MAX_STEPS)),
        }
    )
    ep, margin = F.col("reach_ep"), F.col("tr") * 0.1
    rows = rows.withColumn(
        "candidate", F.col("old_psar") + F.col("steps").cast("double") / 50 * (ep - F.col("old_psar"))
    )
    rows = rows.withColumns(
        {
            "turn": F.coalesce(F.when(rising, F.col("candidate") >= low).otherwise(F.col("candidate") <= high), F.lit(False)),
            "turn_ep": F.when(rising, least_or_null(ep, low)).otherwise(greatest_or_null(ep, high)),
            "turn_stop": F.when(rising, greatest_or_null(ep, high + margin)).otherwise(least_or_null(ep, low - margin)),
        }
    )
    turn = F.col("turn")
    return rows.withColumns(
        {
            "af": safe_div(F.when(turn, 1).otherwise(F.col("steps")), F.lit(50)).cast("decimal(3,2)"),
            "ep": F.when(turn, F.col("turn_ep")).otherwise(ep),
            "psar_type": F.when(turn == rising, "DOWN").otherwise("UP"),
            "psar": F.when(turn, F.col("turn_stop") + (F.col("turn_ep") - F.col("turn_stop")) * AF_STEP).otherwise(
                F.col("candidate")
            ),
        }
    ).drop("reach_ep", "steps", "candidate", "turn", "turn_ep", "turn_stop")
