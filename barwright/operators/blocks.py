"""Time blocks: a series cut into runs of bar slots, so that one symbol spreads over many tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timegrid import int_div
from ..schemas import LOOKBACK_BARS

BLOCK_SLOTS = 16384
WARMUP_SLOTS = 1152
BLOCK_KEY = ["bar_interval", "symbol", "block"]


def split_blocks(bars: DataFrame, block: int, warmup: int) -> DataFrame:
    """Rows of each block plus copies of the last ``warmup`` slots before it (``own`` is false on copies)."""
    home = int_div(F.col("slot"), F.lit(block))
    near_end = F.col("slot") % block >= block - warmup
    blocks = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    return (
        bars.withColumn("block", F.explode(blocks))
        .withColumn("own", (home == F.col("block")) & F.col("fresh"))
        .drop("fresh")
    )


def over_blocks(
    bars: DataFrame, columns: Callable[[DataFrame, Sequence[str]], DataFrame], block: int = BLOCK_SLOTS
) -> DataFrame:
    """Window columns that reach back 28 slots at most, computed per block instead of per series."""
    rows = split_blocks(bars.withColumn("fresh", F.lit(True)), block, LOOKBACK_BARS)
    return columns(rows, BLOCK_KEY).filter("own").drop("own", "block")
