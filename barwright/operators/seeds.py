"""Seed rows: indicators from plain means over the 28 slots before a bar, and nothing older."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LOOKBACK_BARS
from .blocks import BLOCK_KEY, BLOCK_SLOTS, split_blocks
from .indicators import SERIES, seed_signals

# What the seed windows read of a bar in reach.
READ = ("slot", "high", "low", "close")


def seed_at(bars: DataFrame, targets: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Exact seed rows at ``targets`` (series keys and ``slot``).

    A target reaches back 28 slots, so it is spread over those slots and equi-joined with the bars; the windows
    then run per target over at most 28 rows, however long or sparse the series is.
    """
    reach = targets.select(
        *keys,
        F.col("slot").alias("target_slot"),
        F.explode(F.sequence(F.col("slot") - (LOOKBACK_BARS - 1), F.col("slot"))).alias("slot"),
    )
    rows = bars.join(reach, [*keys, "slot"])
    seeded = seed_signals(rows, [*keys, "target_slot"])
    return seeded.filter(F.col("slot") == F.col("target_slot")).drop("target_slot")


def seed_latest(bars: DataFrame) -> DataFrame:
    """Seed row of the newest bar of every series."""
    newest = bars.groupBy(*SERIES).agg(F.max("slot").alias("slot"))
    return seed_at(bars, newest)


def seed_all(bars: DataFrame, block: int = BLOCK_SLOTS) -> DataFrame:
    """Exact seed row of every bar.

    Where the 28 slots of a bar are complete, or nothing is older than they are, trailing windows over its block see
    the same rows as its own look-back would. A bar behind a gap gets its look-back as a list, from a frame of the same
    windows, and unfolds it where it lies (the other bars unfold to themselves): a second round of windows runs per bar
    inside the partitions of the block, so the bars are computed and shuffled once.
    """
    rows = split_blocks(bars.withColumn("fresh", F.lit(True)), block, LOOKBACK_BARS)
    order = Window.partitionBy(*BLOCK_KEY).orderBy("slot")
    reach = order.rangeBetween(-(LOOKBACK_BARS - 1), 0)
    found = F.count(F.lit(1)).over(reach)
    rows = rows.withColumns(
        {
            "plain": (found == LOOKBACK_BARS) | (found == F.row_number().over(order)),
            "reach": F.collect_list(F.struct(*READ)).over(reach),
        }
    )
    rolled = seed_signals(rows, BLOCK_KEY).filter("own")
    seeds = [name for name in rolled.columns if name not in rows.columns]
    unfolded = rolled.select(
        *[name for name in bars.columns if name not in READ],
        "block",
        "plain",
        F.col("slot").alias("target_slot"),
        *[F.col(name).alias(f"rolled_{name}") for name in seeds],
        F.inline(F.when(F.col("plain"), F.array(F.struct(*READ))).otherwise(F.col("reach"))),
    )
    seeded = seed_signals(unfolded, [*BLOCK_KEY, "target_slot"]).filter("slot = target_slot")
    chosen = [F.when(F.col("plain"), F.col(f"rolled_{name}")).otherwise(F.col(name)).alias(name) for name in seeds]
    return seeded.select(*bars.columns, *chosen)
