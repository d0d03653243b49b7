"""Recursive indicator state over whole series, split into time blocks.

A series is cut into blocks of ``block`` bar slots, so one symbol spreads over many tasks and a task never holds
more than one block. Each block also gets copies of the bars just before it (its *warm-up*). Windows reach back 28
slots and are exact on a block. The recursion starts speculatively at the warm-up: smoothed values forget their
start (27/28 per bar at the slowest) and the parabolic stop falls in step after a few common turns. Nothing is taken
on trust: the state every block assumed at its edge is compared with the state its predecessor reached there, and a
block that assumed wrong is run again from the true state until all edges agree. The first wrong block of a series
always gets a true state, so the loop ends, and normally there is nothing to repeat. The warm-up makes the averages exact to
rounding, so in practice a wrong edge is one of the stop.

A repair writes the blocks it runs again, and nothing else: a pass is a table of its own, a block counts in the last pass that has
it, and edges are compared in small tables of two rows a block.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import safe_div
from ..functions.timegrid import int_div
from ..schemas import LOOKBACK_BARS, SIGNALS, VALUE_COLUMNS
from ..session import materialize
from . import recursion
from .blocks import BLOCK_KEY, BLOCK_SLOTS, WARMUP_SLOTS, split_blocks
from .groups import whole_groups
from .indicators import with_direction, with_extremes, with_line_cross, with_moves, with_previous, with_rsi, with_slot
from .recursion import INPUTS, RESULTS, STATE, apart, run_series

# Tasks get these two modules by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(recursion)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Edge states agree if they differ by less than this, relative to their size: rounding noise of the smoothing.
TOLERANCE = 1e-12
MOST_PASSES = 8

# Columns that travel through the tasks; moves and derived values are cheaper to compute again than to ship.
PASSED = [
    "bar_interval", "symbol", "bar_start", "open_time", *VALUE_COLUMNS, "slot", "ph", "pl", "pc",
    "ep14_h", "ep14_l", "ep15_h", "ep15_l", "ep28_h", "ep28_l",
]
# State a run continues from, on the bar it belongs to.
CARRY = T.StructType([T.StructField(name, T.DoubleType()) for name in STATE])


def no_carry() -> Column:
    return F.lit(None).cast(CARRY)


def carry_of(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{name}").cast("double").alias(name) for name in STATE])


def window_inputs(bars: DataFrame, block: int, warmup: int) -> DataFrame:
    """Per-block rows with every column that does not depend on the recursion; one exchange, one sort."""
    rows = with_previous(split_blocks(bars, block, warmup), BLOCK_KEY)
    return with_extremes(rows.drop("stored_high", "stored_low", "stored_close"), BLOCK_KEY)


def _result_schema(rows: DataFrame) -> T.StructType:
    passed = [rows.schema[name] for name in [*PASSED, "block", "own"]]
    return T.StructType(passed + [T.StructField(name, T.DoubleType()) for name in RESULTS])


def _run_groups(table: pa.Table, block: int, reseed: bool) -> pa.Table:
    """Results of whole block groups laid end to end, and only the rows to keep."""
    names = [*PASSED, "block", "own"]
    slots = table.column("slot").to_numpy()
    own = table.column("own").to_numpy()
    # nulls arrive as NaN
    cols = {name: np.asarray(table.column(name).to_numpy(), dtype=float) for name in INPUTS}
    carry = table.column("carry").combine_chunks()
    given = {}
    for at in np.flatnonzero(carry.is_valid().to_numpy(zero_copy_only=False)).tolist():
        values = carry[at].as_py()
        given[at] = tuple(np.nan if values[name] is None else values[name] for name in STATE)
    starts = table.column("starts").to_numpy()
    results = run_series(apart(slots, starts), cols, given, reseed)
    # edge rows tell which state a block with rows of its own started from
    group = np.cumsum(starts) - 1
    live = np.bincount(group, weights=own) > 0
    home = slots // block == table.column("block").to_numpy()
    edge = ~home & (slots == table.column("block").to_numpy() * block - 1) & live[group]
    # bars given as context stay beside their block: a later block may have to look back on them
    keep = edge | (home & ~own) | (own if reseed else own & ~np.isnan(results[:, -1]))
    table = table.select(names)
    if not keep.all():
        table, results = table.filter(pa.array(keep)), results[keep]
    computed = [pa.array(results[:, at], from_pandas=True) for at in range(len(RESULTS))]
    return pa.Table.from_arrays([*table.columns, *computed], names=[*names, *RESULTS])


def _group_stream(block: int, reseed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            yield from _run_groups(table, block, reseed).to_batches()

    return run


def _run_blocks(rows: DataFrame, block: int, reseed: bool) -> DataFrame:
    """State of the rows of each block. The window for ``starts`` demands whole, sorted blocks in one partition, which
    the stream then relies on; its exchange and sort are those of the windows before it."""
    order = Window.partitionBy(*BLOCK_KEY).orderBy("slot")
    ready = rows.withColumn("starts", F.lag("slot").over(order).isNull()).select(
        *PASSED, "block", "own", "carry", "starts"
    )
    return ready.sortWithinPartitions(*BLOCK_KEY, "slot").mapInArrow(_group_stream(block, reseed), _result_schema(rows))


def _differs(a: str, b: str, name: str) -> Column:
    left, right = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
    far = F.abs(left - right) > F.greatest(F.abs(left), F.abs(right)) * TOLERANCE
    return (left.isNull() != right.isNull()) | F.coalesce(far, F.lit(False))


def _edges(done: DataFrame, block: int, number: int) -> DataFrame:
    """The states at block edges that a pass has computed: what each block assumed and what it reached."""
    home = int_div(F.col("slot"), F.lit(block)) == F.col("block")
    ends = done.filter(~home | (F.col("own") & (F.col("slot") % block == block - 1)))
    return ends.select(
        *BLOCK_KEY, "slot", home.alias("reached"), F.lit(number).alias("number"), *STATE
    )


def _wrong_edges(edges: DataFrame, block: int) -> DataFrame:
    """True carry rows for the blocks whose assumed edge state is not the one their predecessor reached."""
    key = [*BLOCK_KEY, "slot", "reached"]
    latest = edges.groupBy(*key).agg(F.max("number").alias("number"))
    edges = edges.join(latest, [*key, "number"])
    columns = [*BLOCK_KEY, "slot", *STATE]
    pairs = edges.filter(~F.col("reached")).select(*columns).alias("assumed").join(
        edges.filter("reached").select(*columns).alias("reached"), ["bar_interval", "symbol", "slot"]
    )
    differs = _differs("assumed", "reached", STATE[0])
    for name in STATE[1:]:
        differs = differs | _differs("assumed", "reached", name)
    return pairs.filter(differs).select(
        "bar_interval", "symbol", F.col("assumed.block").alias("block"), "slot", carry_of("reached.").alias("carry")
    )


def _latest(passes: list[DataFrame], redone: list[DataFrame]) -> DataFrame:
    """The rows that count, of all passes. redone: the keys of the blocks of each pass after the first."""
    out = None
    for at, rows in enumerate(passes):
        for keys in redone[at:]:
            rows = rows.join(keys, BLOCK_KEY, "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return out


def _inputs_of(done: DataFrame, wrong: DataFrame, block: int) -> DataFrame:
    """Rows to run blocks again: their own, the 28 slots before them, and the true state at their edge."""
    home = int_div(F.col("slot"), F.lit(block)) == F.col("block")
    needed = wrong.select("bar_interval", "symbol", F.explode(F.array(F.col("block") - 1, F.col("block"))).alias("block")).distinct()
    rows = done.filter(home).join(needed, BLOCK_KEY, "left_semi").select(*PASSED, F.col("own").alias("fresh"))
    again = split_blocks(rows, block, LOOKBACK_BARS).join(wrong.select(*BLOCK_KEY), BLOCK_KEY, "left_semi")
    return again.join(wrong, [*BLOCK_KEY, "slot"], "left")


def fold_blocks(
    bars: DataFrame,
    reseed: bool = True,
    block: int = BLOCK_SLOTS,
    warmup: int = WARMUP_SLOTS,
) -> DataFrame:
    """State of every fresh bar.

    ``bars`` has ``slot``, ``fresh`` (false on bars given as context only) and ``carry`` (the state of the bar, where it is
    known from an earlier run, else NULL).
    """
    if not LOOKBACK_BARS <= warmup <= block:
        raise ValueError(f"warm-up must be between {LOOKBACK_BARS} and the block length")
    passes = [materialize(_run_blocks(window_inputs(bars, block, warmup), block, reseed), "fold")]
    edges, redone = _edges(passes[0], block, 0), []
    if edges.filter("not reached").isEmpty():  # no series is longer than a block
        return passes[0].filter("own")
    edges = materialize(edges, "edges")
    while True:
        wrong = materialize(_wrong_edges(edges, block), "wrong-edges")
        if wrong.isEmpty():
            return _latest(passes, redone).filter("own")
        if len(passes) > MOST_PASSES:  # one table again, so that the plan does not grow with the passes
            passes, redone = [materialize(_latest(passes, redone), "fold")], []
        again = _inputs_of(_latest(passes, redone), wrong, block)
        passes.append(materialize(_run_blocks(again, block, reseed), "fold-again"))
        redone.append(wrong.select(*BLOCK_KEY))
        numbers = int(edges.agg(F.max("number")).first()[0])
        edges = materialize(edges.unionByName(_edges(passes[-1], block, numbers + 1)), "edges")


def finish_signals(state: DataFrame, update_time: Column | int) -> DataFrame:
    """Signal rows from bars and state: everything that is a plain expression of the smoothed values."""
    seeded = F.col("seeded") == 1
    rows = with_line_cross(with_rsi(with_direction(with_moves(state))))
    rows = rows.withColumns(
        {
            "ep14_h": F.when(seeded, F.col("ep15_h")).otherwise(F.col("ep14_h")),
            "ep14_l": F.when(seeded, F.col("ep15_l")).otherwise(F.col("ep14_l")),
            "af": safe_div(F.col("af_steps"), F.lit(50)).cast("decimal(3,2)"),
            "psar_type": F.when(F.col("rising") == 1, "UP").otherwise("DOWN"),
            "update_time": update_time if isinstance(update_time, Column) else F.lit(update_time),
            "psar_up": F.lit(None),
            "psar_down": F.lit(None),
        }
    )
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SIGNALS])


def compute_signals(
    bars: DataFrame,
    update_time: Column | int = 0,
    reseed: bool = True,
    block: int = BLOCK_SLOTS,
    warmup: int = WARMUP_SLOTS,
) -> DataFrame:
    """Signals of whole bar series from scratch."""
    fresh = with_slot(bars).withColumns({"fresh": F.lit(True), "carry": no_carry()})
    return finish_signals(fold_blocks(fresh, reseed, block, warmup), update_time)
