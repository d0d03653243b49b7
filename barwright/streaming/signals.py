"""Indicator state over a stream of closed bars: one small state per series, carried between micro-batches.

The state is what a step needs: the recursive values of the newest bar, and the high, low and close of the 28 slots in
reach, for extremes and for a new seed after a gap. Bars at or before the newest one are ignored. A stream can go on from
stored signal rows: their last 28 slots are its initial state.

A micro-batch hands over the rows of a series in no order. Up to ``HELD_ROWS`` of them are sorted as they are; beyond that they are put
down in the state store in pages by time range and taken up again range by range, so a task never holds more than a range of a
series, however much of it one micro-batch brings.
""" 
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.timegrid import int_div
from ..operators.fold import PASSED, finish_signals
from ..operators.recursion import RESULTS, STATE, run_series
from ..schemas import BAR_COLUMNS, BAR_SECONDS, LONG, LOOKBACK_BARS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD_ROWS = 16384
RANGE_SLOTS = 4096
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
PRICES = ("high", "low", "close")
_LONGS = ("bar_start", "open_time", "num_trades", "slot")
OUTPUT_SCHEMA = ", ".join(
    f"`{name}` " + ("string" if name in ("bar_interval", "symbol") else "long" if name in _LONGS else "double")
    for name in (*PASSED, *RESULTS)
)
BAR_NAMES = tuple(name for name in PASSED if name not in ("ph", "pl", "pc") and not name.startswith("ep"))
PAGE = ", ".join(
    f"`{name}`: " + ("string" if name in ("bar_interval", "symbol") else "long" if name in _LONGS else "double") for name in BAR_NAMES
)


def bounded_columns(slots: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> dict[str, np.ndarray]:
    """The non-recursive columns of a short run of bars: previous bar and trailing extremes."""
    at = np.arange(len(slots))
    before = np.where((at > 0) & (slots[at - 1] > slots - LOOKBACK_BARS), at - 1, at)
    cols = {"high": high, "low": low, "close": close, "ph": high[before], "pl": low[before], "pc": close[before]}
    oldest = np.searchsorted(slots, slots - (LOOKBACK_BARS - 1))
    for name, rows in (("ep14", LONG), ("ep15", LONG + 1), ("ep28", LOOKBACK_BARS)):
        starts = np.maximum(oldest, at - rows + 1)
        cols[f"{name}_h"] = np.array([np.fmax.reduce(high[a : b + 1]) for a, b in zip(starts, at)])
        cols[f"{name}_l"] = np.array([np.fmin.reduce(low[a : b + 1]) for a, b in zip(starts, at)])
    return cols


class SignalMachine(StatefulProcessor):
    """Bars of one series in, their states out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "slot long, high double, low double, close double")
        self.carry = handle.getValueState("carry", "state array<double>")
        self.pages = handle.getMapState("pages", "start long, number int", f"page array<struct<{PAGE}>>")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values("slot")
        self.tail.put([(int(r.slot), r.high, r.low, r.close) for r in rows.itertuples()])
        self.carry.update(([float(v) for v in rows.iloc[-1][list(STATE)]],))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        many = number = 0
        for frame in rows:
            held.append(frame)
            many += len(frame)
            if many > HELD_ROWS:
                number = self._put_down(pd.concat(held), number)
                held, many = [], 0
        if not number:
            yield from self._advance(pd.concat(held))
            return
        if held:
            self._put_down(pd.concat(held), number)
        places = sorted(self.pages.keys())
        for start in sorted({place[0] for place in places}):
            found = [self.pages.getValue(place)[0] for place in places if place[0] == start]
            whole = pd.DataFrame([tuple(r) for page in found for r in page], columns=BAR_NAMES)
            yield from self._advance(whole.astype({n: float for n in BAR_NAMES if n not in (*_LONGS, "bar_interval", "symbol")}))
        self.pages.clear()

    def _put_down(self, frame: pd.DataFrame, number: int) -> int:
        for start, part in frame.groupby(frame["slot"] // RANGE_SLOTS):
            values = part.astype(object).where(part.notna(), None)
            self.pages.updateValue((int(start), number), ([tuple(r) for r in values[list(BAR_NAMES)].itertuples(index=False)],))
            number += 1
        return number

    def _advance(self, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        old = sorted(self.tail.get()) if self.tail.exists() else []
        new = frame.drop_duplicates("slot").sort_values("slot")
        if old:
            new = new[new["slot"] > old[-1][0]]
        if new.empty:
            return
        known = len(old)
        slots = np.concatenate([np.array([r[0] for r in old], dtype=np.int64), new["slot"].to_numpy(dtype=np.int64)])
        prices = [
            np.concatenate([np.array([r[at] for r in old], dtype=float), new[name].to_numpy(dtype=float)])
            for at, name in enumerate(PRICES, 1)
        ]
        cols = bounded_columns(slots, *prices)
        given = {known - 1: tuple(np.nan if v is None else v for v in self.carry.get()[0])} if known else {}
        results = run_series(slots, cols, given)
        reach = slots > slots[-1] - LOOKBACK_BARS
        self.tail.put([(int(s), *map(float, row)) for s, *row in zip(slots[reach], *[p[reach] for p in prices])])
        self.carry.update(([float(v) for v in results[-1, : len(STATE)]],))
        out = new.reset_index(drop=True)
        for name in PASSED:
            if name not in out.columns:
                out[name] = cols[name][known:]
        for at, name in enumerate(RESULTS):
            out[name] = results[known:, at]
        yield out[[*PASSED, *RESULTS]]

    def close(self) -> None:
        pass


def with_slots(rows: DataFrame) -> DataFrame:
    lengths = F.create_map(*[F.lit(part) for item in BAR_SECONDS.items() for part in item])
    return rows.withColumn("slot", int_div(F.col("bar_start"), lengths[F.col("bar_interval")]).cast("long"))


def initial_state(stored: DataFrame) -> DataFrame:
    """What a stream needs to go on from stored signal rows: the 28 slots up to the newest row of each series."""
    rows = with_slots(stored).withColumns({
        "af_steps": F.round(F.col("af").cast("double") * 50), "rising": F.when(F.col("psar_type") == "UP", 1.0).otherwise(0.0),
    })
    newest = rows.groupBy("bar_interval", "symbol").agg(F.max("slot").alias("newest"))
    reach = rows.join(newest, ["bar_interval", "symbol"]).filter(F.col("slot") > F.col("newest") - LOOKBACK_BARS)
    return reach.select("bar_interval", "symbol", "slot", *PRICES, *[F.col(name).cast("double").alias(name) for name in STATE])


def stream_signals(bars: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Streaming signal rows from a stream of closed bars, going on from ``stored`` rows where there are any.

    The state lies in RocksDB, which the session's state store provider has to be when the query starts (``STORE``, ``ROCKS``).
    """
    rows = with_slots(bars.select(*BAR_COLUMNS)).select(*BAR_NAMES)
    start = None if stored is None else initial_state(stored).groupBy("bar_interval", "symbol")
    stepped = rows.groupBy("bar_interval", "symbol").transformWithStateInPandas(
        SignalMachine(), OUTPUT_SCHEMA, "Append", "None", initialState=start
    )
    # pandas has no NULL for doubles: what is not a number is unknown
    doubles = [f.name for f in stepped.schema if f.dataType.typeName() == "double"]
    known = stepped.withColumns({name: F.when(~F.isnan(name), F.col(name)) for name in doubles})
    return finish_signals(known, 0)
