"""One-step ARIMA(1,2,1) forecast per symbol by conditional least squares.

With w the second difference of the close, residuals follow e[t] = w[t] - phi*w[t-1] - theta*e[t-1] and start at
zero. Filtering by theta alone gives a[t] = w[t] - theta*a[t-1], and e[t] = a[t] - phi*a[t-1]: for each theta the best
phi is a ratio of two sums, so only theta is searched, on a grid of 0.01 steps; of equal fits the theta nearest to zero
counts. The fit approximates the maximum likelihood estimate and is not equal to it. ``mse`` and ``mae`` are errors of
the residuals, each divided by the mean close as in the stored predictions; start-up observations have no residual.

A series is cut into time blocks. A filter run from zero over a block plus a known multiple of the unknown carry is
the true filter, so each block is summarised once (sums as polynomials of the carry) and the few summaries of a
symbol are chained exactly, however long the series is. A second pass yields the residuals with known carries.
A symbol whose rows lie in one block has no unknown carry: its task compares the thetas itself and hands on the best
one only, in place of a summary for each theta.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_div
from ..functions.timegrid import int_div
from ..schemas import FORECAST_LOOKBACK, PREDICTIONS
from ..session import materialize
from ..sources.candles import look_back
from . import recursion
from .groups import whole_groups
from .recursion import affine_scan

# Tasks get the block functions by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(recursion)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_SECONDS = 4096 * 3600
KEY = ["symbol", "block"]
GROUPS_AT_ONCE = 128
THETA_STEPS = 99  # theta = -0.99 .. 0.99
PHI_LIMIT = 0.99
MISFIT_DIGITS = 10
# two-sided 95 % point of the normal distribution
Z95 = 1.959963984540054

CARRY_TERMS = ("s0_0", "s0_1", "s0_2", "s1_0", "s1_1", "s1_2", "s2_0", "s2_1", "s2_2")
FILTER_TERMS = ("p_end", "q_end", "p_before", "q_before", *CARRY_TERMS, "power")
SUMMARY = "symbol string, block long, theta double, residuals long, " + ", ".join(f"{n} double" for n in FILTER_TERMS)
RESIDUALS = "symbol string, open_time long, residual double"


def _thetas() -> np.ndarray:
    return np.arange(-THETA_STEPS, THETA_STEPS + 1) / 100.0


def _filter_groups(diffs: np.ndarray, first: np.ndarray, length: np.ndarray, theta: np.ndarray) -> list[np.ndarray]:
    """Filter sums of several blocks and all thetas at once (arrays of block by theta, named by ``FILTER_TERMS``).

    From zero (p), and the multiple (q) of each block's unknown carry. Blocks come longest first, so that those still
    running are always the leading ones.
    """
    shape = len(first), len(theta)
    p, q, p_before, q_before = np.zeros(shape), np.ones(shape), np.zeros(shape), np.zeros(shape)
    sums = np.zeros((len(CARRY_TERMS), *shape))
    power = np.zeros(shape)
    for t in range(int(length[0])):
        live = slice(0, int(np.searchsorted(-length, -t)))
        diff = diffs[first[live] + t][:, None]
        a, b = p[live], q[live]
        new_p, new_q = diff - theta * a, -theta * b
        for total, term in zip(sums, (
            new_p * new_p, 2 * new_p * new_q, new_q * new_q,
            new_p * a, new_p * b + new_q * a, new_q * b,
            a * a, 2 * a * b, b * b,
        )):
            total[live] += term
        power[live] += diff * diff
        p_before[live], q_before[live] = a, b
        p[live], q[live] = new_p, new_q
    return [p, q, p_before, q_before, *sums, power]


def _may_be_best(theta: np.ndarray, s0: np.ndarray, s1: np.ndarray, s2: np.ndarray, power: np.ndarray) -> np.ndarray:
    """The best theta of whole series, from their sums by theta, under the rule of ``_chain``; more than one where a misfit
    lies so near the edge of its last digit that only one way of rounding may decide, which is ``_chain``'s."""
    phi = np.clip(np.divide(s1, s2, out=np.zeros(s1.shape), where=s2 != 0), -PHI_LIMIT, PHI_LIMIT)
    sse = s0 - 2 * phi * s1 + phi * phi * s2
    units = np.divide(sse, power, out=np.zeros(sse.shape), where=power != 0) * 10.0**MISFIT_DIGITS
    near = units <= units.min(axis=1, keepdims=True) + 2
    on_edge = (near & (np.abs(units - np.floor(units) - 0.5) < 0.001)).any(axis=1)
    whole = np.floor(units + 0.5)
    by_preference = np.lexsort((theta, np.abs(theta)))
    first = by_preference[np.argmax((whole == whole.min(axis=1, keepdims=True))[:, by_preference], axis=1)]
    return np.where(on_edge[:, None], near, np.arange(len(theta)) == first[:, None])


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block and theta from differences sorted by block and time; of a symbol's only block the best."""
    theta = _thetas()
    for table in whole_groups(batches):
        starts = np.flatnonzero(table.column("starts").to_numpy())
        diffs = np.asarray(table.column("diff").to_numpy(), dtype=float)
        known = np.concatenate([[0], np.cumsum(~np.isnan(diffs))])
        ends = np.append(starts[1:], len(diffs))
        # differences are only missing on the first rows of a series
        length = known[ends] - known[starts]
        alone = table.column("alone").to_numpy()[starts]
        order = np.argsort(-length, kind="stable")
        for part in range(0, len(order), GROUPS_AT_ONCE):
            chosen = order[part : part + GROUPS_AT_ONCE]
            terms = _filter_groups(diffs, ends[chosen] - length[chosen], length[chosen], theta)
            named = dict(zip(FILTER_TERMS, terms))
            best = _may_be_best(theta, *[named[f"s{i}_0"] for i in range(3)], named["power"])
            block, lane = np.nonzero(best | ~alone[chosen][:, None])
            rows = pa.array(starts[chosen][block])
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("symbol").combine_chunks().take(rows),
                    table.column("block").combine_chunks().take(rows),
                    pa.array(theta[lane]),
                    pa.array(length[chosen][block]),
                    *[pa.array(term[block, lane]) for term in terms],
                ],
                names=["symbol", "block", "theta", "residuals", *FILTER_TERMS],
            )


def _residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Residual of every difference, given the fit of the symbol and the carry of its block."""
    for table in whole_groups(batches):
        group = np.cumsum(table.column("starts").to_numpy()) - 1
        diff, theta, phi, carry = [
            np.asarray(table.column(name).to_numpy(), dtype=float) for name in ("diff", "theta", "phi", "carry")
        ]
        known = np.flatnonzero(~np.isnan(diff))
        filtered, before = np.empty(len(diff)), np.empty(len(diff))
        first = np.diff(group[known], prepend=-1) > 0
        add = diff[known] - np.where(first, theta[known] * carry[known], 0.0)
        # blocks that share a theta are one scan
        order = np.argsort(theta[known], kind="stable")
        for lane in np.split(order, np.flatnonzero(np.diff(theta[known][order])) + 1) if len(known) else []:
            keep = np.array([-theta[known[lane[0]]]])
            filtered[known[lane]] = affine_scan(keep, add[lane][:, None], first[lane])[:, 0]
        before[known] = np.where(first, carry[known], filtered[np.concatenate([known[:1], known[:-1]])])
        errors = np.full(len(diff), np.nan)
        errors[known] = filtered[known] - phi[known] * before[known]
        done = table.select(["symbol", "open_time"]).append_column("residual", pa.array(errors, from_pandas=True))
        yield from done.to_batches()


def with_differences(rows: DataFrame) -> DataFrame:
    """Previous close and second difference of every row, by windows over blocks only.

    The two closes before a block come from the last two rows of the blocks before it, so no window spans a series.
    """
    order = Window.partitionBy(*KEY).orderBy("open_time")
    placed = rows.withColumns(
        {
            "place": F.row_number().over(order),
            "lag_1": F.lag("close", 1).over(order),
            "lag_2": F.lag("close", 2).over(order),
        }
    ).join(_block_context(rows), KEY)
    first, second = F.col("place") == 1, F.col("place") == 2
    before = F.when(first, F.col("close_1")).otherwise(F.col("lag_1"))
    older = F.when(first, F.col("close_2")).when(second, F.col("close_1")).otherwise(F.col("lag_2"))
    return placed.select(
        *KEY, "alone", "open_time", "close", before.alias("before"),
        (F.col("close") - before * 2 + older).alias("diff"),
    )


def _sorted_blocks(rows: DataFrame) -> DataFrame:
    """Rows by block and time; the window for ``starts`` demands whole blocks in one partition."""
    order = Window.partitionBy(*KEY).orderBy("open_time")
    return rows.withColumn("starts", F.lag("open_time").over(order).isNull()).sortWithinPartitions(*KEY, "open_time")


def _block_context(rows: DataFrame) -> DataFrame:
    """Per block, the last two closes before it: from each block's own last two rows, never from whole series. ``alone``
    tells that the symbol has no other block."""
    order = Window.partitionBy("symbol", "block").orderBy(F.col("open_time").desc())
    tails = rows.withColumn("at", F.row_number().over(order)).filter("at <= 2")
    series = Window.partitionBy("symbol").orderBy("open_time")
    blocks = Window.partitionBy("symbol")
    lagged = tails.select(
        "symbol",
        "block",
        (F.min("block").over(blocks) == F.max("block").over(blocks)).alias("alone"),
        F.lag("block").over(series).alias("block_before"),
        F.lag("close", 1).over(series).alias("close_1"),
        F.lag("close", 2).over(series).alias("close_2"),
    )
    first = F.col("block_before").isNull() | (F.col("block_before") != F.col("block"))
    return lagged.filter(first).drop("block_before")


def _summaries(series: DataFrame) -> DataFrame:
    return _sorted_blocks(series.select(*KEY, "alone", "open_time", "diff")).mapInArrow(_summarise, SUMMARY)


def _chain(summaries: DataFrame) -> DataFrame:
    """Sums and filter states over all blocks of a symbol, per theta; the blocks' carries are kept.

    ``misfit`` is the squared error relative to the differences themselves, to ten digits: thetas that fit equally well
    (short or straight series) tie instead of differing by rounding noise.
    """
    blocks = F.array_sort(F.collect_list(F.struct("block", "residuals", *FILTER_TERMS)))
    grouped = summaries.groupBy("symbol", "theta").agg(blocks.alias("blocks"))

    def polynomial(b, name, c):
        return b[f"{name}_0"] + b[f"{name}_1"] * c + b[f"{name}_2"] * c * c

    def advance(acc, b):
        c = acc["a"]
        has = b["residuals"] > 0
        return F.struct(
            F.when(has, b["p_end"] + b["q_end"] * c).otherwise(c).alias("a"),
            F.when(has, b["p_before"] + b["q_before"] * c).otherwise(acc["a_before"]).alias("a_before"),
            (acc["power"] + b["power"]).alias("power"),
            *[(acc[name] + polynomial(b, name, c)).alias(name) for name in ("s0", "s1", "s2")],
            F.concat(acc["carries"], F.array(F.struct(b["block"].alias("block"), c.alias("carry")))).alias("carries"),
        )

    zero = F.lit(0.0)
    start = F.struct(
        zero.alias("a"), zero.alias("a_before"), zero.alias("power"),
        zero.alias("s0"), zero.alias("s1"), zero.alias("s2"),
        F.array().cast("array<struct<block:bigint,carry:double>>").alias("carries"),
    )
    chained = grouped.select("symbol", "theta", F.aggregate("blocks", start, advance).alias("f")).select(
        "symbol", "theta", "f.*"
    )
    phi = F.greatest(F.least(F.coalesce(safe_div(F.col("s1"), F.col("s2")), zero), F.lit(PHI_LIMIT)), F.lit(-PHI_LIMIT))
    chained = chained.withColumn("phi", phi)
    sse = F.col("s0") - F.col("phi") * F.col("s1") * 2 + F.col("phi") * F.col("phi") * F.col("s2")
    return chained.withColumn("misfit", F.round(F.coalesce(safe_div(sse, F.col("power")), zero), MISFIT_DIGITS))


def fit_symbols(prices: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Fit, forecast and errors per symbol over the given price rows (symbol, open_time, close).

    A symbol with fewer than three rows has no second difference and yields NULLs beside its last price.
    """
    rows = prices.select(
        "symbol", F.col("open_time").cast("long").alias("open_time"), F.col("close").cast("double").alias("close"),
        int_div(F.col("open_time"), F.lit(block_seconds)).alias("block"),
    ).filter(F.col("close").isNotNull())
    series = materialize(with_differences(rows), "series")
    chosen = F.min_by(F.struct("theta", "phi", "a", "a_before", "carries"), F.struct("misfit", F.abs("theta"), "theta"))
    best = _chain(_summaries(series)).groupBy("symbol").agg(chosen.alias("b")).select("symbol", "b.*")
    carries = best.select("symbol", "theta", "phi", F.inline("carries"))
    errors = (
        _sorted_blocks(series.select(*KEY, "open_time", "diff").join(carries, KEY))
        .mapInArrow(_residuals, RESIDUALS)
        .groupBy("symbol")
        .agg(
            F.count("residual").alias("n"),
            F.sum(F.col("residual") * F.col("residual")).alias("sse"),
            F.sum(F.abs("residual")).alias("abs_sum"),
        )
    )
    last = series.groupBy("symbol").agg(
        F.avg("close").alias("mean_close"),
        F.max("open_time").alias("open_time"),
        *[F.max_by(name, "open_time").alias(name) for name in ("close", "before", "diff")],
    )
    fit = last.join(best.drop("carries"), "symbol").join(errors, "symbol")
    residual = F.col("a") - F.col("phi") * F.col("a_before")
    ahead = F.col("phi") * F.col("diff") + F.col("theta") * residual
    mean_square = safe_div(F.col("sse"), F.col("n"))
    next_pred, spread = F.col("close") * 2 - F.col("before") + ahead, F.sqrt(mean_square) * Z95
    return fit.select(
        "symbol",
        "open_time",
        next_pred.alias("next_pred"),
        F.col("close").alias("last_price"),
        (next_pred - spread).alias("lower"),
        (next_pred + spread).alias("upper"),
        safe_div(mean_square, F.col("mean_close")).alias("mse"),
        safe_div(safe_div(F.col("abs_sum"), F.col("n")), F.col("mean_close")).alias("mae"),
        "phi",
        "theta",
    )


def forecast_next(prices: DataFrame, as_of=None, seconds: int | None = FORECAST_LOOKBACK) -> DataFrame:
    """Prediction rows from the last 90 days of prices, or from the whole table if ``seconds`` is None."""
    if seconds is not None:
        prices = look_back(prices, as_of, seconds)
    return fit_symbols(prices).select(*PREDICTIONS.names)
