"""Whitening of embeddings along their leading principal directions.

Entries become whole numbers (``SCALE`` steps to one), and each distinct vector of them counts once in the fit. Tasks reduce the centred
rows block by block: a block's R factor stands for its scatter, and two factors with their exact sums become one by a QR of both
and of the step between their means. No product of rows is ever formed, so small variances keep their digits. The factors of all
tasks are joined in a tree, a few to a group. The last one is reduced to bidiagonal form by reflections, its singular values come from
differential quotient-difference steps and the directions from twisted factorisations (``bidiagonal``).

A row's components are then expressions over its own entries. The directions are a few numbers for each entry of a vector; they are
broadcast in rounds of ``BROADCAST_BYTES`` at most, one round unless vectors come in very many lengths.

Defined cases
- Vectors that are null or hold a null or a non-finite entry have no row; nor have those with an entry of ``LARGEST`` steps or more
  either way, which doubles cannot count.
- Vectors of different lengths are fitted apart, each length with its own directions. Empty vectors have no components and no row.
- Directions without variance (to working precision) have no component, so equal vectors only, or a single one, give no row.
- Where variances are equal, any orthonormal directions of their space may come out.
- ``deviation`` is null where the exact sum does not fit a long.
- Repeated rows, and rows with a null or repeated id, come out like any others. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.timegrid import int_div
from barwright.llm.bidiagonal import leading
from barwright.llm.common import bind, column
from barwright.session import materialize

SCALE = 256
COMPONENTS = 4
LARGEST = 1 << 53
JOINED = 8
HELD_BYTES = 64 << 20
BROADCAST_BYTES = 32 << 20
FACTOR = "dim int, part long, n long, most long, sums array<decimal(38,0)>, factor array<double>"
MODEL = (
    "dim int, n long, sums array<decimal(38,0)>, whole array<long>, rest array<double>, fits boolean, "
    "variances array<double>, total double, directions array<array<double>>"
)


class Scatter:
    """What a set of rows adds to the fit: how many, their exact sums, and the R factor of the centred rows."""

    def __init__(self, n: int, most: int, sums: list[int], factor: np.ndarray):
        self.n, self.most, self.sums, self.factor = n, most, sums, factor

    @staticmethod
    def of(rows: np.ndarray) -> Scatter:
        most = max(int(rows.max()), -int(rows.min()))
        exact = rows if most * len(rows) < 1 << 62 else rows.astype(object)
        sums = [int(s) for s in exact.sum(axis=0)]
        whole, rest = centre(sums, len(rows))
        centred = (rows - whole).astype(float) - rest
        return Scatter(len(rows), most, sums, square(np.linalg.qr(centred, mode="r")))

    def join(self, other: Scatter) -> Scatter:
        n = self.n + other.n
        # the step between the means from whole numbers, so that it is exact however far off 0 the rows lie
        step = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        step *= math.sqrt(self.n * other.n / n)
        stacked = np.vstack([self.factor, other.factor, step[None]])
        sums = [a + b for a, b in zip(self.sums, other.sums)]
        return Scatter(n, max(self.most, other.most), sums, square(np.linalg.qr(stacked, mode="r")))


def square(factor: np.ndarray) -> np.ndarray:
    return np.vstack([factor, np.zeros((factor.shape[1] - len(factor), factor.shape[1]))])


def centre(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean as its floor and the rest."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def factor_rows(held: dict[int, Scatter], part: int) -> Iterator[pa.RecordBatch]:
    for dim, s in held.items():
        frame = pd.DataFrame({
            "dim": [dim], "part": [part], "n": [s.n], "most": [s.most], "sums": [[Decimal(v) for v in s.sums]],
            "factor": [s.factor.ravel()],
        })
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_pandas(frame, pa.schema(list(zip(frame.columns, types))), preserve_index=False)


def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One factor a task and length; more if there are so many lengths that their factors fill ``HELD_BYTES``."""
    held: dict[int, Scatter] = {}
    # parts are numbered without gaps by task; what a task gives out early has numbers of its own
    filled, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        lists = batch.column(0)
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes[sizes > 0]).tolist():
            rows = flat[starts[sizes == dim][:, None] + np.arange(dim)]
            for at in range(0, len(rows), max(4 * dim, 1024)):
                new = Scatter.of(rows[at : at + max(4 * dim, 1024)])
                if dim in held:
                    held[dim] = held[dim].join(new)
                else:
                    held[dim], filled = new, filled + 8 * dim * dim
            if filled > HELD_BYTES:
                yield from factor_rows(held, part)
                part, held, filled = part + (1 << 20), {}, 0
    yield from factor_rows(held, part)


def scatter_of(frame: pd.DataFrame) -> Scatter:
    joined = None
    for row in frame.sort_values("part").itertuples():
        dim = len(row.sums)
        one = Scatter(int(row.n), int(row.most), [int(v) for v in row.sums], np.asarray(row.factor, float).reshape(dim, dim))
        joined = one if joined is None else joined.join(one)
    return joined


def join_factors(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    s = scatter_of(frame)
    return pd.DataFrame({
        "dim": [key[0]], "part": [key[1]], "n": [s.n], "most": [s.most], "sums": [[Decimal(v) for v in s.sums]],
        "factor": [s.factor.ravel()],
    })


def solver(most: int):
    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        s = scatter_of(frame)
        values, vectors, total = leading(s.factor, most)
        whole, rest = centre(s.sums, s.n)
        return pd.DataFrame({
            "dim": [key[0]], "n": [s.n], "sums": [[Decimal(v) for v in s.sums]], "whole": [whole], "rest": [rest],
            "fits": [len(s.sums) * (2 * s.n * s.most) ** 2 < 1 << 62], "variances": [values / s.n], "total": [total / s.n],
            "directions": [list(vectors)],
        })

    return solve


def steps(vector: Column) -> Column:
    """Entries as whole numbers of steps, long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def countable(vector: Column) -> Column:
    # NaN is larger than any number, so one comparison leaves out all that cannot be counted
    return F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < LARGEST))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Written model rows, one a length, of ``vectors`` (a written table of distinct ``x``)."""
    factors = materialize(vectors.mapInArrow(reduce_rows, FACTOR), "factors")
    most = factors.agg(F.max("part")).first()[0]
    while most is not None and most >= JOINED:
        groups = factors.groupBy("dim", int_div(F.col("part"), F.lit(JOINED)).alias("part"))
        factors = materialize(groups.applyInPandas(join_factors, FACTOR), "factors")
        most //= JOINED
    return materialize(factors.groupBy("dim").applyInPandas(solver(components), MODEL), "directions")


def whitened(x: Column) -> Column:
    """The components of ``x`` by the model columns beside it."""
    centred = F.zip_with(F.zip_with(x, F.col("whole"), lambda a, b: (a - b).cast("double")), F.col("rest"), lambda a, b: a - b)

    def projected(row: Column) -> Column:
        def along(direction: Column, at: Column) -> Column:
            products = F.zip_with(row, direction, lambda a, b: a * b)
            return F.aggregate(products, F.lit(0.0), lambda t, p: t + p) / F.sqrt(F.get("variances", at))

        return F.transform("directions", along)

    return bind(centred, projected)


def deviation(x: Column) -> Column:
    """Exact sum of squares of ``n x - sums``."""
    n = F.col("n")
    plain = F.zip_with(x, F.transform("sums", lambda s: s.try_cast("long")), lambda a, s: a * n - s)
    wide = F.zip_with(x, F.col("sums"), lambda a, s: F.try_subtract(a.cast("decimal(18,0)") * n.cast("decimal(19,0)"), s))
    none = F.lit(0).cast("decimal(38,0)")
    squares = F.aggregate(
        wide, none, lambda t, v: F.try_add(t, F.try_multiply(v, v).try_cast("decimal(38,0)")).try_cast("decimal(38,0)")
    )
    return F.when(F.col("fits"), F.aggregate(plain, F.lit(0).cast("long"), lambda t, v: t + v * v)).otherwise(
        squares.try_cast("long")
    )


def with_model(rows: DataFrame, model: DataFrame, lengths: list[int]) -> list[DataFrame]:
    """``rows`` (with ``x``) beside the model of their length, in rounds of broadcasts of bounded size."""
    rounds: list[list[int]] = [[]]
    size = 0
    for dim in lengths:
        bytes_of = 8 * dim * (COMPONENTS + 6)
        if size + bytes_of > BROADCAST_BYTES and rounds[-1]:
            rounds.append([])
            size = 0
        rounds[-1].append(dim)
        size += bytes_of
    rows = rows.withColumn("dim", F.size("x"))
    return [rows.join(F.broadcast(model.filter(F.col("dim").isin(dims))), "dim") for dims in rounds]


def union(parts: list[DataFrame]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def identity_errors(vectors: DataFrame, model: DataFrame, lengths: list[int], components: int) -> DataFrame:
    """``dim, identity_error``: how far the whitened fit list's covariance is from the identity, at its worst entry."""
    parts = [part.select("dim", whitened(F.col("x")).alias("w")) for part in with_model(vectors, model, lengths)]
    entries = [(i, j) for i in range(components) for j in range(i, components)]
    off = [
        F.abs(F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))) - (1.0 if i == j else 0.0)) for i, j in entries
    ]
    return union(parts).groupBy("dim").agg(F.greatest(*off, F.lit(0.0)).alias("identity_error"))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row and leading component."""
    usable = vectors.filter(column(vector).isNotNull() & countable(column(vector)))
    rows = usable.select(column(vec_id).alias("vec_id"), steps(column(vector)).alias("x"))
    distinct = materialize(rows.select("x").distinct(), "fit-list")
    model = fit(distinct, components)
    lengths = sorted(r[0] for r in model.select("dim").collect())
    errors = identity_errors(distinct, model, lengths, components)
    full = materialize(model.join(errors, "dim"), "model")
    out = union(with_model(rows, full, lengths)).select(
        "vec_id", "n", deviation(F.col("x")).alias("deviation"), "total", "identity_error",
        F.posexplode(F.arrays_zip(whitened(F.col("x")).alias("w"), F.col("variances").alias("e"))).alias("at", "part"),
    )
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("part.w").alias("whitened"),
        (F.col("part.e") / F.col("total")).alias("explained"), "identity_error",
    )
