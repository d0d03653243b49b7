"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(names: list[str], *wanted: str) -> list[str]:
    """Column names that do not clash with ``names`` (compared without case), one for each of ``wanted``."""
    taken = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digest128(value: Column, tag: str) -> list[Column]:
    """Two independent 64-bit hashes of a value."""
    return [F.xxhash64(value).alias(f"{tag}1"), F.xxhash64(F.lit(0x5BD1E995), value).alias(f"{tag}2")]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts: so many texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches whose rows are sorted by integer ``keys``.

    Holds one batch and the key that is still open, so the caller bounds memory by bounding the rows of a key.
    """
    open_rows: list[pa.Table] = []
    open_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        values = np.stack([part.column(k).to_numpy().astype(np.int64) for k in keys])
        starts = np.flatnonzero(np.concatenate([[True], (values[:, 1:] != values[:, :-1]).any(axis=0)]))
        ends = np.append(starts[1:], part.num_rows)
        for start, end in zip(starts.tolist(), ends.tolist()):
            key = tuple(values[:, start].tolist())
            if key != open_key:
                if open_rows:
                    yield pa.concat_tables(open_rows)
                open_rows, open_key = [], key
            open_rows.append(part.slice(start, end - start))
    if open_rows:
        yield pa.concat_tables(open_rows)


def floats(lists: pa.ChunkedArray, rows: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = pa.concat_arrays([c.flatten() for c in lists.chunks]) if lists.num_chunks > 1 else lists.chunk(0).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def usable_vector(vector: Column) -> Column:
    """Not null, not empty, not all zero, and all components finite."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
