"""Near-dedup of embeddings with binary codes of randomly rotated vectors.

A vector is brought to unit length and rotated at random; the signs of its components are its code. Its correction factor is the
inner product of the vector with its own code: dividing by it makes the inner product of a code with another vector an
unbiased estimate of the cosine, with a known error bound. The other vector counts with its rotated components in 16
steps, rounded with a fixed dither, as four planes of bits, so an estimate is a few bit counts. Code, factor, planes and the
values of all bands are computed once a vector and stored; only pairs whose upper bound reaches the threshold are computed
again, exactly, on the original vectors. A pair at the threshold is lost to the bound with a probability below 1e-4.

Pairs are looked for in buckets: further rotations give sign bits, cut into bands, and vectors of one label that share
all bits of a band meet. The bits of a band grow with the logarithm of the largest label, so that a bucket does not
fill up with unlike vectors, and the number of bands follows from the bits and the threshold: a pair at the threshold
shares no band with a probability of ``miss``. A bucket is dealt out as pairs of chunks of fixed size, so that none has to fit in
a task; a pair that shares several bands counts in the first, which the stored values tell. Many buckets are compared at a
time. A task gives counts and a spanning forest of its links, not the pairs.

Equal vectors of a label are one class from the start, counted with their number.

Defined cases
- Null, empty or all-zero vectors, such with null or non-finite components, and rows with a null label or id link with nothing;
  their component is their own id. Vectors of different lengths are not compared.
- Rows with the same id and vector are two vectors to each other: both count as links.
- Labels of any type with a hash are compared as they are.
- Other columns take no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.llm.common import column, floats, mix, slices, usable_vector
from barwright.llm.graph import components
from barwright.session import materialize

CHUNK = 1024
PAIRS = 1 << 15
SURE = 4.0
PLANES = 4
STEPS = 1 << PLANES


@lru_cache(256)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same numbers everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def plan_bands(largest: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a band and number of bands."""
    bits = min(60, max(8, math.ceil(math.log2(max(largest, 2))) + 2))
    same = 1 - math.acos(min(1.0, threshold)) / math.pi
    return bits, math.ceil(math.log(miss) / math.log1p(-(same**bits)))


def encode(x: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (signs of the first rotation), correction factors, and band values of unit vectors."""
    dim = x.shape[1]
    turned = x @ rotation(dim, 0).T
    factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    need, signs, number = bits * bands, [], 1
    while sum(s.shape[1] for s in signs) < need:
        signs.append(x @ rotation(dim, number).T > 0)
        number += 1
    signs = np.concatenate(signs, axis=1)[:, :need].reshape(len(x), bands, bits)
    values = signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return np.packbits(turned > 0, axis=1), factor, values


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated components in ``STEPS`` steps: four bit planes (row, plane, byte), the lowest value and the step of each row."""
    dim = x.shape[1]
    turned = x @ rotation(dim, 0).T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (STEPS - 1), 1e-300)
    dither = np.random.default_rng([dim, STEPS]).random(dim)
    steps = np.minimum((turned - low[:, None]) / step[:, None] + dither, STEPS - 1).astype(np.uint8)
    bits = (steps[:, None] >> np.arange(PLANES, dtype=np.uint8)[:, None]) & 1
    return np.packbits(bits, axis=2), low, step


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows = np.ascontiguousarray(rows.reshape(len(rows), -1))
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def encoded(bits: int, bands: int):
    """Each vector with its code, factor, planes, the values of its bands (``width`` bytes each) and their bucket keys."""
    width = band_width(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                x = unit(floats(pa.chunked_array([part.column("vector")]), part.num_rows))
                codes, factor, values = encode(x, bits, bands)
                query, low, step = planes(x)
                label = part.column("label").to_numpy().view(np.uint64)[:, None]
                number = np.arange(bands, dtype=np.uint64)[None] + np.uint64(dim) * np.uint64(1 << 20)
                with np.errstate(over="ignore"):
                    keys = mix(mix(values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number) ^ mix(label))
                shorter = values.astype("<i8").view(np.uint8).reshape(part.num_rows, bands, 8)[:, :, :width]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, binary(codes), pa.array(factor), binary(query), pa.array(low), pa.array(step), binary(shorter), lists],
                    [*part.schema.names, "code", "factor", "query", "low", "step", "bands", "keys"],
                )

    return run


def band_width(bits: int) -> int:
    return -(-bits // 8)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def closed_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of ``key, i, j`` from sorted rows, and where the groups start. Holds one batch and one group."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, part]) if held is not None else part
        starts = group_starts(rows)
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts[:-1]
        held = rows.slice(starts[-1]) if len(starts) else None
    if held is not None:
        yield held, group_starts(held)


def group_starts(rows: pa.Table) -> np.ndarray:
    names = np.stack([rows.column(name).to_numpy().astype(np.int64) for name in ("key", "i", "j")])
    return np.flatnonzero(np.concatenate([np.ones(min(1, rows.num_rows), bool), (names[:, 1:] != names[:, :-1]).any(axis=0)]))


def compared(bits: int, threshold: float):
    """Links of the chunk pairs of many buckets: ``id, other, n``: n further vectors linked, other a node of its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in closed_groups(batches):
            yield links(rows, starts, bits, threshold)

    return run


def partners(rows: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of the rows that each row is compared with: those behind it in its chunk, or the other chunk's."""
    n = rows.num_rows
    sizes = np.diff(np.append(starts, n))
    end = np.repeat(starts + sizes, sizes)
    right = rows.column("side").to_numpy() == 1
    middle = end - np.repeat(np.add.reduceat(right, starts, dtype=np.int64), sizes)
    same = rows.column("i").to_numpy() == rows.column("j").to_numpy()
    first = np.where(same, np.arange(n) + 1, middle)
    return first, np.where(right, 0, end - first)


def links(rows: pa.Table, starts: np.ndarray, bits: int, threshold: float) -> pa.RecordBatch:
    first, count = partners(rows, starts)
    total = np.cumsum(count)
    found = [np.zeros((2, 0), dtype=np.int64)]
    stored = Stored(rows, bits)
    at = 0
    while at < rows.num_rows:  # slabs of about PAIRS pairs
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        a = np.repeat(np.arange(at, to), count[at:to])
        b = np.arange(len(a)) - np.repeat(total[at:to] - count[at:to] - (total[at - 1] if at else 0), count[at:to]) + first[a]
        for test in (stored.may_reach, stored.meet_first, stored.reach):
            if len(a):
                near = test(a, b, threshold)
                a, b = a[near], b[near]
        found.append(np.stack([a, b]))
        at = to
    a, b = np.concatenate(found, axis=1)
    names, of = np.unique(rows.column("id").to_numpy(), return_inverse=True)
    many = rows.column("many").to_numpy()
    n = np.bincount(of[a], many[b], len(names)) + np.bincount(of[b], many[a], len(names))
    root, _ = forest(of[a], of[b], np.arange(len(names)), np.arange(len(names)))
    keep = n > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(names[keep]), pa.array(names[root[keep]]), pa.array(n[keep].astype(np.int64))], ["id", "other", "n"]
    )


class Stored:
    """What is stored of the vectors of a table, and the three tests of pairs of its rows, the cheapest first."""

    def __init__(self, rows: pa.Table, bits: int):
        self.rows, self.width = rows, band_width(bits)
        self.dims = pa.compute.list_value_length(rows.column("vector")).to_numpy()
        self.label = rows.column("label").to_numpy()
        self.factor, self.low, self.step = (rows.column(name).to_numpy() for name in ("factor", "low", "step"))
        self.band = rows.column("band").to_numpy()
        self.bands = self.padded("bands", 1)
        code, query = self.padded("code", 8), self.padded("query", 8 * PLANES, PLANES)
        self.code = code.view(np.uint64)
        self.query = np.stack([query[:, i].copy().view(np.uint64) for i in range(PLANES)], axis=1)
        weights = 1 << np.arange(PLANES)
        self.ones = np.bitwise_count(self.code).sum(axis=1, dtype=np.int64)
        self.sum = (np.bitwise_count(self.query).sum(axis=2, dtype=np.int64) * weights).sum(axis=1)
        self.x: np.ndarray | None = None

    def padded(self, name: str, unit_bytes: int, parts: int = 1) -> np.ndarray:
        """A binary column as rows of bytes, each of its ``parts`` filled up with zeros to whole units."""
        values = self.rows.column(name).combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)
        sizes = np.diff(offsets)
        unit_bytes //= parts
        longest = -(-max(1, int(sizes.max(initial=0)) // parts) // unit_bytes) * unit_bytes
        out = np.zeros((len(sizes), parts, longest), dtype=np.uint8)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        each = np.maximum(sizes // parts, 1)[row]
        out[row, place // each, place % each] = data[offsets[0] : offsets[-1]]
        return out if parts > 1 else out[:, 0]

    def may_reach(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the upper bound of the estimate from the code of a and the planes of b reaches the threshold."""
        dim, factor = self.dims[a], self.factor[a]
        common = np.zeros(len(a))
        for i in range(PLANES):
            common += np.bitwise_count(self.code[a] & self.query[b, i]).sum(axis=1, dtype=np.int64) << i
        dot = 2 * (self.low[b] * self.ones[a] + self.step[b] * common) - self.low[b] * dim - self.step[b] * self.sum[b]
        estimate = dot / np.sqrt(dim) / factor
        spread = np.sqrt(np.maximum(0, 1 - factor**2) / np.maximum(1, dim - 1) + self.step[b] ** 2 / 4) / factor
        return (self.label[a] == self.label[b]) & (dim == self.dims[b]) & (estimate + SURE * spread >= threshold)

    def meet_first(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the band of the bucket is the first that a pair shares; rows hold the values of the bands before it."""
        if not self.band.max():
            return np.ones(len(a), bool)
        values = self.bands[:, : int(self.band.max()) * self.width].reshape(len(self.bands), -1, self.width)
        shared = (values[a] == values[b]).all(axis=2)
        return ~(shared & (np.arange(values.shape[1]) < self.band[a, None])).any(axis=1)

    def reach(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """The cosine itself."""
        if self.x is None:
            self.x = np.zeros((len(self.dims), int(self.dims.max())))
            for dim in np.unique(self.dims):
                rows = np.flatnonzero(self.dims == dim)
                self.x[rows, :dim] = unit(floats(self.rows.column("vector").take(pa.array(rows)), len(rows)))
        return np.einsum("ij,ij->i", self.x[a], self.x[b]) >= threshold


def forest(a: np.ndarray, b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row reaches over the links of the block."""
    names, at = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    at_a, at_b = at[: len(ids_a)], at[len(ids_a) :]
    x, y = at_a[a], at_b[b]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            return names[root[at_a]], names[root[at_b]]
        root = new


def linked_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = 0.93, miss: float = 1e-4, chunk: int = CHUNK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    rows = vectors.select(column(vec_id).cast("long").alias("vec_id"), column(label).alias("label"), column(vector).alias("vector"))
    if rows.schema["vector"].dataType.elementType != T.FloatType():
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    kind = rows.schema["vector"].dataType.simpleString()
    keyed = materialize(
        rows.withColumn("takes_part", usable_vector(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
        .withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64("vector", "label")),
        "vectors",
    )
    used = keyed.filter("takes_part")
    classes = materialize(used.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("many")), "classes")
    first = materialize(
        used.join(classes.withColumnRenamed("id", "vec_id"), ["h1", "h2", "vec_id"]).dropDuplicates(["h1", "h2"])
        .select(F.col("vec_id").alias("id"), F.xxhash64("label").alias("label"), "vector", "many"),
        "class-vectors",
    )
    largest = first.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, bands = plan_bands(largest, threshold, miss)
    codes = materialize(
        first.mapInArrow(
            encoded(bits, bands),
            f"id long, label long, vector {kind}, many long, code binary, factor double, query binary, low double, step double, "
            "bands binary, keys array<long>",
        ),
        "codes",
    )
    keys = codes.select("id", F.posexplode("keys").alias("band", "key"))
    buckets = materialize(
        keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        .select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")),
        "buckets",
    )
    # a bucket of c chunks goes to a task for each pair of chunks: a row stands on the left or the right of c of them
    member = keys.join(buckets, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    sides = member.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", "band", "id",
        F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
        F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"),
    )
    # of the bands a row needs those before its bucket's
    before = F.expr(f"substring(bands, 1, band * {band_width(bits)})")
    dealt = (
        sides.join(codes.drop("keys"), "id").withColumn("bands", before)
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    )
    found = materialize(dealt.mapInArrow(compared(bits, threshold), "id long, other long, n long"), "found")
    groups = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct())
    totals = found.groupBy("id").agg(F.sum("n").alias("n"))
    answer = materialize(
        classes.join(totals, "id", "left").join(groups, "id", "left").select(
            "h1", "h2", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        ),
        "answer",
    )
    mine = keyed.withColumn("h1", F.when(F.col("takes_part"), F.col("h1"))).select("vec_id", "h1", "h2")
    return mine.join(answer, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
