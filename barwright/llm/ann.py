"""Nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector with a few functions ``floor((a.x + b) / w)``, a drawn from the normal distribution, which is 2-stable, and
rows with equal values share a bucket. A query visits its own bucket and then those that differ by one step in
some functions, in the order of their estimated success: the score of a set of steps is the sum of its squared
distances to the crossed bucket borders, and sets come from a heap in the order of their scores. The candidates of all tables are
ranked by their exact distance on the original vectors, in double precision.

The number of functions grows with the logarithm of the rows. Width and number of probes are fitted on a sample of ``SAMPLE`` rows
whose true neighbours are found by one pass over all rows: so many probes that the tables reach ``TARGET`` of these neighbours, and
wider cells where no number of probes does. Rows whose last neighbour lies more than ``REACH`` times farther than the middle one's get
tables of their own. A query is done at the first tables that find it enough rows within the distance they were fitted for; so are its true
neighbours, which are nearer. Queries that no tables are fitted for (under ``LEAST_FITTED`` in the sample) or that find too few
rows are compared with all rows, in blocks.

Buckets are dealt out as pairs of a chunk of rows and a chunk of queries, both of fixed size. A task keeps the best few
of each query that it meets and sends no more than these.

Equal vectors are one class, which keeps its smallest ids, one more than are asked for: no others can be among the answers.

Defined cases
- Null, empty or all-zero vectors, such with null or non-finite components, and null ids take no part, neither as query nor as candidate.
- Vectors of other lengths than the query's are no candidates.
- A row that is repeated, id and vector, counts once. Ties go to the smaller id.
- There are fewer rows than asked for only if the table has fewer candidates.
- Other columns take no part, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import column, floats, key_runs, mix, usable_vector
from barwright.session import materialize

TABLES = 6
SAMPLE = 96
TARGET = 0.97
MOST_PROBES = 2048
REACH, LEAST_FITTED = 2.0, 4
ROW_CHUNK, QUERY_CHUNK = 2048, 512
HELD = 200_000
PAIRS = 1 << 15


class Hashes:
    """The hash functions for vectors of one length."""

    def __init__(self, dim: int, functions: int, width: float):
        rng = np.random.default_rng([dim, functions, TABLES])
        self.a = rng.normal(size=(TABLES * functions, dim))
        self.b = rng.uniform(size=TABLES * functions)
        self.shape, self.width, self.dim = (-1, TABLES, functions), width, dim

    def places(self, x: np.ndarray) -> np.ndarray:
        """Row, table, function: the place on the line, in widths; its floor is the hash."""
        return (x @ self.a.T / self.width + self.b).reshape(self.shape)

    def keys(self, cells: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """64-bit bucket keys of cells (..., functions) of the given tables."""
        keys = (tables + np.uint64(self.dim) * np.uint64(TABLES)).astype(np.uint64)
        keys = np.broadcast_to(keys, cells.shape[:-1]).copy()
        for i in range(cells.shape[-1]):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + cells[..., i].astype(np.int64).view(np.uint64))
        return keys.view(np.int64)


def probes(place: np.ndarray, many: int) -> list[np.ndarray]:
    """The ``many`` likeliest steps away from the cell of a place, the cell itself first."""
    low = place - np.floor(place)
    functions = len(place)
    cost = np.concatenate([low**2, (1 - low) ** 2])
    order = np.argsort(cost, kind="stable")
    cost = cost[order]
    out = [np.zeros(functions, np.int64)]
    heap = [(cost[0], (0,))]
    while heap and len(out) < many:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(order):
            heapq.heappush(heap, (score + cost[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
        at = order[list(chosen)] % functions
        if len(set(at.tolist())) == len(at):  # not both ways in one function
            step = np.zeros(functions, np.int64)
            step[at] = np.where(order[list(chosen)] < functions, -1, 1)
            out.append(step)
    return out


def by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each vector length and their matrix in double precision."""
    sizes = np.diff(batch.column(name).offsets.to_numpy())
    for dim in np.unique(sizes):
        rows = batch.take(pa.array(np.flatnonzero(sizes == dim)))
        yield rows, floats(pa.chunked_array([rows.column(name)]), rows.num_rows).astype(np.float64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and exact distances of the k nearest rows of each query, ties to the smaller id (row number without ids)."""
    k = min(k, len(rows))
    far = squares(queries, rows)
    last = np.partition(far, k - 1, axis=1)[:, k - 1]
    # all rows that can be as near as the k-th within rounding
    slack = 8 * (rows.shape[1] + 4) * np.finfo(np.float64).eps * ((queries * queries).sum(axis=1) + (rows * rows).sum(axis=1).max())
    query, row = np.nonzero(~(far > (last + slack)[:, None]))
    exact = np.concatenate([
        np.sqrt(((queries[query[i : i + PAIRS]] - rows[row[i : i + PAIRS]]) ** 2).sum(axis=1)) for i in range(0, len(query), PAIRS)
    ])
    order = np.lexsort((row if ids is None else ids[row], exact, query))
    best = order[np.searchsorted(query, np.arange(len(queries)))[:, None] + np.arange(k)]
    return row[best], exact[best]


def sampled(sample: np.ndarray, k: int):
    """The k nearest rows of each sample vector within a batch, by one pass over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch, "vector"):
                if x.shape[1] != sample.shape[1]:
                    continue
                at, far = nearest(sample, x, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(sample)), at.shape[1])), rows.column("vector").take(pa.array(at.ravel()))
                     .cast(pa.list_(pa.float64())), pa.array(far.ravel())],
                    ["query", "vector", "far"],
                )

    return run


def fit(rows: DataFrame, many: int, k: int) -> list[tuple[int, float, int, float]]:
    """Number of functions, width, number of probes and reach of each distance scale, for ``many`` rows ``id, vector``."""
    picked = [
        r[0] for r in rows.orderBy(F.xxhash64("id"), "id").select(F.col("vector").cast("array<double>")).limit(SAMPLE).collect()
    ]
    if not picked:
        return []
    dims = [len(p) for p in picked]
    dim = max(set(dims), key=dims.count)
    sample = np.array([p for p in picked if len(p) == dim])
    near = rows.mapInArrow(sampled(sample, k + 1), "query long, vector array<double>, far double")
    rank = F.expr("row_number() over (partition by query order by far)")
    truth = near.withColumn("rank", rank).filter(F.col("rank") <= k + 1).collect()  # SAMPLE times k + 1 rows at most
    of_query: dict[int, list] = {}
    for t in truth:
        if t["far"] > 0:
            of_query.setdefault(t["query"], []).append(t)
    last = {q: max(t["far"] for t in own) for q, own in of_query.items()}
    levels, left = [], set(last)
    while len(left) >= LEAST_FITTED:
        middle = float(np.median([last[q] for q in left]))
        served = sorted((q for q in left if last[q] <= REACH * middle), key=last.get)
        # the nearer and the farther half of the queries have to be reached each
        halves = [[t for q in half for t in of_query[q]] for half in (served[: len(served) // 2], served[len(served) // 2 :]) if half]
        levels.append((*tables_for(sample, halves, 1.5 * middle, many), last[served[-1]]))
        left.difference_update(served)
    return levels


def tables_for(sample: np.ndarray, groups: list[list], width: float, many: int) -> tuple[int, float, int]:
    """Number of functions, width and number of probes that reach ``TARGET`` of the neighbours in every group."""
    while True:
        for functions in range(max(3, round(math.log2(max(many, 2)) / 3)), 0, -1):
            hashes = Hashes(sample.shape[1], functions, width)
            places = hashes.places(sample)
            order = {
                q: [{step.tobytes(): i for i, step in enumerate(probes(p, MOST_PROBES))} for p in places[q]]
                for q in {t["query"] for truth in groups for t in truth}
            }
            needed = 0
            for truth in groups:
                cells = np.floor(hashes.places(np.array([t["vector"] for t in truth]))) - np.floor(places)[[t["query"] for t in truth]]
                first = np.sort([
                    min(order[t["query"]][table].get(cell.astype(np.int64).tobytes(), MOST_PROBES) for table, cell in enumerate(own))
                    for t, own in zip(truth, cells)
                ])
                needed = max(needed, int(first[math.ceil(TARGET * len(first)) - 1]) + 1)
            if needed <= MOST_PROBES:
                return functions, width, needed
        width *= 1.5  # wide enough cells hold them all


def hashed(functions: int, width: float, many: int):
    """``key, id`` of the bucket of every row in every table, or of the ``many`` buckets a query visits in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch, "vector"):
                hashes = Hashes(x.shape[1], functions, width)
                places, ids = hashes.places(x), rows.column("id").to_numpy()
                tables = np.arange(TABLES, dtype=np.uint64)
                if many == 1:
                    keys = hashes.keys(np.floor(places), tables[None])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(ids, TABLES))], ["key", "id"]
                    )
                    continue
                for row, of_row in zip(ids, places):
                    for table, place in enumerate(of_row):
                        cells = np.floor(place)[None] + np.array(probes(place, many))
                        keys = hashes.keys(cells, np.full(len(cells), table, np.uint64))
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), row))], ["key", "id"])

    return run


def best(query: np.ndarray, row: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest distinct rows of each query."""
    order = np.lexsort((row, far, query))
    query, row, far = query[order], row[order], far[order]
    # a row comes with one distance for each query, so its repetitions stand side by side
    new = np.concatenate([[True], (query[1:] != query[:-1]) | (row[1:] != row[:-1])])
    query, row, far = query[new], row[new], far[new]
    start = np.concatenate([[True], query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.flatnonzero(start)[np.cumsum(start) - 1]
    keep = place < k
    return query[keep], row[keep], far[keep]


def searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            query, row, far = best(*(np.concatenate(parts) for parts in zip(*held)), k)
            return query, row, far

        for rows in key_runs(batches, ["key", "i", "j"]):
            base, asked = (rows.filter(pc.equal(rows.column("side"), side)) for side in (0, 1))
            if not base.num_rows or not asked.num_rows:
                continue
            x, q = (floats(t.column("vector"), t.num_rows).astype(np.float64) for t in (base, asked))
            at, far = nearest(q, x, k, base.column("id").to_numpy())
            held.append((np.repeat(asked.column("id").to_numpy(), at.shape[1]), base.column("id").to_numpy()[at].ravel(), far.ravel()))
            size += at.size
            if size > HELD:
                held, before = [flush()], size
                size = len(held[0][0])
                if 2 * size > before:  # many queries: send them off
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["query", "row", "far"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, flush())), ["query", "row", "far"])

    return run


def met(base: DataFrame, index: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """``query, row, score``: the k + 1 nearest of the rows that a query meets, by ``key, id`` of rows and queries."""
    index, visits = materialize(index, "index"), materialize(visits, "visits")
    sizes = index.groupBy("key").agg(F.count("*").alias("rows")).join(
        visits.groupBy("key").agg(F.count("*").alias("asked")), "key"
    )
    sizes = materialize(
        sizes.select(
            "key", F.ceil(F.col("rows") / ROW_CHUNK).cast("int").alias("ni"),
            F.ceil(F.col("asked") / QUERY_CHUNK).cast("int").alias("nj"),
        ),
        "buckets",
    )

    def dealt(side: DataFrame, number: int, own: str, other: str) -> DataFrame:
        out = side.join(sizes, "key").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n{own}")).cast("int"))
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)))
        return out.join(base.select("id", "vector"), "id").select("key", "i", "j", F.lit(number).alias("side"), "id", "vector")

    both = dealt(index, 0, "i", "j").unionAll(dealt(visits, 1, "j", "i"))
    found = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        searched(k + 1), "query long, row long, far double"
    )
    found = found.groupBy("query", "row").agg(F.min("far").alias("score"))
    found = found.withColumn("n", F.expr("row_number() over (partition by query order by score, row)")).filter(F.col("n") <= k + 1)
    return materialize(found.drop("n"), "found")


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each row for which ``is_query`` holds."""
    rows = materialize(
        vectors.select(column(vec_id).cast("long").alias("id"), column(vector).alias("vector"), is_query.alias("asks"))
        .filter(usable_vector(F.col("vector")) & F.col("id").isNotNull())
        .withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(7), "vector")),
        "vectors",
    )
    # the smallest ids of each class, in two steps so that no task sorts a whole class
    salted = rows.select("h1", "h2", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).withColumn(
        "n", F.expr("dense_rank() over (partition by h1, h2, salt order by id)")
    ).filter(F.col("n") <= k + 1)
    few = salted.withColumn("n", F.expr("dense_rank() over (partition by h1, h2 order by id)")).filter(F.col("n") <= k + 1)
    classes = materialize(
        few.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        .withColumn("id", F.element_at("ids", 1)), "classes",
    )
    base = materialize(
        rows.join(classes.select("h1", "h2", "id"), ["h1", "h2", "id"]).dropDuplicates(["h1", "h2"]).select("h1", "h2", "id", "vector"),
        "class-vectors",
    )
    queries = rows.filter(F.coalesce("asks", F.lit(False))).select("h1", "h2", F.col("id").alias("query_id")).distinct()
    asked = materialize(
        queries.join(classes.select("h1", "h2", F.col("id").alias("query")), ["h1", "h2"]).select("query", "query_id"), "queries"
    )
    asking = base.join(asked.select(F.col("query").alias("id")).distinct(), "id", "left_semi").select("id", "vector")
    asking, parts = materialize(asking, "asking"), []
    for functions, width, many, reach in fit(base.select("id", "vector"), base.count(), k):
        index = base.select("id", "vector").mapInArrow(hashed(functions, width, 1), "key long, id long")
        visits = asking.mapInArrow(hashed(functions, width, max(2, many)), "key long, id long")
        found = met(base, index, visits, k)
        done = found.groupBy("query").agg(F.count("*").alias("n"), F.max("score").alias("last")).filter(
            (F.col("n") == k + 1) & (F.col("last") <= reach)
        ).select("query")
        parts.append(found.join(done, "query", "left_semi"))
        asking = materialize(asking.join(done, F.col("id") == F.col("query"), "left_anti"), "asking")
    # the others meet all rows of their length
    every = F.size("vector").cast("long").alias("key")
    parts.append(met(base, base.select(every, "id"), asking.select(every, "id"), k))
    near = reduce(DataFrame.unionAll, parts)
    spread = near.join(classes.select(F.col("id").alias("row"), "ids"), "row").select(
        "query", "score", F.explode("ids").alias("vec_id")
    )
    answers = spread.join(asked, "query").filter("vec_id <> query_id").dropDuplicates(["query_id", "vec_id"])
    rank = F.expr("row_number() over (partition by query_id order by score, vec_id)")
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
