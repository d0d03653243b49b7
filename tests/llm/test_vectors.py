import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.llm import ann, vectors
from texts import rows_of

KIND = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
])


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows], KIND)


def clustered(n, dim, seed, noise):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 8, dim))
    return (centers[rng.integers(0, len(centers), n)] + noise * rng.normal(size=(n, dim))).astype(np.float32), rng.integers(0, 4, n)


def brute_links(x, labels, ids, threshold):
    x = x.astype(np.float64)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    link = (u @ u.T >= threshold) & (labels[:, None] == labels[None])
    np.fill_diagonal(link, False)
    root = ids.copy()
    while True:
        new = np.minimum(root, np.where(link, root[None], np.iinfo(np.int64).max).min(axis=1))
        if (new == root).all():
            return link.sum(axis=1), root
        root = new


@pytest.mark.parametrize("chunk", [1024, 16])
@pytest.mark.parametrize("noise", [0.1, 0.24])
def test_links_equal_brute_force(spark, noise, chunk):
    x, labels = clustered(400, 32, 3, noise)
    x[10:30], labels[10:30] = x[10], labels[10]  # copies
    x[40] = 3 * x[41]
    ids = np.random.default_rng(1).permutation(1000)[:400]
    n, root = brute_links(x, labels, ids, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.linked_vectors(
        table(spark, [(int(i), v, int(k)) for i, v, k in zip(ids, x, labels)]), chunk=chunk).collect()}
    found = sum(v[0] for v in got.values())
    assert found >= 0.99 * n.sum() and found <= n.sum()
    wrong = [i for i, a, b in zip(ids, n, root) if got[i] != (a, b, b == i)]
    assert len(wrong) <= 4, (len(wrong), n.sum(), found)


def test_vectors_that_take_no_part(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0] * 4, 0), (7, [math.nan, 1, 2, 3], 0), (8, [math.inf, 1, 2, 3], 0),
            (9, [None, 1, 2, 3], 0), (10, [], 0), (11, v[:3], 0), (None, v, 0), (2, v, 0), (12, [1e30, 2e30, 3e30, 4e30], 0)]
    df = table(spark, rows).select("*", F.lit(1).alias("key"), F.lit(2).alias("id"), F.lit(3).alias("many"))
    got = rows_of(vectors.linked_vectors(df), "vec_id", "n_links", "component_id", "kept")
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (12, 3, 1, False), (None, 0, None, True), *alone], key=repr)
    assert vectors.linked_vectors(table(spark, [])).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    a = vectors.unit(rng.normal(size=(300, 64)))
    b = vectors.unit(a + 0.05 * rng.normal(size=(300, 64)))
    codes, factor, _ = vectors.encode(a, 8, 1)
    signs = np.unpackbits(codes, axis=1) * 2.0 - 1
    estimate = ((signs @ (b @ vectors.rotation(64, 0).T).T) / 8 / factor[:, None]).diagonal()
    true = (a * b).sum(axis=1)
    bound = vectors.SURE * np.sqrt(1 - factor**2) / factor / math.sqrt(63)
    assert abs((estimate - true).mean()) < 0.01 and (np.abs(estimate - true) <= bound).all()


def test_estimates_from_stored_planes_are_bounded():
    rng = np.random.default_rng(7)
    for dim in (5, 64, 100, 200):
        x = vectors.unit(np.repeat(rng.normal(size=(150, dim)), 2, axis=0) + 0.1 * rng.normal(size=(300, dim)))
        out = next(vectors.encoded(12, 9)(iter([pa.RecordBatch.from_arrays(
            [pa.array(range(300)), pa.array([5] * 300), pa.array(list(x)), pa.array([1] * 300)], ["id", "label", "vector", "many"])])))
        rows = pa.Table.from_batches([out]).append_column("band", pa.array([9] * 300))
        stored = vectors.Stored(rows, 12)
        a, b = np.arange(0, 300, 2), np.arange(1, 300, 2)
        cosine = (x[a] * x[b]).sum(axis=1)
        for threshold in (0.9, 0.95):
            assert stored.may_reach(a, b, threshold)[cosine >= threshold].all()
            assert (stored.reach(a, b, threshold) == (cosine >= threshold)).all()
        if dim >= 64:  # the bound turns unlike pairs away
            assert stored.may_reach(a, np.roll(b, 7), 0.93).mean() < 0.2
        _, _, values = vectors.encode(x, 12, 9)
        assert (stored.meet_first(a, b, 0) == ~(values[a] == values[b]).any(axis=1)).all()


def test_labels_are_compared_as_they_are(spark):
    for kind, (p, q) in (("string", ("x", "y")), ("double", (1.2, 1.7))):
        rows = [(i, [1.0, 2.0, 3.0 + i / 100], p if i % 2 else q) for i in range(8)] + [(9, [1.0, 2.0, 3.0], None)]
        got = rows_of(vectors.linked_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")), "vec_id", "n_links", "component_id")
        assert got == [(i, 3, i % 2) for i in range(8)] + [(9, 0, 9)]


def brute_nearest(rows, queries, k):
    out = {}
    for q in queries:
        v = np.array(rows[q], dtype=np.float64)
        near = sorted((math.sqrt(((np.array(x, dtype=np.float64) - v) ** 2).sum()), i) for i, x in rows.items() if i != q and len(x) == len(v))
        out[q] = near[:k]
    return out


def test_neighbours_reach_the_recall(spark):
    for noise in (0.3, 5.0):  # clusters, and next to none
        x, _ = clustered(3000, 24, 8, noise)
        rows = {i: v.tolist() for i, v in enumerate(x)}
        got = ann.nearest_neighbours(table(spark, [(i, v, 0) for i, v in rows.items()]), F.col("vec_id") % 100 == 0).collect()
        want = brute_nearest(rows, range(0, 3000, 100), 10)
        hit = sum((r.score, r.vec_id) in want[r.query_id] or any(i == r.vec_id for _, i in want[r.query_id]) for r in got)
        assert hit >= 0.9 * 300, (noise, hit)
        for r in got:
            v = np.array(rows[r.query_id]) - np.array(rows[r.vec_id])
            assert r.score == pytest.approx(math.sqrt((v * v).sum()), rel=1e-12)
        for q in want:
            mine = [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
            assert mine == sorted(mine) and len(mine) == 10


def test_neighbours_at_every_distance_scale(spark):
    rng = np.random.default_rng(4)
    # most rows in groups of 20 near copies, the others with neighbours a hundred times farther, and one far from all
    near = np.repeat(rng.normal(size=(80, 16)) * 30, 20, axis=0) + 0.01 * rng.normal(size=(1600, 16))
    x = np.concatenate([near, 500 + rng.normal(size=(800, 16)), np.full((1, 16), -9000.0)])[rng.permutation(2401)].astype(np.float32)
    rows = {i: v.tolist() for i, v in enumerate(x)}
    asked = [*range(0, 2401, 30), int(np.argmin(x[:, 0]))]
    got = ann.nearest_neighbours(table(spark, [(i, v, 0) for i, v in rows.items()]), F.col("vec_id").isin(asked)).collect()
    want = brute_nearest(rows, asked, 10)
    mine = {q: {r.vec_id for r in got if r.query_id == q} for q in want}
    assert all(len(v) == 10 for v in mine.values())
    scales = [[q for q in want if a <= want[q][-1][0] < b] for a, b in ((0, 0.5), (0.5, 100), (100, math.inf))]
    for of_scale in scales:
        hit = sum(len(mine[q] & {i for _, i in want[q]}) for q in of_scale)
        assert of_scale and hit >= 0.9 * 10 * len(of_scale), (len(of_scale), hit)


def test_ties_at_the_last_place_go_to_the_smaller_ids():
    rng = np.random.default_rng(6)
    rows = np.concatenate([np.eye(200), 0.5 * np.eye(200)[:3]])  # 200 rows at one distance of the first query, three nearer
    ids = rng.permutation(1000)[: len(rows)]
    queries = np.stack([np.zeros(200), np.eye(200)[0]])
    at, far = ann.nearest(queries, rows, 8, ids)
    assert sorted(ids[at[0]][:3]) == sorted(ids[200:]) and ids[at[0]][3:].tolist() == sorted(ids[:200])[:5]
    assert far[0].tolist() == [0.5] * 3 + [1.0] * 5 and at[1][:2].tolist() == [0, 200]
    for q, own in zip(queries, at):
        want = sorted((math.sqrt(((q - r) ** 2).sum()), i) for r, i in zip(rows, ids.tolist()))[:8]
        assert [i for _, i in want] == ids[own].tolist()


def test_neighbours_with_copies_ties_and_unusable_rows(spark):
    rows = [(i, [1.0, 1.0, 0.0], 0) for i in range(0, 400, 10)] + [(7, [1.0, 0.0, 0.0], 0), (9, [1.0, 2.0, 0.0], 0), (3, None, 0), (5, [0.0] * 3, 0),
                                                                 (11, [1.0, math.nan, 0.0], 0), (13, [1.0, 1.0], 0), (None, [1.0, 1.0, 0.0], 0), (10, [1.0, 1.0, 0.0], 0)]
    df = table(spark, rows).select("*", F.lit(1).alias("key"), F.lit(2).alias("rank"), F.lit(3).alias("h1"))
    got = ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0)
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    by = {q: [(r["rank"], r.vec_id, r.score) for r in sorted(got.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100)}
    assert by[0] == [(i, 10 * i, 0.0) for i in range(1, 11)]
    assert by[100] == [(i + 1, 10 * i, 0.0) for i in range(10)]
    few = ann.nearest_neighbours(table(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)]), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 1, math.sqrt(2))]
    assert ann.nearest_neighbours(table(spark, []), F.col("vec_id") == 0).count() == 0


def test_probes_come_in_the_order_of_their_scores():
    rng = np.random.default_rng(2)
    for _ in range(20):
        place = rng.uniform(-3, 3, 4)
        steps = ann.probes(place, 81)
        low = place - np.floor(place)
        score = [sum((low[i] if s < 0 else 1 - low[i]) ** 2 for i, s in enumerate(step) if s) for step in steps]
        assert len({s.tobytes() for s in steps}) == len(steps) == 81 and score == pytest.approx(sorted(score))
