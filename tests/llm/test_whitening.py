import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import bidiagonal, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def run(spark, rows, **settings):
    frame = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    return whitening.whiten(frame, **settings).collect()


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def check(got, rows, components=4, tolerance=1e-7):
    """Against plain numpy on the whole list."""
    own = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if usable(v)]
    listed = sorted({tuple(x) for _, x in own})
    n, sums = len(listed), [sum(x[k] for x in listed) for k in range(len(listed[0]))]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in listed])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = [k for k in range(min(components, len(values))) if values[k] > 1e-13 * values[0]]
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, k + 1) for i, _ in own for k in kept)
    by_place = {}
    for r in got:
        by_place.setdefault((r.vec_id, r.component), []).append(r)
    sign = {}
    for i, x in own:
        row = np.array([(n * c - s) / n for c, s in zip(x, sums)])
        for k in kept:
            expected = row @ vectors[:, k] / math.sqrt(values[k])
            for r in by_place[i, k + 1]:
                assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums))
                assert abs(r.explained - values[k] / values.sum()) <= 1e-9
                assert r.identity_error <= 1e-9
                if abs(expected) > 1e-6:
                    sign.setdefault(k, math.copysign(1, expected * r.whitened))
                    assert abs(r.whitened - sign[k] * expected) <= tolerance * max(1, abs(expected))


def made(seed, many, dim, spread=None, offset=0.0):
    rng = np.random.default_rng(seed)
    spread = np.linspace(3, 0.2, dim) if spread is None else np.asarray(spread)
    mixed = rng.standard_normal((many, dim)) * spread @ np.linalg.qr(rng.standard_normal((dim, dim)))[0] + offset
    return [(i, [float(c) for c in row]) for i, row in enumerate(mixed)]


@pytest.mark.parametrize("dim,many", [(12, 300), (3, 50), (20, 9)])
def test_equals_numpy(spark, dim, many):
    rows = made(dim, many, dim)
    check(run(spark, rows), rows)


def test_far_from_zero_with_copies_and_unusable_rows(spark):
    rows = made(1, 200, 6, offset=5000.0)
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(7, rows[7][1])]
    rows += [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [math.nan] * 6), (2003, [math.inf] + [0.0] * 5), (2004, [0.0] * 6)]
    got = run(spark, rows)
    usable_rows = [r for r in rows if usable(r[1])]
    ids = sorted(r.vec_id for r in got if r.component == 1)
    assert ids == sorted(i for i, _ in usable_rows)
    check(got, rows)


def test_equal_variances(spark):
    rows = [(2 * k + s, [float((1 if s else -1) * (k == j)) for j in range(8)]) for k in range(8) for s in (0, 1)]
    got = run(spark, rows)
    assert {r.component for r in got} == {1, 2, 3, 4} and all(r.identity_error < 1e-9 for r in got)
    assert all(abs(r.explained - 1 / 8) < 1e-12 for r in got)


def test_flat_directions_have_no_component(spark):
    rows = [(i, [float(i % 17), float(2 * (i % 17)), 4.0]) for i in range(100)]
    assert {r.component for r in run(spark, rows)} == {1}
    assert run(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])]) == []


def test_tree_of_factors_and_lengths_apart(spark, monkeypatch):
    rows = made(5, 400, 5) + [(1000 + i, v) for i, v in made(6, 300, 7)] + [(5000, [])]
    frame = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).repartition(30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        got = whitening.whiten(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    check([r for r in got if r.vec_id < 1000], [r for r in rows if r[0] < 1000])
    check([r for r in got if r.vec_id >= 1000], [r for r in rows if 1000 <= r[0] < 5000])


def test_sums_beyond_a_long(spark):
    rows = made(2, 60, 4, spread=[1e9, 1e8, 3e7, 1e7])
    got = run(spark, rows)
    assert {r.deviation for r in got} == {None} or all(r.deviation is None or r.deviation >= 0 for r in got)
    assert run(spark, [*rows, (99, [1e30, 0.0, 0.0, 0.0])]) is not None


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = made(9, 40, 3)
    frame = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    odd = frame.withColumns({n: F.lit(1) for n in ("x", "dim", "n", "whole", "total", "a.b")})
    check(whitening.whiten(odd).collect(), rows)


def test_vectors_by_twisted_factorisation():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    spreads = {
        "cluster": [5.0] * 6 + [1.0] * 34, "near": [5, 5 - 1e-7, 5 - 2e-7, 5 - 1e-12, *np.linspace(1, 0.1, 36)],
        "graded": (10.0 ** -np.arange(0, 20, 0.5)).tolist(), "pairs": [7.0, 7.0, 3.0, 3.0] + [1e-6] * 36,
    }
    for spread in spreads.values():
        matrix = np.linalg.qr((np.linalg.qr(rng.standard_normal((40, 40)))[0] * np.array(spread)) @ turn, mode="r")
        values, vectors, total = bidiagonal.leading(matrix, 4)
        truth = np.linalg.svd(matrix, compute_uv=False) ** 2
        assert np.abs(values - truth[:4]).max() < 1e-13 * truth[0] and abs(total - truth.sum()) < 1e-13 * truth.sum()
        assert np.abs(vectors @ vectors.T - np.eye(4)).max() < 1e-13
        assert np.abs(matrix.T @ (matrix @ vectors.T) - vectors.T * values).max() < 1e-13 * truth[0]


def test_values_of_small_whole_matrices():
    rng = np.random.default_rng(4)
    for _ in range(300):
        d = int(rng.integers(1, 12))
        matrix = np.triu(rng.integers(-2, 3, (d, d)).astype(float))
        values, vectors, _ = bidiagonal.leading(matrix, 4)
        truth = np.linalg.svd(matrix, compute_uv=False) ** 2
        assert np.allclose(values, truth[: len(values)], rtol=0, atol=1e-12 * max(truth[0], 1e-300))
        assert np.abs(matrix.T @ matrix @ vectors.T - vectors.T * values).max(initial=0) <= 1e-11 * max(truth[0], 1e-300)
