"""Small hand-made series."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from barwright.schemas import CANDLES


def candle(symbol, open_time, high, low, close, open_=None, trades=1):
    return (symbol, open_time, float(close if open_ is None else open_),
            None if high is None else float(high), None if low is None else float(low),
            float(close), 1.0, 2.0, trades, 0.5, 1.0)


def candles(spark, rows):
    return spark.createDataFrame(rows, CANDLES)


def walk(symbol, slots, seed=1, length=300, flat=0.0):
    """A random integer price walk over the given bar slots; ``flat`` is the share of unchanged bars."""
    rng = random.Random(seed)
    price, rows = 1000, []
    for slot in slots:
        if rng.random() >= flat:
            price = max(10, price + rng.randint(-30, 30))
            rows.append(candle(symbol, slot * length, price + rng.randint(0, 20), price - rng.randint(0, 9), price))
        else:
            rows.append(candle(symbol, slot * length, price, price, price))
    return rows


def as_dict(df, key, columns=None):
    columns = columns or [c for c in df.columns if c not in key]
    return {tuple(r[k] for k in key): {c: r[c] for c in columns} for r in df.collect()}


def close(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=tolerance, abs_tol=tolerance)
    return a == b


def assert_same(left, right, key, columns=None, tolerance=1e-9):
    a, b = as_dict(left, key, columns), as_dict(right, key, columns)
    assert a.keys() == b.keys(), (sorted(a.keys() ^ b.keys())[:5], len(a), len(b))
    for k, row in a.items():
        for name, value in row.items():
            assert close(value, b[k][name], tolerance), (k, name, value, b[k][name])


def one_row(df):
    (row,) = df.collect()
    return row


SIGNAL_KEY = ("bar_interval", "symbol", "bar_start")


def without_update_time(df):
    return df.drop("update_time")


def counted(df):
    return df.agg(F.count(F.lit(1))).first()[0]
