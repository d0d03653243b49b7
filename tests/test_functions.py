import random

import pytest
from pyspark.sql import functions as F

from barwright.functions import (
    coin_name, epoch_seconds, greatest_or_null, least_or_null, parse_matrix, parse_vector, round_binary, round_scaled,
    safe_div, step_times, to_number,
)
from barwright.schemas import rsi_column, served_interval


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_round_binary_equals_exact_rounding(spark):
    rng = random.Random(7)
    numbers = [1.005, 2.675, 0.125, 0.375, -0.125, -2.5, 0.0, 1e-9, 123456.785, 99999999.995]
    numbers += [rng.uniform(-1e6, 1e6) for _ in range(500)] + [rng.randint(-9999, 9999) / 8 for _ in range(200)]
    for digits in (2, 6):
        got = values(spark, round_binary(F.col("x"), digits), [(n,) for n in numbers], "x double")
        assert got == [round(n, digits) for n in numbers]
    assert values(spark, round_binary(F.col("x"), 2), [(None,)], "x double") == [None]


def test_round_scaled_is_half_even_on_the_scaled_value(spark):
    assert values(spark, round_scaled(F.col("x"), 2), [(0.125,), (0.375,), (-0.125,)], "x double") == [0.12, 0.38, -0.12]


def test_null_guards_and_division(spark):
    rows = [(1.0, 2.0), (None, 2.0), (1.0, None)]
    assert values(spark, greatest_or_null(F.col("a"), F.col("b")), rows, "a double, b double") == [2.0, None, None]
    assert values(spark, least_or_null(F.col("a"), F.col("b")), rows, "a double, b double") == [1.0, None, None]
    assert values(spark, safe_div(F.col("a"), F.col("b")), [(1.0, 0.0), (1.0, 4.0)], "a double, b double") == [None, 0.25]


def test_coercion_to_numbers(spark):
    rows = [("12",), ("1e3",), (" 7 ",), ("n/a",), (None,), ("NaN",)]
    assert values(spark, to_number(F.col("t")), rows, "t string") == [12.0, 1000.0, 7.0, 0.0, 0.0, 0.0]


def test_printed_vectors(spark):
    rows = [("[1 2.5  3.]",), ("[ 1 2]",), ("[]",)]
    assert values(spark, parse_vector(F.col("t")), rows, "t string") == [[1.0, 2.5, 3.0], [1.0, 2.0], []]
    rows = [("[[1 2] [3 4]]",), ("[[1 2]\n [3 4]]",), ("[[5]]",)]
    assert values(spark, parse_matrix(F.col("t")), rows, "t string") == [[[1.0, 2.0], [3.0, 4.0]]] * 2 + [[[5.0]]]


def test_coin_name(spark):
    assert values(spark, coin_name(F.col("s")), [("BTCUSDT",), ("XUSDC",)], "s string") == ["BTC", "X"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Ho_Chi_Minh", "America/New_York"])
def test_epoch_seconds_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("select timestamp_ntz'2024-03-10 02:30:59.999999' as ts")
        assert df.select(epoch_seconds(F.col("ts"))).first()[0] == 1710037859
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_step_times():
    assert step_times(3000) == (2700, 2400, 3000 - 28 * 300)
    # the default five minutes are added to the hours
    assert step_times(10_000, hours=1).current == 10_000 - 3900


def test_request_names():
    assert [served_interval(n) for n in ("FOUR_HOUR", "ONE_HOUR", "THIRTY_MINUTE", "ONE_DAY", None)] == [
        "4h", "1h", "30m", "1d", "1d"]
    assert rsi_column("RSI7") == "rsi7"
    with pytest.raises(ValueError):
        rsi_column("rsi7 from secrets --")
