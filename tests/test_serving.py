import pytest

from barwright.operators import serving
from barwright.operators.patterns import original_pairs, pattern_detail
from barwright.schemas import PATTERNS, PREDICTIONS

SCHEMA = "bar_interval string, symbol string, bar_start long, open double, high double, low double, close double, rsi7 double, rsi14 double"


def signals(spark, rows):
    return spark.createDataFrame(
        [(i, s, t, 1.0, 3.0, 0.5, float(c), 50.0, None if r is None else float(r)) for i, s, t, c, r in rows], SCHEMA)


def symbols(df):
    return [r.symbol for r in df.collect()]


def test_bounds_are_strict_and_only_the_quote_suffix_counts(spark):
    rows = [("4h", s, 14400, 1, r) for s, r in (
        ("LOWUSDT", 29.9), ("EDGEUSDT", 30), ("HIGHUSDT", 70.1), ("TOPUSDT", 70), ("LOWBTC", 1), ("NONEUSDT", None), ("MINUSDT", 2))]
    df = signals(spark, rows)
    assert symbols(serving.top_over_sold(df)) == ["MINUSDT", "LOWUSDT"]
    assert symbols(serving.top_over_bought(df)) == ["HIGHUSDT"]


def test_only_the_latest_snapshot_of_the_interval_counts(spark):
    df = signals(spark, [("4h", "AUSDT", 0, 1, 5), ("4h", "BUSDT", 14400, 1, 6), ("1h", "CUSDT", 18000, 1, 7), ("1d", "DUSDT", 0, 1, 8)])
    assert symbols(serving.top_over_sold(df, interval="FOUR_HOUR")) == ["BUSDT"]
    assert symbols(serving.top_over_sold(df, interval="ONE_HOUR")) == ["CUSDT"]
    assert symbols(serving.top_over_sold(df, interval="whatever")) == ["DUSDT"]
    # a snapshot older than a week is none
    assert symbols(serving.top_over_sold(df, as_of=14400 + 7 * 86400)) == ["BUSDT"]
    assert symbols(serving.top_over_sold(df, as_of=14401 + 7 * 86400)) == []


def test_at_most_a_hundred_rows_in_order(spark):
    df = signals(spark, [("4h", f"S{n:03d}USDT", 0, 1, n / 10) for n in range(150)])
    got = serving.top_over_sold(df).collect()
    assert len(got) == 100 and [r.rsi for r in got] == [n / 10 for n in range(100)]
    assert "TakeOrderedAndProject" in serving.top_over_sold(df)._jdf.queryExecution().executedPlan().toString()
    assert (got[0].high, got[0].low, got[0].date_created) == (3.0, 0.5, "0")


def test_rsi_column_is_checked(spark):
    with pytest.raises(ValueError):
        serving.top_over_sold(signals(spark, []), rsi="close")


def test_rsi_change_uses_the_own_previous_bar(spark):
    df = signals(spark, [
        ("4h", "AUSDT", 0, 1, 40), ("4h", "AUSDT", 28800, 1, 50),
        ("4h", "BUSDT", 14400, 1, 0), ("4h", "BUSDT", 28800, 1, 50),
        ("4h", "GONEUSDT", 14400, 1, 10), ("4h", "NEWUSDT", 28800, 1, 10), ("4h", "CBTC", 0, 1, 1), ("4h", "CBTC", 28800, 1, 1),
        ("4h", "NULLUSDT", 0, 1, 10), ("4h", "NULLUSDT", 14400, 1, None), ("4h", "NULLUSDT", 28800, 1, 20)])
    got = [tuple(r) for r in serving.rsi_change(df).collect()]
    assert got == [("AUSDT", 50.0, 25.0), ("BUSDT", 50.0, None), ("NULLUSDT", 20.0, None)]


def test_coin_prices(spark):
    df = signals(spark, [
        ("5m", "AAUSDT", 300, 110, 1), ("5m", "AAUSDT", 600, 120, 1), ("1d", "AAUSDT", 0, 96, 1),
        ("5m", "OLDUSDT", 600 - 101 * 3600, 5, 1), ("1d", "OLDUSDT", 0, 5, 1), ("5m", "NODAYUSDT", 600, 5, 1),
        ("5m", "ZEROUSDT", 600, 5, 1), ("1d", "ZEROUSDT", 0, 0, 1)])
    got = {r.coin: (r.price, r.price_change) for r in serving.coin_prices(df).collect()}
    assert got == {"AA": (120.0, 25.0), "ZERO": (5.0, None)}


def test_latest_rows_both_ways(spark):
    df = signals(spark, [("4h", "A", t, t, 1) for t in range(5)] + [("4h", "B", 2, 7, 1)])
    by_join = {(r.symbol, r.bar_start, r.close) for r in serving.latest_rows_by_join(df).collect()}
    by_aggregate = {(r.symbol, r.bar_start, r.close) for r in serving.latest_rows(df, ["close"]).collect()}
    assert by_join == by_aggregate == {("A", 4, 4.0), ("B", 2, 7.0)}


def test_latest_predictions_are_rounded_on_the_binary_value(spark):
    rows = [("A", 5, 1.0000005, 1.0, 0.0, 0.0, 0.0, 0.0), ("B", 5, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("A", 4, 9.0, 9.0, 0.0, 0.0, 0.0, 0.0)]
    got = {r.symbol: r for r in serving.latest_predictions(spark.createDataFrame(rows, PREDICTIONS)).collect()}
    assert got["A"].prediction == round(1.0000005, 6) and got["A"].date == "5"
    assert got["A"].price_change == round((1.0000005 - 1.0) / 1.0 * 100, 6)
    assert got["B"].price_change is None and len(got) == 2


PATTERN_ROWS = [
    ("X", "A", 1, 10, 20, "[[1 2]\n [3 4]]", "[1 2]", "[[0 1] [1 0]]", "[0 1]"),
    ("W", "A", 2, 10, 20, "[[5 6] [7 8]]", "[1 2]", "[[0 1] [1 0]]", "[0 1]"),
    ("X", "A", 1, 9, 20, "[[1 2]]", "[1 2]", "[[0 1]]", "[0 1]"),
    ("X", "B", 1, 99, 20, "[[1 2]]", "[1 2]", "[[0 1]]", "[0 1]"),
]


def patterns(spark):
    names = ["symbol1", "symbol2", "start_date1", "start_date2", "end_date", "prices1", "prices2", "s1_norm", "s2_norm"]
    return spark.createDataFrame(PATTERN_ROWS, names).select(*PATTERNS.names)


def test_patterns_of_a_pair(spark):
    assert [tuple(r) for r in original_pairs(patterns(spark)).collect()] == [("A", "10"), ("B", "99")]
    got = pattern_detail(patterns(spark), "A").collect()
    assert [r.similar_symbols for r in got] == [["W"], ["X"]]
    assert got[1].similar_prices == [[1.0, 2.0], [3.0, 4.0]] and got[1].original_prices == [1.0, 2.0]
    assert (got[0].original_start_date, got[0].similar_start_dates, got[0].similar_end_dates) == ("10", ["2"], ["20"])
    assert pattern_detail(patterns(spark), "nobody").isEmpty()
    assert pattern_detail(patterns(spark), "A' or '1'='1").isEmpty()
