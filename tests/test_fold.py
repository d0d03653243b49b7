import pytest
from pyspark.sql import functions as F

from barwright.operators import fold
from barwright.operators import indicators as ind
from barwright.operators.bars import resample
from barwright.operators.seeds import seed_at
from barwright.operators.steps import step_once, symbols_to_seed, symbols_to_step
from barwright.schemas import SIGNALS
from barwright.sources import market
from helpers import SIGNAL_KEY, assert_same, candle, candles, walk

ROWS = (
    walk("LONG", range(260), 1)
    + walk("GAPS", [s for s in range(260) if s % 13 and not 100 < s < 140], 2)
    + walk("QUIET", range(260), 3, flat=0.7)
    + walk("DEAD", range(200), 4, flat=1.0)
    + walk("LATE", range(230, 260), 5)
)


@pytest.fixture(scope="module")
def bars(spark):
    return resample(candles(spark, ROWS), ["5m"]).cache()


@pytest.fixture(scope="module")
def whole(bars):
    return fold.compute_signals(bars)


def test_schema(whole):
    assert whole.schema.names == SIGNALS.names
    assert [f.dataType for f in whole.schema] == [f.dataType for f in SIGNALS]


@pytest.mark.parametrize("block,warmup", [(28, 28), (64, 28), (64, 60), (128, 100)])
def test_blocks_do_not_change_the_result(bars, whole, block, warmup):
    """Warm-ups this short assume wrong states: the edges must be found and run again."""
    assert_same(fold.compute_signals(bars, block=block, warmup=warmup), whole, SIGNAL_KEY, tolerance=1e-10)


def test_wrong_edges_are_repeated_until_they_agree(bars, monkeypatch):
    calls = []
    original = fold._run_blocks
    monkeypatch.setattr(fold, "_run_blocks", lambda *a: calls.append(1) or original(*a))
    fold.compute_signals(bars, block=128, warmup=28)
    assert len(calls) > 1
    calls.clear()
    fold.compute_signals(bars)
    assert len(calls) == 1


def test_a_repair_writes_only_the_blocks_it_runs_again(bars, whole, monkeypatch):
    written = []
    original = fold.materialize

    def counted(df, label):
        out = original(df, label)
        if label.startswith("fold"):
            written.append((label, out.filter("own").select("symbol", "block").distinct().count(), out.filter("own").count()))
        return out

    monkeypatch.setattr(fold, "materialize", counted)
    again = fold.compute_signals(bars, block=64, warmup=28)
    assert_same(again, whole, SIGNAL_KEY, tolerance=1e-10)
    (first, blocks, rows), *repairs = written
    assert first == "fold" and rows == whole.count() and repairs
    for label, some, few in repairs:
        assert label == "fold-again" and 0 < some < blocks and few <= 64 * some
    # blocks that were right stay unwritten: the repairs of all passes together are fewer rows than one whole pass
    assert sum(few for _, _, few in repairs) < rows


def test_long_warmup_needs_no_repetition(spark, monkeypatch):
    bars = resample(candles(spark, walk("A", range(6000), 8) + walk("B", range(3000, 6000), 9)), ["5m"])
    whole = fold.compute_signals(bars)
    calls = []
    original = fold._run_blocks
    monkeypatch.setattr(fold, "_run_blocks", lambda *a: calls.append(1) or original(*a))
    split = fold.compute_signals(bars, block=2048, warmup=fold.WARMUP_SLOTS)
    assert len(calls) == 1
    assert_same(split, whole, SIGNAL_KEY, tolerance=1e-9)


def test_fold_equals_bar_by_bar_seeding_and_stepping(spark):
    """The set-at-a-time pipeline: at each bar, seed the symbols that are not ready and step the others."""
    rows = walk("A", range(8), 1) + walk("B", [0, 1, 2, 4, 5, 6, 7], 2) + walk("C", range(8), 3, flat=0.6)
    bars = ind.with_slot(resample(candles(spark, rows), ["5m"])).cache()
    columns = [name for name in SIGNALS.names if name not in ("update_time", "psar_up", "psar_down", "af")]
    stored = None
    for slot in range(8):
        if stored is None:
            new = seed_at(bars, bars.filter(f"slot = {slot}"))
            new = new.select("slot", *columns)
        else:
            seeds = symbols_to_seed(bars, stored, slot).withColumn("slot", F.lit(slot).cast("long"))
            steps = symbols_to_step(bars, stored, slot)
            seeded = seed_at(bars, seeds).select("slot", *columns, "af")
            stepped = step_once(bars.join(steps, ["bar_interval", "symbol"], "left_semi"), stored, slot)
            new = seeded.unionByName(stepped.select("slot", *columns, "af"))
        if "af" not in new.columns:
            new = new.withColumn("af", F.lit("0.02").cast("decimal(3,2)"))
        new = spark.createDataFrame(new.collect(), new.schema)
        stored = new if stored is None else stored.unionByName(new)
    assert_same(stored.drop("slot"), fold.compute_signals(bars.drop("slot")), SIGNAL_KEY, [*columns[3:], "af"], 1e-9)


def test_null_high_in_a_middle_bar(spark):
    rows = [candle("A", 300 * s, 100 + s % 5, 90 + s % 3, 95 + s % 4) for s in range(30)]
    rows[15] = candle("A", 300 * 15, None, 91, 95)
    got = {r.bar_start // 300: r for r in fold.compute_signals(resample(candles(spark, rows), ["5m"])).collect()}
    assert got[14].psar is not None
    # a step from it would spread the unknown values, so the next bar is seeded from what is known
    assert (got[15].tr, got[15].atr14, got[15].atr28) == (None, None, None)
    assert got[15].dm_p == 0.0 and got[15].psar is None
    assert got[16].atr14 is not None and got[16].psar is not None and got[16].af == got[0].af


def test_every_bar_has_one_row_and_rsi_is_bounded(spark, sf_dir):
    bars = resample(market.base_candles(spark, sf_dir, market.symbol_by_user()), ["1h", "1d"])
    signals = fold.compute_signals(bars)
    assert signals.count() == bars.count() == signals.select(*SIGNAL_KEY).distinct().count()
    assert signals.filter("least(rsi7, rsi14) < 0 or greatest(rsi7, rsi14) > 100 + 1e-9 or af < 0.02 or af > 0.2").isEmpty()


def test_windows_and_recursion_share_one_exchange(bars):
    rows = ind.with_slot(bars).withColumns({"fresh": F.lit(True), "carry": fold.no_carry()})
    ready = fold._run_blocks(fold.window_inputs(rows, 128, 28), 128, True)
    plan = ready._jdf.queryExecution().executedPlan().toString()
    above_cache = plan.split("InMemoryTableScan")[0]
    assert above_cache.count("Exchange hashpartitioning") == 1 and above_cache.count("Sort [") == 1
