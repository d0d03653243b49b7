"""Headline queries, timed over whole results. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barwright.plans.catalogue import CATALOGUE  # noqa: E402
from barwright.session import build_session  # noqa: E402

HEADLINE = (
    "ingest_normalize", "insert_ignore_merge", "bars_multi_interval", "bars_many_symbols", "rolling_extremes_step",
    "signal_seed_every_bar", "signal_step_once", "signals_full", "signals_many_symbols", "signals_restart",
    "low_watermarks", "forecast_next", "forecast_many_symbols", "coin_prices", "top_over_sold", "rsi_change_daily",
    "pattern_detail", "predictions_latest", "stream_bars", "stream_signals",
)


def run(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "barwright-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # start the Python workers and load the classes before the clock runs
    run(CATALOGUE["signals_full"], spark, sf_dir)
    seconds = {name: round(run(CATALOGUE[name], spark, sf_dir), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
