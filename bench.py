"""Headline queries, timed end to end. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tapeflow.plans import catalog  # noqa: E402
from tapeflow.session import get_spark  # noqa: E402

HEADLINE = [
    "simple_moving_averages", "all_indicators", "regime_labels", "regime_days_by_symbol", "market_breadth",
    "relative_strength", "fifo_matched_trades", "pnl_summary", "back_adjusted_bars", "checked_triggers",
    "strategy_trades", "trade_metrics", "signals", "features_swing", "tick_bars",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEM", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/lineitem.parquet").count()  # start the session outside the timings
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
