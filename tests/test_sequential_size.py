"""Orders filled one after another: running sums and short folds against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tapeflow.operators import sizing
from tapeflow.params import DEFAULTS as P

SCHEMA = "trigger_id string, strategy_id string, timeframe string, price double, confidence double"


def loop(orders, deployed):
    spent, out = {}, {}
    for tid, s, tf, price, conf in sorted(orders):
        capital = P.total_capital * P.timeframe_ratios[tf]
        left = max(0.0, capital - deployed.get(s, 0.0))
        value = min(capital * (1 - P.reserve_pct), P.max_per_stock, max(0.0, left - spent.get(s, 0.0))) * (1.0 if conf is None else conf)
        net = value - (value * P.slippage_pct + P.brokerage)
        n = int(net // (price * (1 + P.slippage_pct))) if price and price > 0 and net > 0 else 0
        spent[s] = spent.get(s, 0.0) + n * (price or 0)
        out[tid] = n
    return out


def check(spark, orders, deployed, chunk):
    held = spark.createDataFrame([(s, 1, v, True) for s, v in deployed.items()], "strategy_id string, qty int, avg_cost double, is_active boolean")
    got = sizing.sequential_size(spark.createDataFrame(orders, SCHEMA).repartition(3), held, "trigger_id", chunk=chunk)
    found = {r.trigger_id: r.qty for r in got.collect()}
    want = loop(orders, deployed)
    assert found == want
    return want


@pytest.mark.parametrize(("seed", "chunk"), [(1, 3), (2, 50), (3, 10_000)])
def test_random_orders(spark, seed, chunk):
    r = random.Random(seed)
    orders = [(f"t{i:05d}", r.choice(["S1", "S1", "S2", "S3"]), r.choice(list(P.timeframe_ratios)), r.choice([None, -5.0, 0.0, r.uniform(1, 9000), r.uniform(1, 900_000)]),
               r.choice([None, 1.0, 0.03, 0.4])) for i in range(120)]
    want = check(spark, orders, {"S2": 900_000.0, "S3": 5_000_000.0}, chunk)
    assert sum(n > 0 for n in want.values()) > 5 and not any(want[o[0]] for o in orders if o[1] == "S3")


def test_a_timeframe_runs_out_while_another_goes_on(spark):
    tf = sorted(P.timeframe_ratios, key=P.timeframe_ratios.get)
    orders = [(f"t{i:03d}", "S1", tf[0] if i % 2 else tf[-1], 100.0 + i, 0.05) for i in range(60)]
    want = check(spark, orders, {}, 4)
    assert any(want[o[0]] for o in orders[-30:])


def test_empty(spark):
    held = spark.createDataFrame([], "strategy_id string, qty int, avg_cost double, is_active boolean")
    assert sizing.sequential_size(spark.createDataFrame([], SCHEMA), held, "trigger_id").count() == 0


def test_a_million_orders_of_one_strategy(spark):
    """Spread over many tasks; after the capital is gone, orders leave the rounds."""
    n = 1_000_000
    orders = spark.range(n).select(F.format_string("t%07d", "id").alias("trigger_id"), F.lit("S1").alias("strategy_id"), F.lit("long_term").alias("timeframe"),
                                   (F.lit(0.5) + F.col("id") % 97 / 10).alias("price"), F.lit(5e-4).alias("confidence"))
    held = spark.createDataFrame([], "strategy_id string, qty int, avg_cost double, is_active boolean")
    got = sizing.sequential_size(orders, held, "trigger_id").filter("qty > 0").select("trigger_id", "qty").collect()
    plain = loop([(f"t{i:07d}", "S1", "long_term", 0.5 + i % 97 / 10, 5e-4) for i in range(60_000)], {})
    assert {r.trigger_id: r.qty for r in got if r.trigger_id < "t0060000"} == {k: v for k, v in plain.items() if v}
    assert len(got) > 10_000
