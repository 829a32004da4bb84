import datetime
import random

import pytest
from pyspark.sql import functions as F

from tapeflow.operators import lots

DAY = datetime.date(2020, 1, 1)


def queue(trades):
    """First-in first-out matching with a plain queue, one symbol."""
    buys = [[t["quantity"], t] for t in trades if t["trade_type"] == "BUY"]
    out = []
    for s in (t for t in trades if t["trade_type"] == "SELL"):
        left = s["quantity"]
        while left > 0 and buys:
            q = min(buys[0][0], left)
            out.append((s["symbol"], buys[0][1]["trade_date"], buys[0][1]["price"], s["trade_date"], s["price"], q))
            buys[0][0] -= q
            left -= q
            if buys[0][0] == 0:
                buys.pop(0)
    return out, [(b[1]["symbol"], b[1]["price"], b[0]) for b in buys]


@pytest.mark.parametrize("seed,sizes", [(1, (1, 50)), (2, (1, 3)), (3, (1, 5000))])
def test_matches_equal_a_queue(spark, seed, sizes):
    rnd = random.Random(seed)
    rows = []
    # One symbol holds most trades; sizes range from single shares to blocks.
    for sym, n in (("HOT", 900), ("A", 60), ("B", 7), ("C", 1)):
        for i in range(n):
            rows.append({"symbol": sym, "trade_date": DAY + datetime.timedelta(days=rnd.randrange(30)),
                         "trade_type": rnd.choice(["BUY", "SELL"]), "quantity": rnd.randint(*sizes) if rnd.random() < 0.95 else sizes[1] * 40,
                         "price": round(rnd.uniform(10, 20), 2), "trade_id": f"{i:06d}", "order_execution_time": ""})
    df = spark.createDataFrame(rows)
    want, left = [], []
    for sym in ("HOT", "A", "B", "C"):
        own = sorted((r for r in rows if r["symbol"] == sym), key=lambda r: (r["trade_date"], r["trade_id"]))
        m, o = queue(own)
        want += m
        left += o
    got = [tuple(r) for r in lots.fifo_matches(df).select("symbol", "entry_date", "entry_price", "exit_date", "exit_price", "qty").collect()]
    assert sorted(got) == sorted(want)
    open_ = [tuple(r) for r in lots.open_lots(df).select("symbol", "price", "open_qty").collect()]
    assert sorted(open_) == sorted(left)
    bought = df.filter("trade_type = 'BUY'").agg(F.sum("quantity")).first()[0]
    assert sum(g[5] for g in got) + sum(o[2] for o in open_) == bought


def test_no_shuffle_by_symbol_alone(spark):
    df = spark.createDataFrame([("A", DAY, "BUY", 1, 1.0, "1", "")],
                               "symbol string, trade_date date, trade_type string, quantity bigint, price double, trade_id string, order_execution_time string")
    plan = lots.fifo_matches(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
