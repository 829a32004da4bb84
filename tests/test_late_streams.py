"""Opening ranges and drawdown alerts from streams whose rows come out of order, in several cuts, and too late."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from tapeflow.streaming import alerts, opening_range

T0 = datetime.datetime(2024, 3, 4, 9, 15)


def dealt(spark, rows, schema, path, files, per_batch):
    """Rows written to files in the given order, one after the other, read back as a stream."""
    for i, part in enumerate(files):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def run(spark, stream, tmp_path, name):
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


BARS = "symbol string, bar_start timestamp, high double, low double, close double"


def bars():
    r, out = random.Random(3), []
    for s in ("A", "B", "C"):
        for day in (0, 1, 3):
            x = 100.0
            for i in range(-2, 78):
                if r.random() < 0.1:
                    continue
                x *= 1 + r.gauss(0, 0.004)
                out.append((s, T0 + datetime.timedelta(days=day, minutes=5 * i), x * 1.002, x * 0.998, x))
    return out + [("~", T0 + datetime.timedelta(days=60), 1.0, 1.0, 1.0)]


@pytest.mark.parametrize(("seed", "n", "per_batch"), [(1, 5, 1), (2, 3, 2)])
def test_opening_ranges_of_shuffled_bars_equal_the_batch(spark, tmp_path, seed, n, per_batch):
    rows = bars()
    order = list(range(len(rows) - 1))
    random.Random(seed).shuffle(order)
    files = [order[k::n] for k in range(n)] + [[len(rows) - 1]]
    stream = opening_range.stream_opening_range(dealt(spark, rows, BARS, str(tmp_path / "in"), files, per_batch), lateness="10 days")
    got = run(spark, stream, tmp_path, "out")
    want = opening_range.opening_range(spark.createDataFrame(rows[:-1], BARS)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("entry").count() > 0


def test_a_range_bar_of_a_later_batch_counts(spark, tmp_path):
    """The breakout bar comes first, the range's highest bar later."""
    rows = [("A", T0 + datetime.timedelta(minutes=m), h, h - 1, h) for m, h in ((0, 10.0), (20, 11.0), (25, 13.0), (5, 12.0))] + [("A", T0 + datetime.timedelta(days=9), 1.0, 1.0, 1.0)]
    stream = opening_range.stream_opening_range(dealt(spark, rows, BARS, str(tmp_path / "in"), [[0, 1], [2], [3], [4]], 1), lateness="1 day")
    got = {r.close: (r.orb_high, r.entry) for r in run(spark, stream, tmp_path, "out").collect()}
    assert got == {11.0: (12.0, False), 13.0: (12.0, True)}


TICKS = "symbol string, ts timestamp, price double"


def ticks():
    r = random.Random(8)
    return [(r.choice("AB"), T0 + datetime.timedelta(seconds=r.randrange(4 * 86400), microseconds=r.randrange(10**6)), round(r.uniform(80, 120), 2)) for _ in range(400)] + [
        ("~", T0 + datetime.timedelta(days=60), 1.0)]


@pytest.fixture(scope="module")
def positions(spark):
    return spark.createDataFrame([("H1", "A", "long_term", 100.0, True), ("H2", "A", "long_term", 118.0, True), ("H3", "B", "swing", 100.0, True), ("H4", "B", "long_term", 105.0, True)],
                                 "holding_id string, symbol string, timeframe string, avg_cost double, is_active boolean")


@pytest.mark.parametrize(("seed", "n", "per_batch"), [(1, 6, 1), (2, 4, 3), (3, 1, 1)])
def test_alerts_after_any_cut_equal_the_batch(spark, tmp_path, positions, seed, n, per_batch):
    rows = ticks()
    order = list(range(len(rows) - 1))
    random.Random(seed).shuffle(order)
    stream = alerts.drawdown_stream(dealt(spark, rows, TICKS, str(tmp_path / "in"), [order[k::n] for k in range(n)] + [[len(rows) - 1]], per_batch), positions, "10 days")
    got = run(spark, stream, tmp_path, "out")
    want = alerts.drawdown_batch(spark.createDataFrame(rows[:-1], TICKS), positions)
    assert sorted(map(tuple, got.select("holding_id", "symbol", "day", "ts").collect())) == sorted(map(tuple, want.select("holding_id", "symbol", "day", "ts").collect()))
    assert got.count() >= 10 and got.where("drawdown_pct > -10").count() == 0


def test_late_rows_are_kept(spark, tmp_path, positions):
    """Taken and late rows are all rows, and the alerts are those of the rows taken."""
    rows = ticks()
    order = list(range(len(rows) - 1))
    random.Random(5).shuffle(order)
    files = [order[k::4] for k in range(4)] + [[len(rows) - 1]]
    source = dealt(spark, rows, TICKS, str(tmp_path / "in"), files, 1)
    out = str(tmp_path / "late")
    alerts.run_late_rows(source, "ts", 86_400_000, out, out + "-ck").awaitTermination()
    late = {tuple(r) for r in spark.read.parquet(f"{out}/late").select("symbol", "ts", "price").collect()}
    newest, want = None, set()
    for f in files:
        if newest is not None:
            want |= {rows[k] for k in f if rows[k][1] <= newest.replace(microsecond=newest.microsecond // 1000 * 1000) - datetime.timedelta(days=1)}
        newest = max([rows[k][1] for k in f] + ([newest] if newest else []))
    assert late == want and 50 < len(late) < 400
    got = run(spark, alerts.drawdown_stream(source, positions, "1 day"), tmp_path, "out")
    taken = alerts.drawdown_batch(spark.createDataFrame([r for r in rows[:-1] if r not in late], TICKS), positions)
    assert sorted(map(tuple, got.select("holding_id", "symbol", "day", "ts").collect())) == sorted(map(tuple, taken.select("holding_id", "symbol", "day", "ts").collect()))


def most_states(stream, tmp_path, name):
    out = str(tmp_path / name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])


def test_days_share_the_state_of_their_symbol(spark, tmp_path, positions):
    """The number of groups, each a call of its own, is that of symbols and holdings, not of their days."""
    rows = bars()
    source = dealt(spark, rows, BARS, str(tmp_path / "bars"), [list(range(len(rows) - 1)), [len(rows) - 1]], 1)
    assert most_states(opening_range.stream_opening_range(source, lateness="10 days"), tmp_path, "ranges") <= 4
    rows = ticks()
    source = dealt(spark, rows, TICKS, str(tmp_path / "ticks"), [list(range(len(rows) - 1)), [len(rows) - 1]], 1)
    assert most_states(alerts.drawdown_stream(source, positions, "10 days"), tmp_path, "alerts") <= 3
