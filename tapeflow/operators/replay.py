"""Strategy replay: rules over the panel, positions walked per symbol, trade metrics.

Entry, exit, stop and target of every strategy are columns of the panel, one
pass for all strategies. Only the position walk runs in Python, per symbol
(one row per date), on those columns; it emits trades, not bars.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.rules import Panel, entry_signal, exit_signal, look_backs
from tapeflow.functions.windows import latest, running, series
from tapeflow.operators import indicators as I
from tapeflow.operators import packs
from tapeflow.operators import regimes as R
from tapeflow.operators.strategies import STRATEGIES, rule_parts, stop_loss, target_price
from tapeflow.params import DEFAULTS
from tapeflow.session import stored

TRADE_SCHEMA = ("strategy_id string, symbol string, entry_date date, exit_date date, entry_price double, "
                "exit_price double, pnl_pct double, pnl_inr double, holding_days int, exit_reason string, cycle string")
REASONS = ("stop_loss", "target", "signal")


def rule_panel(bars: DataFrame, index: DataFrame, stocks: DataFrame, sectors: DataFrame,
               fundamentals: DataFrame | None = None, last: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Everything a seeded rule can name, one row per (symbol, date), or only the ``last`` rows of each symbol, or of the symbols in ``only``.

    ``index`` (date, nifty200_close) and ``sectors`` (date, sector, close) give
    relative strength and the sector regime; stock labels come from the bars.
    What compares symbols moves as little as it needs (``_ranked``) and is stored;
    it then meets the bars in one shuffle by symbol, which all that follows shares.
    The indicator pass also makes the past values that the seeded rules look back on,
    so no window follows it: its wide rows are never written to disk.
    The rows of a partition are whole series in order of date.
    """
    ranked = stored(_ranked(bars, index, stocks, sectors, fundamentals), "ranked")
    p = bars.select(*I.BAR_COLUMNS, F.lit(None).cast(ranked.schema["_rank"].dataType).alias("_rank"), F.lit(True).alias("_bar"))
    p = p.unionByName(ranked.withColumn("_bar", F.lit(False)), allowMissingColumns=True)
    if only is not None:
        p = p.join(F.broadcast(only), "symbol", "left_semi")
    if fundamentals is not None:
        p = R.as_of_latest(p, fundamentals, ["symbol"], "date", "period_end", ["pe_ratio", "roe", "revenue_growth"]).drop("period_end")
    same = Window.partitionBy("symbol", "date", "close")
    # A bar has a row per row of its symbol in ``stocks``; equal bars share theirs.
    each = F.floor(F.size("_ranks") / F.col("_bars")).cast("int")
    p = p.withColumns({"_at": F.row_number().over(same.orderBy(F.desc("_bar"))), "_ranks": F.collect_list("_rank").over(same), "_bars": F.count_if("_bar").over(same)})
    p = p.filter("_bar").withColumn("_ranks", F.slice("_ranks", (F.col("_at") - 1) * each + 1, each))
    more = [c for c in ("pe_ratio", "roe", "revenue_growth") if c in p.columns]
    p = R.label_stocks(p).select(*I.BAR_COLUMNS, "cycle", *more, F.explode("_ranks").alias("_rank")).select("*", "_rank.*").drop("_rank")
    lab = R.label(sectors.select(F.lit("sector").alias("scope"), F.col("sector").alias("scope_id"), "date", "close"))
    # One row per sector and calendar day on the broadcast side.
    lab = F.broadcast(lab.select(F.col("scope_id").alias("sector"), "date", F.col("cycle").alias("sector_cycle")))
    p = p.join(lab, ["sector", "date"], "left").withColumn("sector_cycle", F.coalesce("sector_cycle", F.lit("neutral")))
    names = (*p.columns, *I.INDICATORS, *I.PAST_COLUMNS, "rn")
    return I.panel_indicators(p, last=last, past=True, looks=look_backs(STRATEGIES, names))


def _ranked(bars: DataFrame, index: DataFrame, stocks: DataFrame, sectors: DataFrame, fundamentals: DataFrame | None) -> DataFrame:
    """(symbol, date, close) of symbols with enough bars and, in ``_rank``, their sector, relative strength and what compares them with their sector.

    The groups are the symbols of one sector on one date, bounded by the number
    of listed symbols whatever the length of the history.
    """
    w = series()
    p = bars.select("symbol", "date", "close")
    if fundamentals is not None:
        p = R.as_of_latest(p, fundamentals, ["symbol"], "date", "period_end", ["pe_ratio"]).drop("period_end")
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    p = p.withColumns({"_n": n, "_own": F.try_divide(F.col("close"), F.lag("close", 20).over(w)) - 1})
    p = p.filter(F.col("_n") >= DEFAULTS.min_bars_indicators).drop("_n")
    # One row per calendar day on the broadcast side.
    p = p.join(F.broadcast(I.index_returns(index)), "date", "left")
    p = p.withColumn("rs_nifty200", F.try_divide("_own", "_idx_ret")).drop("_own", "_idx_ret")
    p = R.with_dimension(p, stocks, "symbol", {"sector": "Unknown"})
    rs = F.col("rs_nifty200")
    by = Window.partitionBy("sector", "date")
    if "pe_ratio" in p.columns:
        p = p.withColumn("pe_vs_sector", F.coalesce("pe_ratio", F.lit(20.0)) / F.coalesce(F.avg("pe_ratio").over(by), F.lit(20.0))).drop("pe_ratio")
    ranked = Window.partitionBy("sector", "date", rs.isNull()).orderBy(rs)
    p = p.withColumn("rs_percentile", F.when(rs.isNotNull(), F.percent_rank().over(ranked) * 100))
    key = ("symbol", "date", "close")
    return p.select(*key, F.struct(*[c for c in p.columns if c not in key]).alias("_rank"))


def signal_columns(panel: DataFrame, docs: list[dict], p=DEFAULTS) -> DataFrame:
    """Per strategy i: entry_i, exit_i and, where it enters, stop_i and target_i."""
    ctx = Panel.of(panel)
    cols = {}
    for i, doc in enumerate(docs):
        cols[f"entry_{i}"], cols[f"exit_{i}"] = entry_signal(doc, ctx), exit_signal(doc, ctx)
    out = panel.withColumns(cols)
    price = F.col("close") * (1 + p.slippage_pct)
    cols = {}
    for i, doc in enumerate(docs):
        parts = rule_parts(doc)
        stop = stop_loss(parts, price, F.col("close"))
        cols[f"stop_{i}"] = F.when(F.col(f"entry_{i}"), stop)
        cols[f"target_{i}"] = F.when(F.col(f"entry_{i}"), target_price(parts, price, stop))
    keep = ["symbol", "date", "close", "cycle"]
    names = [f"{k}_{i}" for i in range(len(docs)) for k in ("entry", "exit", "stop", "target")]
    return out.withColumns(cols).select(*keep, *names)


def walk(close, entry, exit_, stop, target, trail: float | None, warmup: int):
    """Trades of one series as (entry row, exit row, exit level, reason) tuples.

    Tests on the close, in the order stop, target, exit rule. The next entry is
    looked for from the row after the exit. A trailing stop follows the highest
    close since the entry. A position still open at the end is dropped.
    """
    entries = np.flatnonzero(entry)
    n, pos, trades = len(close), warmup, []
    while True:
        k = int(np.searchsorted(entries, pos))
        if k == len(entries):
            return trades
        e = int(entries[k])
        level, lo, size, found = stop[e], e + 1, 64, False
        while lo < n:
            hi = min(n, lo + size)
            c = close[lo:hi]
            if trail is None:
                levels = np.full(hi - lo, level)
            else:
                path = np.maximum.accumulate(np.concatenate(([level], c * (1 - trail))))
                levels, level = path[:-1], path[-1]
            at_stop, at_target = c <= levels, c >= target[e]
            hit = at_stop | at_target | exit_[lo:hi]
            if hit.any():
                j = int(hit.argmax())
                if at_stop[j]:
                    trades.append((e, lo + j, levels[j], 0))
                elif at_target[j]:
                    trades.append((e, lo + j, target[e], 1))
                else:
                    trades.append((e, lo + j, c[j], 2))
                pos, found = lo + j + 1, True
                break
            lo, size = hi, size * 4
        if not found:
            return trades


BITS = 62  # flags in one long


def bits(flags: list[Column]) -> Column:
    """Flags as bits of an array of longs."""
    words = [[F.when(f, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, f in enumerate(flags[lo:lo + BITS])] for lo in range(0, len(flags), BITS)]
    return F.array(*[reduce(lambda a, b: a.bitwiseOR(b), w) for w in words])


def _packed(signals: DataFrame, n: int) -> DataFrame:
    """Flags of all strategies as bits, and their levels only on rows where one enters: little goes to Python."""
    levels = F.array(*[F.col(f"{k}_{i}") for k in ("stop", "target") for i in range(n)])
    out = signals.select("symbol", "date", "close", "cycle", *[bits([F.col(f"{k}_{i}") for i in range(n)]).alias(k) for k in ("entry", "exit")], levels.alias("levels"))
    return out.withColumn("levels", F.when(F.exists("entry", lambda b: b != 0), F.col("levels")))


def trade_rows(t: pa.Table, close: np.ndarray, found: list[tuple[str, list]], p) -> pa.Table:
    """Closed trades of a series in the columns of ``TRADE_SCHEMA``, from (strategy, what ``walk`` returned) pairs."""
    ids = [sid for sid, trades in found for _ in trades]
    rows = [r for _, trades in found for r in trades]
    e, x, why = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1, 3))
    bought = close[e] * (1 + p.slippage_pct)
    sold = np.array([r[2] for r in rows], dtype=float) * (1 - p.slippage_pct)
    days = t.column("date").cast(pa.int32()).to_numpy()
    qty = p.trade_capital * p.position_pct / bought
    cols = [pa.array(ids, pa.string()), t.column("symbol").take(pa.array(e)), t.column("date").take(pa.array(e)),
            t.column("date").take(pa.array(x)), pa.array(bought), pa.array(sold),
            pa.array((sold - bought) / bought * 100), pa.array((sold - bought) * qty - 2 * p.brokerage),
            pa.array((days[x] - days[e]).astype(np.int32)),
            pa.array([REASONS[i] for i in why], pa.string()), t.column("cycle").take(pa.array(x))]
    return pa.table(cols, names=[f.split()[0] for f in TRADE_SCHEMA.split(", ")])


def by_series(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str, whole: bool = False) -> DataFrame:
    """What ``run`` makes of each symbol's rows in order of date, those without a date last. If partitions hold ``whole`` series already, rows stay where they are."""
    def each(batches):
        for t in packs.one_by_one(batches):
            yield from run(t.sort_by("date") if t.column("date").null_count else t).to_batches()

    if not whole:
        rows = rows.repartition("symbol").sortWithinPartitions("symbol", "date")
    return rows.mapInArrow(each, schema)


def replay(signals: DataFrame, docs: list[dict], p=DEFAULTS, whole: bool = False) -> DataFrame:
    """Walk all strategies over each symbol's signal columns; one row per closed trade. ``whole``: see ``by_series``."""
    trails = []
    for doc in docs:
        sl = doc.get("stoploss_rules", {})
        trails.append(sl.get("trail_pct", 7) / 100 if sl.get("trailing") else None)
    ids = [d["strategy_id"] for d in docs]

    def run(t: pa.Table) -> pa.Table:
        close = t.column("close").to_numpy()
        found = []
        if len(close) >= p.min_bars_replay:
            n = len(ids)
            flags = {k: pc.list_flatten(t.column(k)).to_numpy().reshape(len(close), -1) for k in ("entry", "exit")}
            rows = np.flatnonzero(flags["entry"].any(1))
            levels = np.full((2 * n, len(close)), np.nan)
            levels[:, rows] = pc.list_flatten(t.column("levels").drop_null()).to_numpy(zero_copy_only=False).reshape(-1, 2 * n).T
            for i in range(n):
                entry, leave = ((flags[k][:, i // BITS] >> (i % BITS) & 1).astype(bool) for k in ("entry", "exit"))
                if not entry.any():
                    continue
                found.append((ids[i], walk(close, entry, leave, levels[i], levels[n + i], trails[i], p.warmup_rows)))
        return trade_rows(t, close, found, p)

    return by_series(_packed(signals, len(ids)), run, TRADE_SCHEMA, whole)


def backtest(panel: DataFrame, docs: list[dict], p=DEFAULTS, whole: bool = False) -> DataFrame:
    """Closed trades of the documents. ``whole``: the panel is as ``rule_panel`` leaves it, and its rules look back on columns only."""
    return replay(signal_columns(panel, docs, p), docs, p, whole)


def trade_metrics(trades: DataFrame, p=DEFAULTS, min_trades: int | None = None) -> DataFrame:
    """Metrics per (strategy_id, symbol) with enough trades, and the quality gate."""
    key = ["strategy_id", "symbol"]
    w = series(*key, order="exit_date")
    equity = p.trade_capital + F.sum("pnl_inr").over(running(w))
    t = trades.withColumn("_eq", equity)
    t = t.withColumn("_peak", F.max("_eq").over(running(w)))
    r, inr = F.col("pnl_pct"), F.col("pnl_inr")
    zero = F.lit(0.0)
    down_sd = F.stddev_pop(F.when(r < 0, r))
    gain, loss = F.sum(F.when(inr > 0, inr).otherwise(0.0)), F.sum(F.when(inr < 0, -inr).otherwise(0.0))
    year = float(np.sqrt(252))
    agg = t.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(r > 0).alias("winning_trades"),
        F.count_if(r <= 0).alias("losing_trades"), F.avg(r).alias("_mean"), F.stddev_pop(r).alias("_sd"),
        down_sd.alias("_dsd"), F.max((F.col("_peak") - F.col("_eq")) / F.col("_peak")).alias("_dd"),
        gain.alias("_gain"), loss.alias("_loss"), F.sum(inr).alias("_sum"),
        F.coalesce(F.avg(F.when(r > 0, r)), zero).alias("avg_win_pct"),
        F.coalesce(F.avg(F.when(r <= 0, r)), zero).alias("avg_loss_pct"))
    agg = agg.filter(F.col("total_trades") >= (p.min_trades if min_trades is None else min_trades))
    m, sd, dsd = F.col("_mean"), F.col("_sd"), F.coalesce("_dsd", F.lit(1e-9))
    win = F.col("winning_trades") / F.col("total_trades")
    sharpe = F.when(sd > 0, m / sd * year).otherwise(0.0)
    out = agg.select(
        *key, "total_trades", "winning_trades", "losing_trades",
        F.bround(win, 4).alias("win_rate"), F.bround(sharpe, 4).alias("sharpe_ratio"),
        F.bround(F.when(dsd > 0, m / dsd * year).otherwise(0.0), 4).alias("sortino_ratio"),
        F.bround(F.col("_dd") * 100, 4).alias("max_drawdown"),
        F.bround(F.when(F.col("_loss") > 0, F.col("_gain") / F.col("_loss")).otherwise(F.col("_gain")), 4).alias("profit_factor"),
        F.bround(F.col("_sum") / p.trade_capital * 100, 4).alias("total_return"),
        F.bround("avg_win_pct", 4).alias("avg_win_pct"), F.bround("avg_loss_pct", 4).alias("avg_loss_pct"),
        F.bround(m, 4).alias("expectancy"),
        ((sharpe >= p.gate_sharpe) & (win >= p.gate_win_rate)
         & (F.col("total_trades") >= p.gate_min_trades)).alias("passes_gates"))
    return out


def cycle_breakdown(trades: DataFrame) -> DataFrame:
    """Metrics per (strategy_id, symbol, cycle); cycles without trades are absent."""
    r = F.col("pnl_pct")
    sd = F.stddev_pop(r)
    return trades.groupBy("strategy_id", "symbol", "cycle").agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.bround(F.count_if(r > 0) / F.count(F.lit(1)), 4).alias("win_rate"),
        (F.avg(r) / F.when(sd == 0, 1e-9).otherwise(sd) * float(np.sqrt(252))).alias("sharpe"),
        F.bround(F.avg(r), 4).alias("avg_return")).withColumn("sharpe", F.bround("sharpe", 4))


def result_rows(trades: DataFrame, docs: list[dict], from_date: str, to_date: str, p=DEFAULTS) -> DataFrame:
    """Backtest result table: one row of metrics per run. Cycles and trades are long tables of their own
    (``cycle_breakdown``, ``trade_log``) that share the run id."""
    tf = F.create_map(*[F.lit(x) for doc in docs for x in (doc["strategy_id"], doc["timeframes"][0])])
    return with_run_id(trade_metrics(trades, p), from_date, to_date).withColumn("timeframe", tf[F.col("strategy_id")])


def with_run_id(rows: DataFrame, from_date: str, to_date: str) -> DataFrame:
    """Period and id of the run of each (strategy_id, symbol)."""
    return (rows.withColumn("from_date", F.lit(from_date).cast("date")).withColumn("to_date", F.lit(to_date).cast("date"))
            .withColumn("run_id", F.substring(F.sha2(F.concat_ws("|", "strategy_id", "symbol", "from_date", "to_date"), 256), 1, 12)))


def trade_log(trades: DataFrame, from_date: str, to_date: str, n: int | None = None) -> DataFrame:
    """Trades with their run id; with ``n`` only the last n of each run."""
    out = trades if n is None else latest(trades, ["strategy_id", "symbol"], ["exit_date", "entry_date"], n)
    return with_run_id(out, from_date, to_date)


def strategy_rollup(metrics: DataFrame, attempted: DataFrame, p=DEFAULTS) -> DataFrame:
    """Mean metrics per strategy over its symbols.

    ``attempted`` (strategy_id, symbols) holds how many symbols were run;
    those without a metrics row count as failed.
    """
    a = metrics.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("ok"), F.avg("sharpe_ratio").alias("avg_sharpe"), F.avg("win_rate").alias("avg_win_rate"))
    out = attempted.join(a, "strategy_id", "left")
    ok = F.coalesce("ok", F.lit(0))
    gate = (F.coalesce("avg_sharpe", F.lit(0.0)) >= p.gate_sharpe) & (F.coalesce("avg_win_rate", F.lit(0.0)) >= p.gate_win_rate)
    return out.select("strategy_id", ok.alias("ok"), (F.col("symbols") - ok).alias("failed"),
                      F.coalesce("avg_sharpe", F.lit(0.0)).alias("avg_sharpe"),
                      F.coalesce("avg_win_rate", F.lit(0.0)).alias("avg_win_rate"), gate.alias("is_active"))


def explore(results: DataFrame, strategy_id=None, timeframe=None, min_sharpe=None, limit: int | None = None) -> DataFrame:
    """Best results first, missing Sharpe last; all of them without ``limit``."""
    out = results
    if strategy_id is not None:
        out = out.filter(F.col("strategy_id") == strategy_id)
    if timeframe is not None:
        out = out.filter(F.col("timeframe") == timeframe)
    if min_sharpe is not None:
        out = out.filter(F.col("sharpe_ratio") >= min_sharpe)
    out = out.orderBy(F.desc_nulls_last("sharpe_ratio"), "strategy_id", "symbol")
    return out if limit is None else out.limit(limit)
