"""Parameter sweep over strategy templates.

Candidates are drawn from the parameter grid by hash, so a sweep is the same on
every run. A candidate differs from its template only in entry values, stop
multiple and target multiple.
"""

from __future__ import annotations

import copy
import json
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeflow.functions.rules import Panel, condition, exit_signal, operand
from tapeflow.operators import replay as P
from tapeflow.operators.strategies import STRATEGIES, rule_parts, stop_loss
from tapeflow.params import DEFAULTS
from tapeflow.session import stored

# Fixed values: (parameter, minimum, maximum, step) per template.
PARAMETER_SPACES = {
    "EMA Crossover Momentum": [
        ("ema_fast", 6, 15, 1), ("ema_slow", 15, 50, 1), ("adx_threshold", 15, 35, 1),
        ("rsi_min", 45, 60, 1), ("rsi_exit", 70, 80, 1), ("atr_sl_mult", 1.5, 3.0, 0.1),
        ("atr_target_mult", 2.0, 5.0, 0.5), ("volume_min_ratio", 1.0, 2.5, 0.1)],
    "Supertrend Breakout": [
        ("atr_period", 7, 20, 1), ("multiplier", 2.0, 4.5, 0.1), ("volume_min_ratio", 1.0, 2.5, 0.1),
        ("atr_target_mult", 1.5, 4.0, 0.5)],
    "RSI Mean Reversion": [
        ("rsi_entry", 25, 40, 1), ("rsi_exit", 50, 65, 1), ("bb_pct_entry", 0.05, 0.25, 0.05),
        ("atr_sl_mult", 1.0, 2.5, 0.1), ("atr_target_mult", 1.5, 4.0, 0.5)],
    "52-Week High Breakout": [
        ("near_high_threshold", -3.0, 0.0, 0.5), ("volume_min_ratio", 1.5, 3.0, 0.1),
        ("trail_stop_pct", 5.0, 15.0, 0.5), ("adx_min", 15, 30, 1), ("atr_target_mult", 2.0, 6.0, 0.5)],
    "Bollinger Band Squeeze Breakout": [
        ("squeeze_lookback", 60, 180, 10), ("volume_min_ratio", 1.2, 3.0, 0.1), ("rsi_exit", 70, 85, 1),
        ("atr_sl_mult", 1.5, 3.0, 0.1), ("atr_target_mult", 2.0, 5.0, 0.5)],
    "Turtle Trading 20-10": [
        ("entry_period", 15, 30, 1), ("exit_period", 7, 20, 1), ("atr_period", 14, 30, 1),
        ("atr_sl_mult", 1.5, 3.5, 0.1), ("adx_min", 10, 25, 1)],
}

# Entry conditions a parameter replaces, indicator (and operator) -> parameter.
ENTRY_VALUES = (
    ("adx_14", None, "adx_threshold"), ("volume_ratio", None, "volume_min_ratio"),
    ("bb_pct_b", None, "bb_pct_entry"), ("pct_from_52w_high", None, "near_high_threshold"),
    ("rsi_14", "<=", "rsi_entry"), ("rsi_9", "<=", "rsi_entry"))


def candidates(spark: SparkSession, per_template: int = 30, seed: int = 42) -> DataFrame:
    """Rows (candidate_id, template, params map): hash-drawn points of each grid, without duplicates."""
    spaces = [(t, i, n, float(lo), float(step), int(round((hi - lo) / step)) + 1)
              for t, ps in PARAMETER_SPACES.items() for i, (n, lo, hi, step) in enumerate(ps)]
    grid = spark.createDataFrame(spaces, "template string, pos int, param string, lo double, step double, points int")
    text = F.concat_ws("-", F.lit(str(seed)), "template", "param", F.col("k").cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.col("points")
    one = (grid.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_template))))
           .withColumn("value", F.round(F.col("lo") + draw * F.col("step"), 4)))
    c = one.groupBy("template", "k").agg(
        F.sort_array(F.collect_list(F.struct("pos", "param", "value"))).alias("p"))
    c = c.select("template", "k", F.transform("p", lambda x: F.struct(x["param"], x["value"])).alias("p"))
    c = c.dropDuplicates(["template", "p"])
    return c.select(F.concat_ws("#", "template", F.format_string("%03d", "k")).alias("candidate_id"), "template",
                    F.map_from_entries("p").alias("params"), F.transform("p", lambda x: x["value"]).alias("point"))


def build(template: dict, params: dict, candidate_id: str) -> dict:
    """Rule document of a candidate: entry rules only are patched."""
    doc = copy.deepcopy(template)
    doc["strategy_id"] = candidate_id
    doc["parameters"].update(params)
    for c in doc["entry_rules"]["conditions"]:
        for ind, op, name in ENTRY_VALUES:
            if c["indicator"] == ind and op in (None, c["op"]) and name in params:
                c["value"] = params[name]
        if c["op"] == "squeeze_breakout" and "squeeze_lookback" in params:
            c["squeeze_lookback"] = int(params["squeeze_lookback"])
    for name in ("multiplier", "atr_sl_mult"):
        if name in params:
            doc["stoploss_rules"]["multiplier"] = params[name]
    return doc


def candidate_documents(cand: DataFrame) -> list[dict]:
    """Documents of a sweep. A sweep is a bounded list of rule texts, like the catalogue."""
    by_name = {s["name"]: s for s in STRATEGIES}
    rows = cand.select("candidate_id", "template", F.to_json("params").alias("params")).orderBy("candidate_id")
    return [build(by_name[r.template], json.loads(r.params), r.candidate_id) for r in rows.toLocalIterator()]


CELL_PARAMETERS = 3  #: parameters whose cells make a key; a point has 3 ** 3 neighbour cells


def without_near_duplicates(ranked: DataFrame, existing: DataFrame | None = None, close: float = 0.2,
                            share: float = 0.9) -> DataFrame:
    """Drop candidates too close to a better one, or to a stored variant, of the same template.

    Close means: more than ``share`` of the parameters differ by less than
    ``close``. ``rank`` orders candidates within the template; it is unique there.

    Points are compared through a grid with cells as wide as ``close``: two values that differ by less lie in the same or in neighbouring
    cells. If m parameters may differ, they are dealt to m + 1 groups, one of which agrees throughout; a point meets others in the cells of one group
    and their neighbours, on the parameters of the group with the most cells. What meets is compared exactly, so nothing is lost.

    Closeness depends on the point alone, so rows of one point meet others once, and others stand for all their rows by the best rank.
    """
    points = ranked.select("template", "point", "rank")
    others = points if existing is None else points.unionByName(existing.select("template", "point", F.lit(0).cast(ranked.schema["rank"].dataType).alias("rank")))
    others = others.groupBy("template", "point").agg(F.min("rank").alias("rank"))
    points = points.select("template", "point").distinct()
    may_differ = F.size("point") - 1 - F.floor(F.size("point") * F.lit(share) + 1e-9)
    cells = others.select("template", may_differ.alias("miss"), F.posexplode(F.transform("point", lambda v: F.floor(v / close)))) \
        .groupBy("template", "pos", "miss").agg(F.approx_count_distinct("col").alias("n"))
    group = F.pmod("pos", F.greatest(F.col("miss"), F.lit(0)) + 1)
    w = Window.partitionBy("template", "miss", "group").orderBy(F.desc("n"), "pos")  # the parameters of a template
    used = cells.withColumn("group", group).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= CELL_PARAMETERS) \
        .groupBy("template", "miss", "group").agg(F.sort_array(F.collect_list("pos")).alias("places"))

    def keyed(df):
        own = df.withColumn("miss", may_differ).join(used, ["template", "miss"])
        return own.withColumn("cell", F.transform("places", lambda i: F.floor(F.element_at("point", i + 1) / close)))

    number = F.explode(F.sequence(F.lit(0), F.pow(F.lit(3), F.size("places")).cast("int") - 1))
    beside = keyed(others).withColumn("number", number).withColumn(
        "cell", F.transform("cell", lambda c, i: c + F.pmod(F.floor(F.col("number") / F.pow(F.lit(3), i)), F.lit(3)).cast("bigint") - 1))
    beside = beside.select("template", "miss", "group", "cell", F.col("point").alias("p2"), F.col("rank").alias("r2"))
    near = F.size(F.filter(F.zip_with("point", "p2", lambda x, y: F.abs(x - y) < close), lambda v: v)) / F.size("point") > share
    best = keyed(points).join(beside, ["template", "miss", "group", "cell"]).filter(near).groupBy("template", "point").agg(F.min("r2").alias("_best"))
    worse = F.coalesce(F.col("_best") < F.col("rank"), F.lit(False))
    return ranked.join(best, ["template", "point"], "left").filter(~worse).select(*ranked.columns)


CHUNK = 64  #: candidates that a task replays on a series
COMPARISONS = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}


def _slot(cond: dict, names: set[str]) -> str | None:
    """The parameter that replaces the value of an entry condition."""
    if cond["op"] == "squeeze_breakout" and "squeeze_lookback" in names:
        return "squeeze_lookback"
    own = [n for ind, op, n in ENTRY_VALUES if cond["indicator"] == ind and op in (None, cond["op"]) and n in names]
    if own and cond["op"] not in COMPARISONS:
        raise ValueError(f"a parameter cannot replace the value of {cond}")
    return own[-1] if own else None


def effects(cand: DataFrame) -> DataFrame:
    """Candidates by what decides their trades: (strategy_id, template, values, multiplier, target_mult, candidate_ids); parameters that
    no rule reads do not count. ``values`` has the value of each entry condition that a parameter replaces."""
    by_name = {s["name"]: s for s in STRATEGIES}

    def of(name, *keys, default=None):
        return F.coalesce(*[F.try_element_at("params", F.lit(k)) for k in keys], F.lit(default).cast("double"))

    out = []
    for name, space in PARAMETER_SPACES.items():
        doc, names = by_name[name], {n for n, *_ in space}
        slots = [_slot(c, names) for c in doc["entry_rules"]["conditions"]]
        values = F.array(*[of(name, s) if s else F.lit(None).cast("double") for s in slots])
        stop = doc.get("stoploss_rules", {})
        used = stop.get("type", "atr_based") == "atr_based"
        multiplier = of(name, "atr_sl_mult", "multiplier", default=float(stop.get("multiplier", 2.0))) if used else F.lit(0.0)
        out.append(cand.filter(F.col("template") == name).select("candidate_id", "template", values.alias("values"), multiplier.alias("multiplier"),
                                                                of(name, "atr_target_mult", default=float(doc.get("parameters", {}).get("atr_target_mult", 2.0))).alias("target_mult")))
    every = reduce(DataFrame.unionByName, out)
    # Candidates with one effect are as many as the grid of the unread parameters has points.
    return every.groupBy("template", "values", "multiplier", "target_mult").agg(F.min("candidate_id").alias("strategy_id"), F.collect_list("candidate_id").alias("candidate_ids"))


def _specs(panel: DataFrame):
    """What is fixed of each template: flags of the conditions without a parameter and of the exit rules, operands of the others, and stops."""
    ctx, flags, operands, stops, specs = Panel.of(panel), [], {}, [], {}
    price = F.col("close") * (1 + DEFAULTS.slippage_pct)
    by_name = {s["name"]: s for s in STRATEGIES}
    for name, space in PARAMETER_SPACES.items():
        doc, conds = by_name[name], []
        for c in doc["entry_rules"]["conditions"]:
            if _slot(c, {n for n, *_ in space}):
                conds.append((c["op"], operands.setdefault(c["indicator"], len(operands))))
            else:
                conds.append((None, len(flags)))
                flags.append(condition(c, ctx))
        stop = doc.get("stoploss_rules", {})
        fixed = None if stop.get("type", "atr_based") == "atr_based" else len(stops)
        if fixed is not None:
            stops.append(stop_loss(rule_parts(doc), price, F.col("close")))
        specs[name] = {"all": doc["entry_rules"].get("logic", "AND") == "AND", "conds": conds, "exit": len(flags), "stop": fixed,
                       "trail": stop.get("trail_pct", 7) / 100 if stop.get("trailing") else None}
        flags.append(exit_signal(doc, ctx))
    none = F.lit(float("nan"))
    numbers = [F.coalesce(operand(n, ctx).try_cast("double"), none) for n in operands] + [F.coalesce(s, none) for s in stops] + [F.coalesce(F.nullif("atr_14", F.lit(0.0)), none), F.coalesce("bb_width", none)]
    rows = panel.select("symbol", "date", "close", "cycle", P.bits(flags).alias("flags"), F.array(*numbers).alias("numbers"))
    return rows, specs, len(operands)


def _entries(spec: dict, values: list, flag, numbers: np.ndarray) -> np.ndarray:
    """Rows on which the entry rules of a candidate hold."""
    held = []
    for (op, at), value in zip(spec["conds"], values, strict=True):
        if op is None:
            held.append(flag(at))
        elif op == "squeeze_breakout":
            n = int(value)
            low = pd.Series(numbers[:, -1]).shift(1).rolling(n, min_periods=1).min().to_numpy()
            held.append((np.arange(len(numbers)) >= n) & (numbers[:, at] <= low))
        else:
            held.append(COMPARISONS[op](numbers[:, at], value))
    return (np.all if spec["all"] else np.any)(held, axis=0)


def fitness(panel: DataFrame, cand: DataFrame, min_symbol_trades: int, p=DEFAULTS, chunk: int = CHUNK, whole: bool = False) -> DataFrame:
    """(candidate_id, sharpe, win_rate, n_trades) of every candidate that trades, in one job whatever their number.

    Candidates stay a table, which goes to all tasks in chunks (at most the grid has points, a few hundred bytes each); a series stays where it is and
    meets them one chunk after another, packed with what is fixed of their templates; the comparisons that parameters change are made on the series'
    arrays. Candidates of equal effect are replayed once. ``whole``: see ``replay.by_series``.
    """
    distinct = stored(effects(cand), "sweep-effects")
    sent = distinct.select("strategy_id", "template", "values", "multiplier", "target_mult").orderBy("strategy_id").toArrow()
    lists = panel.sparkSession.sparkContext.broadcast([b.to_pylist() for b in sent.to_batches(max_chunksize=chunk)])
    rows, specs, operands = _specs(panel)

    def run(t: pa.Table) -> pa.Table:
        close, found = t.column("close").to_numpy(), []
        if len(close) >= p.min_bars_replay:
            words = pc.list_flatten(t.column("flags")).to_numpy().reshape(len(close), -1)
            numbers = pc.list_flatten(t.column("numbers")).to_numpy().reshape(len(close), -1)

            def flag(i):
                return (words[:, i // P.BITS] >> (i % P.BITS) & 1).astype(bool)

            entry, atr = close * (1 + p.slippage_pct), numbers[:, -2]
            low, wide = np.where(np.isnan(atr), close * 0.02, atr), np.where(np.isnan(atr), entry * 0.02, atr)
            for c in (c for some in lists.value for c in some):
                spec = specs[c["template"]]
                enters = _entries(spec, c["values"], flag, numbers)
                if not enters.any():
                    continue
                stop = np.round(entry - low * c["multiplier"], 2) if spec["stop"] is None else numbers[:, operands + spec["stop"]]
                target = np.round(np.maximum(entry + wide * c["target_mult"], entry + (entry - stop) * p.min_risk_reward), 2)
                found.append((c["strategy_id"], P.walk(close, enters, flag(spec["exit"]), stop, target, spec["trail"], p.warmup_rows)))
        return P.trade_rows(t, close, found, p)

    trades = P.by_series(rows, run, P.TRADE_SCHEMA, whole)
    m = P.trade_metrics(trades, p, min_trades=min_symbol_trades)
    m = m.groupBy("strategy_id").agg(F.avg("sharpe_ratio").alias("sharpe"), F.avg("win_rate").alias("win_rate"), F.sum("total_trades").alias("n_trades"))
    return m.join(distinct.select("strategy_id", F.explode("candidate_ids").alias("candidate_id")), "strategy_id").drop("strategy_id")


def evaluate(panel: DataFrame, cand: DataFrame, min_symbol_trades: int = 5, p=DEFAULTS, whole: bool = False) -> DataFrame:
    """Fitness of every candidate over all symbols, and whether it passes the gates."""
    out = cand.join(fitness(panel, cand, min_symbol_trades, p, whole=whole), "candidate_id", "left").withColumns({
        "sharpe": F.coalesce("sharpe", F.lit(-1.0)), "win_rate": F.coalesce("win_rate", F.lit(0.0)),
        "n_trades": F.coalesce("n_trades", F.lit(0))})
    gate = ((F.col("sharpe") >= p.gate_sharpe) & (F.col("win_rate") >= p.gate_win_rate)
            & (F.col("n_trades") >= p.gate_min_trades))
    w = Window.partitionBy("template").orderBy(F.desc("sharpe"), "candidate_id")
    out = out.withColumn("passes", gate).withColumn("rank", F.row_number().over(w))
    # Equal at one decimal counts as the same configuration.
    same = Window.partitionBy("template", F.transform("point", lambda v: F.round(v, 1))).orderBy("rank")
    out = out.withColumn("_dup", F.row_number().over(same)).filter("_dup = 1").drop("_dup")
    return without_near_duplicates(out).select("candidate_id", "template", F.to_json("params").alias("params"),
                                               "sharpe", "win_rate", "n_trades", "passes", "rank")
