"""JSON rule documents compiled to Spark columns.

A condition is {indicator, op, value}. A missing operand makes it false. A
look-back is a column where the panel holds it (``look_back_columns``), so that
rows need not meet again by symbol; else it is a window over (symbol, date).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.windows import all_of, any_of, previous, series


def look_back_column(kind: str, name: str, n: int) -> str:
    return f"_{kind}{n}_{name}"


@dataclass
class Panel:
    """Columns a rule can see. ``rn`` numbers the rows of a symbol from 1."""

    columns: frozenset[str]
    strict_cross: bool = False
    window: object = field(default_factory=series)
    asked: set = field(default_factory=set)  # look-backs that were compiled

    @classmethod
    def of(cls, df: DataFrame, strict_cross: bool = False) -> "Panel":
        return cls(frozenset(df.columns), strict_cross)

    def _back(self, kind: str, name: str, n: int, window) -> Column:
        self.asked.add((kind, name, n))
        held = look_back_column(kind, name, n)
        return F.col(held) if held in self.columns else window()

    def lag(self, name: str, n: int = 1) -> Column:
        return self._back("lag", name, n, lambda: F.lag(name, n).over(self.window))

    def least(self, name: str, n: int) -> Column:
        """The smallest value of the n rows before."""
        return self._back("min", name, n, lambda: F.min(name).over(previous(self.window, n)))

    def most(self, name: str, n: int) -> Column:
        return self._back("max", name, n, lambda: F.max(name).over(previous(self.window, n)))

    def after(self, n: int, col: Column) -> Column:
        """Value only where at least n rows precede the current one."""
        return F.when(F.col("rn") > n, col)


def _col_or(p: Panel, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in p.columns else F.lit(default)


def _gap(p: Panel) -> Column:
    prev = p.lag("close")
    return F.when(prev != 0, (F.col("open") - prev) / prev * 100).when(prev.isNotNull(), 0.0)


def _from_vwap(p: Panel) -> Column:
    if "vwap" not in p.columns:
        return F.lit(0.0)
    v = F.col("vwap")
    return F.when(v != 0, (F.col("close") - v) / v * 100).when(v.isNotNull(), 0.0)


# Derived operands, used where the panel has no column (or NULL) of that name.
OPERANDS = {
    "ema_21": lambda p: _col_or(p, "ema_20", 0.0),
    "high_20d": lambda p: p.after(20, p.most("high", 20)),
    "low_10d": lambda p: p.after(10, p.least("low", 10)),
    "prev_close": lambda p: p.lag("close"),
    "close_26d_ago": lambda p: p.lag("close", 26),
    "macd_hist_prev": lambda p: p.after(1, F.coalesce(p.lag("macd_hist"), F.lit(0.0))),
    "pct_from_vwap": _from_vwap,
    "gap_pct": _gap,
    "gap_pct_x2": lambda p: 2 * _gap(p),
    "rs_percentile": lambda p: _col_or(p, "rs_nifty200", 50.0),
    "sector_cycle": lambda p: F.lit("neutral"),
    "pe_vs_sector": lambda p: _col_or(p, "pe_ratio", 20.0) / 20.0,
    "roe": lambda p: F.lit(0.0),
    "revenue_growth": lambda p: F.lit(0.0),
}
# The lagging span drawn 26 bars back is today's close; the stored column
# looks ahead and must not reach a rule.
REPLACED = {"ichimoku_chikou": lambda p: F.col("close")}


def operand(name: str, p: Panel) -> Column | None:
    """Column of an operand, or None when nothing resolves it."""
    if name in REPLACED:
        return REPLACED[name](p)
    direct = F.col(name) if name in p.columns else None
    derived = OPERANDS[name](p) if name in OPERANDS else None
    if direct is not None and derived is not None:
        return F.coalesce(direct, derived)
    return direct if direct is not None else derived


def _rhs(value, p: Panel) -> tuple[Column | None, str | None]:
    if isinstance(value, str) and value.startswith("indicator:"):
        name = value.removeprefix("indicator:")
        return operand(name, p), name
    return F.lit(value), None


def _cross(cond: dict, lhs: Column, rhs: Column, rhs_name: str | None, p: Panel, up: bool) -> Column:
    name = cond["indicator"]
    before = p.lag(name) if name in p.columns and name not in REPLACED else F.lit(0.0)
    ref = p.lag(rhs_name) if p.strict_cross and rhs_name in p.columns else rhs
    rhs = rhs.cast("double")
    crossed = (before <= ref) & (lhs > rhs) if up else (before >= ref) & (lhs < rhs)
    return (F.col("rn") > 1) & crossed


def condition(cond: dict, p: Panel) -> Column:
    """One condition as a boolean column that is never NULL."""
    lhs = operand(cond.get("indicator", ""), p)
    rhs, rhs_name = _rhs(cond.get("value"), p)
    op = cond.get("op")
    if lhs is None or rhs is None:
        return F.lit(False)
    if op in (">", ">=", "<", "<="):
        a, b = lhs.try_cast("double"), rhs.try_cast("double")
        out = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    elif op == "==":
        out = lhs.cast("string") == rhs.cast("string")
    elif op == "is_true":
        out = lhs.try_cast("double") != 0
    elif op in ("crosses_above", "crosses_below"):
        out = _cross(cond, lhs, rhs, rhs_name, p, op == "crosses_above")
    elif op == "bullish_divergence":
        n, name = cond.get("lookback", 10), cond.get("indicator")
        out = p.after(n, (F.col("close") < p.least("close", n)) & (lhs > p.least(name, n)))
    elif op == "squeeze_breakout":
        n = cond.get("squeeze_lookback", 126)
        if "bb_width" not in p.columns:
            return F.lit(False)
        out = p.after(n, lhs <= p.least("bb_width", n))
    else:
        return F.lit(False)
    return F.coalesce(out, F.lit(False))


LONGEST_LAG = 26  # rows that an operand looks back at most


def look_back(docs: list[dict]) -> int:
    """Rows before the current one that the entry rules of the documents read at most."""
    n = [LONGEST_LAG]
    for c in (c for doc in docs for c in doc.get("entry_rules", {}).get("conditions", [])):
        n += [c.get("lookback", 10)] * (c.get("op") == "bullish_divergence") + [c.get("squeeze_lookback", 126)] * (c.get("op") == "squeeze_breakout")
    return max(n)


def compile_rules(rules: dict, p: Panel, default_logic: str = "AND") -> Column:
    """Rule set as one boolean column. Empty AND is true, empty OR is false."""
    conds = [condition(c, p) for c in rules.get("conditions", [])]
    return all_of(conds) if rules.get("logic", default_logic) == "AND" else any_of(conds)


def entry_signal(doc: dict, p: Panel) -> Column:
    return compile_rules(doc.get("entry_rules", {}), p, "AND")


def exit_signal(doc: dict, p: Panel) -> Column:
    return compile_rules(doc.get("exit_rules", {}), p, "OR")


def _reason(cond: dict, passed: Column, p: Panel) -> Column:
    ind, op, value = cond.get("indicator", ""), cond.get("op", ""), cond.get("value")
    if ind not in p.columns:
        return F.lit(f"{ind} missing")
    mark = F.when(passed, "✓").otherwise("✗")
    actual = F.format_string("%.2f", F.col(ind).try_cast("double"))
    if isinstance(value, str) and value.startswith("indicator:"):
        other = value.removeprefix("indicator:")
        ref = F.format_string("%.2f", F.col(other).try_cast("double")) if other in p.columns else F.lit("missing")
        text = F.concat(F.lit(f"{ind}="), actual, F.lit(f" {op} {other}="), ref, F.lit(" → "), mark)
    else:
        text = F.concat(F.lit(f"{ind}="), actual, F.lit(f" {op} {value} → "), mark)
    return F.when(F.col(ind).isNull(), f"{ind} missing").otherwise(text)


def look_backs(docs: list[dict], columns) -> tuple[tuple[str, str, int], ...]:
    """(kind, column, rows) of what the rules of the documents look back on, in a panel of these columns."""
    p = Panel(frozenset(columns))
    for doc in docs:
        entry_signal(doc, p)
        exit_signal(doc, p)
    return tuple(sorted(p.asked))


def explain_rules(rules: dict, p: Panel, passed: list[Column] | None = None) -> Column:
    """Per condition: number, operands, result and reason, as an array of structs. ``passed`` holds results that are known already."""
    rows = []
    for i, c in enumerate(rules.get("conditions", [])):
        ok = condition(c, p) if passed is None else passed[i]
        rows.append(F.struct(
            F.lit(i + 1).alias("rule_num"), F.lit(c.get("indicator")).alias("indicator"),
            F.lit(c.get("op")).alias("op"), F.lit(str(c.get("value"))).alias("value"),
            ok.alias("passed"), _reason(c, ok, p).alias("reason")))
    return F.array(*rows)
