"""Window and sequence helpers over (symbol, date) series.

A daily series has one row per (symbol, date), so a partition of these windows
is bounded by the length of the calendar, not by the size of the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(*keys: str, order: str = "date") -> WindowSpec:
    """Window over one series per key, in order."""
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def previous(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one."""
    return w.rowsBetween(-n, -1)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rolling(agg, col: Column, w: WindowSpec, n: int, min_n: int | None = None) -> Column:
    """Rolling aggregate that is NULL until ``min_n`` non-null values are in the frame."""
    frame = trailing(w, n)
    return F.when(F.count(col).over(frame) >= F.lit(min_n or n), agg(col).over(frame))


def long_mean(cumulative: str, w: WindowSpec, n: int) -> Column:
    """Mean of the last n values from a running-sum column: constant work per row."""
    return (F.col(cumulative) - F.coalesce(F.lag(cumulative, n).over(w), F.lit(0.0))) / n


def long_extreme(pick, short: str, w: WindowSpec, n: int, step: int) -> Column:
    """Max or min of the last n rows out of the same over ``step`` rows.

    ``short`` holds the extreme of the last ``step`` rows and n is a multiple of
    it, so n / step values are compared per row instead of n. ``pick`` is
    ``F.greatest`` or ``F.least``, which skip the NULLs before the first row.
    """
    assert n % step == 0
    return pick(F.col(short), *[F.lag(short, i).over(w) for i in range(step, n, step)])


def pct_change(col: Column, w: WindowSpec, n: int) -> Column:
    """Percent change against the value n rows before."""
    return (F.try_divide(col, F.lag(col, n).over(w)) - 1) * 100


def forward_fill(df: DataFrame, cols: list[str], w: WindowSpec) -> DataFrame:
    """Replace NULL by the last non-null value of the series."""
    return df.withColumns(
        {c: F.last(c, ignorenulls=True).over(running(w)) for c in cols})


def rank_percentile(col: Column, w: WindowSpec, n: int, min_n: int) -> Column:
    """Percentile of the current value among the last n, ties averaged, 0 to 100."""
    vals = F.collect_list(col).over(trailing(w, n))
    below = F.size(F.filter(vals, lambda v: v < col))
    equal = F.size(F.filter(vals, lambda v: v == col))
    pct = (below + (equal + 1) / 2.0) / F.size(vals) * 100
    return F.when((F.size(vals) >= min_n) & col.isNotNull(), pct)


def simple_rsi(df: DataFrame, price: str, w: WindowSpec, out: str, n: int = 14) -> DataFrame:
    """RSI from plain rolling means of gains and losses; NULL when there is no loss."""
    delta = F.col(price) - F.lag(price).over(w)
    df = df.withColumn("_delta", delta)
    # greatest() skips NULL, so the first row is masked by the CASE.
    up = F.when(F.col("_delta") > 0, F.col("_delta")).when(F.col("_delta").isNotNull(), 0.0)
    down = F.when(F.col("_delta") < 0, -F.col("_delta")).when(F.col("_delta").isNotNull(), 0.0)
    gain, loss = rolling(F.avg, up, w, n), rolling(F.avg, down, w, n)
    rs = F.try_divide(gain, F.nullif(loss, F.lit(0.0)))
    return df.withColumn(out, 100 - 100 / (1 + rs)).drop("_delta")


def run_length_filter(df: DataFrame, value: str, keys: list[str], min_len: Column,
                      order: str = "date", neutral: int = 0) -> DataFrame:
    """Set runs of a non-neutral value that are shorter than ``min_len`` to neutral."""
    w = series(*keys, order=order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    df = df.withColumn("_chg", changed)
    df = df.withColumn("_run", F.sum("_chg").over(running(w)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run"))
    kept = F.when((F.col(value) != neutral) & (size < min_len), neutral).otherwise(F.col(value))
    return df.withColumn(value, kept).drop("_chg", "_run")


def latest(df: DataFrame, keys: list[str], order: str | list, n: int = 1) -> DataFrame:
    """Last n rows per key. The rank filter is pushed below the shuffle by Spark."""
    cols = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in cols])
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key in the given order, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def time_folds(df: DataFrame, order: list[str], n_splits: int = 5) -> DataFrame:
    """Expanding-window folds on row order.

    Adds ``fold``: 0 for rows that are only ever trained on, k for the rows
    tested in split k. Split k trains on all rows with ``fold`` < k.
    The rows before the global order are numbered per date first, so no single
    task sorts the whole input.
    """
    day = order[0]
    per_day = df.groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    wd = Window.orderBy(day)  # one row per date
    per_day = (per_day
               .withColumn("_base", F.coalesce(F.sum("_n").over(
                   wd.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("_total", F.sum("_n").over(
                   wd.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    pos = F.row_number().over(Window.partitionBy(day).orderBy(*order[1:] or [day])) - 1
    out = df.join(F.broadcast(per_day.drop("_n")), day)
    out = out.withColumn("_pos", F.col("_base") + pos)
    test = F.floor(F.col("_total") / (n_splits + 1))
    first = F.col("_total") - test * n_splits
    fold = F.when(F.col("_pos") < first, 0).otherwise(
        F.floor((F.col("_pos") - first) / test) + 1)
    return out.withColumn("fold", fold.cast("int")).drop("_base", "_total", "_pos")


def all_of(conds: list[Column]) -> Column:
    """Conjunction; empty is true."""
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds: list[Column]) -> Column:
    """Disjunction; empty is false."""
    return reduce(lambda a, b: a | b, conds, F.lit(False))
