"""Report row sets put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.operators import portfolio as PF
from tapeflow.operators import regimes as R
from tapeflow.operators import signals as SG


def eod_report(cycles: DataFrame, log: DataFrame, n: int | None = None) -> dict[str, DataFrame]:
    """End of day: regime, sector tally, signal counts and the best buys."""
    watch = SG.watchlist(log, signal_type="buy")
    return {"regime": R.market_state(cycles), "sectors": R.sector_tally(cycles), "counts": SG.counts(log), "top": watch if n is None else watch.limit(n)}


def morning_report(bars: DataFrame, positions: DataFrame, log: DataFrame, n: int | None = None, tracked_limit: int | None = None) -> dict[str, DataFrame]:
    """Morning: the largest gaps each way and the three best setups."""
    watch = SG.supersede(log)
    tracked = PF.tracked_symbols(positions, watch, limit=tracked_limit)
    return {"gaps": PF.gap_lists(bars, tracked, n=n), "setups": SG.top_setups(watch)}


def lines(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts as rows (part, line)."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("line"))
        out = one if out is None else out.unionByName(one)
    return out
