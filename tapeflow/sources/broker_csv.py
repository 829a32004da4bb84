"""Broker CSV files: holdings and tradebook imports, validation and preview."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.functions.scalars import clean_float, clean_int, parse_day_first
from tapeflow.operators import lots
from tapeflow.operators.portfolio import merge_cost
from tapeflow.session import stored

# Columns of the two files and their accepted other names.
HOLDINGS_REQUIRED = ("Instrument", "Qty", "Avg cost")
HOLDINGS_OPTIONAL = ("LTP", "Cur val", "P&L", "Net chg", "Day chg")
HOLDINGS_ALIASES = {
    "Instrument": ("stock", "symbol", "scrip", "tradingsymbol", "instrument"),
    "Qty": ("quantity", "shares", "holding qty"),
    "Avg cost": ("avg. cost", "average cost", "avg cost price", "average price", "cost price"),
}
TRADEBOOK_REQUIRED = ("symbol", "trade_date", "trade_type", "quantity", "price")
TRADEBOOK_ALIASES = {
    "tradingsymbol": "symbol", "instrument": "symbol",
    "buy_quantity": "quantity", "sell_quantity": "quantity",
    "buy_price": "price", "sell_price": "price",
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; typing is left to the cleaning step."""
    return spark.read.csv(path, header=True, quote='"', escape='"')


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.toDF(*[names.get(c, c) for c in df.columns])


def holdings_columns(df: DataFrame) -> DataFrame:
    """Strip names and map other known names onto the required ones."""
    df = df.toDF(*[c.strip() for c in df.columns])
    if all(c in df.columns for c in HOLDINGS_REQUIRED):
        return df
    by_lower = {c.lower(): c for c in df.columns}
    names = {}
    for target, alts in HOLDINGS_ALIASES.items():
        if target not in df.columns:
            hit = next((by_lower[a] for a in alts if a in by_lower), None)
            if hit is not None:
                names[hit] = target
    return _renamed(df, names)


def tradebook_columns(df: DataFrame) -> DataFrame:
    df = df.toDF(*[re.sub(" ", "_", c.strip().lower()) for c in df.columns])
    return _renamed(df, TRADEBOOK_ALIASES)


def _missing(df: DataFrame, required) -> list[str]:
    return [c for c in required if c not in df.columns]


def _require(df: DataFrame, required) -> None:
    gone = _missing(df, required)
    if gone:
        raise ValueError(f"Missing columns: {gone}")


def validate(df: DataFrame, kind: str = "holdings") -> dict:
    """Validity, missing columns, row count, columns and the first five rows (``preview``), for a dialogue."""
    df, required = (holdings_columns(df), HOLDINGS_REQUIRED) if kind == "holdings" else (
        df.toDF(*[re.sub(" ", "_", c.strip().lower()) for c in df.columns]), TRADEBOOK_REQUIRED)
    gone = _missing(df, required)
    return {"valid": not gone, "missing_cols": gone, "row_count": df.count(), "columns": df.columns,
            "preview": [r.asDict() for r in preview(df).collect()]}


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """Some rows of a file as text, to look at before an import."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).limit(n)


def validation_report(df: DataFrame, kind: str = "holdings") -> DataFrame:
    """Same check as one row, for files too large to preview."""
    df, required = (holdings_columns(df), HOLDINGS_REQUIRED) if kind == "holdings" else (tradebook_columns(df), TRADEBOOK_REQUIRED)
    gone = _missing(df, required)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(not gone).alias("valid"), F.lit(",".join(gone)).alias("missing_cols"), "row_count")


def holdings_rows(df: DataFrame) -> DataFrame:
    """Clean holdings rows; unusable ones are left out."""
    df = holdings_columns(df)
    _require(df, HOLDINGS_REQUIRED)
    cost = clean_float(F.col("`Avg cost`"))
    ltp = clean_float(F.col("LTP")) if "LTP" in df.columns else cost
    rows = df.select(F.upper(F.trim("Instrument")).alias("symbol"), clean_int(F.col("Qty")).alias("qty"),
                     cost.alias("avg_cost"), ltp.alias("ltp"))
    ok = F.col("symbol").isNotNull() & ~F.lower("symbol").isin("nan", "total", "") & (F.col("qty") > 0) & (F.col("avg_cost") > 0)
    return rows.filter(ok).withColumns({
        "pnl": (F.col("ltp") - F.col("avg_cost")) * F.col("qty"), "pnl_pct": (F.col("ltp") / F.col("avg_cost") - 1) * 100})


def import_holdings(existing: DataFrame, file_rows: DataFrame, timeframe: str = "long_term", as_of: str | None = None,
                    import_id: str | None = None) -> DataFrame:
    """Positions after the import: equal symbols of a timeframe merge at weighted mean cost.

    Positions remember the ids of their imports (``import_ids``); a symbol that already holds
    ``import_id`` takes nothing from a file that is imported again.
    """
    day = F.lit(as_of).cast("date") if as_of else F.current_date()
    none = F.array().cast("array<string>")
    if "import_ids" not in existing.columns:
        existing = existing.withColumn("import_ids", none)
    rows = stored(holdings_rows(file_rows).select("symbol", "qty", "avg_cost"), "holdings-file")  # read several times below
    new = rows.select(
        "symbol", F.lit(timeframe).alias("timeframe"), "qty", "avg_cost", day.alias("entry_date"))
    act = existing.filter("is_active")
    if import_id is not None:
        done = act.filter(F.array_contains(F.coalesce("import_ids", none), import_id)).select("symbol", "timeframe").distinct()
        new = new.join(done, ["symbol", "timeframe"], "left_anti")
    tags = act.select("symbol", "timeframe", F.explode(F.coalesce("import_ids", none)).alias("id"))
    tags = tags.unionByName(new.select("symbol", "timeframe", F.lit(import_id).alias("id"))).groupBy("symbol", "timeframe").agg(F.array_sort(F.collect_set("id")).alias("import_ids"))
    both = act.select("symbol", "timeframe", "qty", "avg_cost", "entry_date").unionByName(new)
    first = both.groupBy("symbol", "timeframe").agg(F.min("entry_date").alias("entry_date"))
    merged = merge_cost(both).join(first, ["symbol", "timeframe"])
    known = act.dropDuplicates(["symbol", "timeframe"]).drop("qty", "avg_cost", "entry_date", "import_ids")
    out = merged.join(known, ["symbol", "timeframe"], "left").join(tags, ["symbol", "timeframe"], "left") \
        .withColumns({"is_active": F.lit(True), "import_ids": F.coalesce("import_ids", none)})
    return existing.filter(~F.col("is_active")).unionByName(out, allowMissingColumns=True)


def tradebook_rows(df: DataFrame) -> DataFrame:
    """Clean executions; rows whose date cannot be read are left out."""
    df = tradebook_columns(df)
    _require(df, TRADEBOOK_REQUIRED)
    time = F.col("order_execution_time") if "order_execution_time" in df.columns else F.lit("")
    tid = F.col("trade_id") if "trade_id" in df.columns else F.lit("")
    return df.select(
        F.upper(F.trim("symbol")).alias("symbol"), parse_day_first(F.col("trade_date")).alias("trade_date"),
        F.upper(F.trim("trade_type")).alias("trade_type"), clean_int(F.col("quantity")).alias("quantity"),
        clean_float(F.col("price")).alias("price"), F.coalesce(time, F.lit("")).alias("order_execution_time"),
        F.coalesce(tid, F.lit("")).alias("trade_id")).filter(F.col("trade_date").isNotNull())


def import_tradebook(df: DataFrame, timeframe: str = "swing") -> tuple[DataFrame, DataFrame]:
    """Closed trades and open positions of a tradebook file."""
    # A prefix of the execution time follows the trade order within the date.
    # The file's text is read and parsed once; matching reads the rows several times.
    t = stored(tradebook_rows(df), "tradebook").withColumn("slot", F.substring("order_execution_time", 1, 16))
    slices = ["trade_date", "slot"]
    closed = lots.closed_trades(lots.fifo_matches(t, slices=slices))
    open_ = lots.open_lots(t, slices=slices).select("symbol", F.col("open_qty").alias("qty"), F.col("price").alias("avg_cost"),
                                     F.col("trade_date").alias("entry_date"), F.lit(timeframe).alias("timeframe"))
    return closed, open_
