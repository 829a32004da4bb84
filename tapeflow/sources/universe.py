"""The stock universe: a user-supplied table, its derived columns and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.functions.scalars import lookup

# Quote symbols that do not follow the <symbol>.NS rule.
QUOTE_SYMBOLS = {"M&M": "M%26M.NS", "BAJAJ-AUTO": "BAJAJ-AUTO.NS"}
COLUMNS = ("symbol", "name", "sector", "industry", "market_cap_cat", "in_nifty50", "in_nifty100")


def quote_symbol(symbol: Column) -> Column:
    return F.coalesce(lookup(symbol, QUOTE_SYMBOLS), F.concat(symbol, F.lit(".NS")))


def seed(rows: DataFrame) -> DataFrame:
    """Universe table rows out of the seed columns."""
    return rows.select(*COLUMNS).withColumns({
        "in_nifty200": F.lit(True), "yfinance_symbol": quote_symbol(F.col("symbol")),
        "is_active": F.lit(True), "updated_at": F.current_timestamp()})


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """Seed file: CSV with a header and the columns of ``COLUMNS``."""
    raw = spark.read.csv(path, header=True)
    return seed(raw.withColumns({c: F.col(c).cast("boolean") for c in ("in_nifty50", "in_nifty100")}))


def sectors(universe: DataFrame) -> DataFrame:
    return universe.select("sector").distinct().orderBy("sector")


def symbols_in_sector(universe: DataFrame, sector: str) -> DataFrame:
    return universe.filter(F.col("sector") == sector).select("symbol")


def sample_symbols(universe: DataFrame, n: int, seed_value: int = 42) -> DataFrame:
    """n symbols in the order of a seeded digest: the same ones on every run and in any engine that has md5."""
    return (universe.select("symbol").distinct()
            .orderBy(F.md5(F.concat(F.lit(f"{seed_value}|"), F.col("symbol")).cast("binary")), "symbol").limit(n))
