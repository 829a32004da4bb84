"""Reading and writing analytical tables: bars, macro context, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeflow.functions.windows import pct_change, rank_percentile

# Macro series name -> column of the context table.
CONTEXT_COLUMNS = {
    "nifty200": "nifty200_close",
    "india_vix": "india_vix",
    "dxy": "dxy",
    "brent_crude": "brent_crude",
    "nasdaq": "nasdaq_close",
    "dow": "dow_close",
    "us_10yr": "us_10yr_yield",
    "usd_inr": "usd_inr",
    "nifty_bank": "sector_bank_close",
    "nifty_it": "sector_it_close",
    "nifty_auto": "sector_auto_close",
    "nifty_fmcg": "sector_fmcg_close",
    "nifty_pharma": "sector_pharma_close",
    "nifty_metal": "sector_metal_close",
    "nifty_realty": "sector_realty_close",
    "nifty_energy": "sector_energy_close",
    "nifty_infra": "sector_infra_close",
    "nifty_psubank": "sector_psubank_close",
    "nifty_fin": "sector_fin_close",
    "nifty_media": "sector_media_close",
}


def clean_bars(raw: DataFrame, source: str = "file") -> DataFrame:
    """Bars table rows from raw quotes.

    Rows without close are dropped; open, high, low and adj_close default to
    close, volume to 0; the time zone of the quote is dropped.
    """
    c = F.col("close").cast("double")
    ts = "date" if "date" in raw.columns else "ts"

    def col(name, default, cast):
        return F.coalesce(F.col(name).cast(cast), default) if name in raw.columns else default

    return raw.filter(F.col("close").isNotNull()).select(
        "symbol", F.to_date(F.col(ts).cast("timestamp_ntz")).alias("date"),
        col("open", c, "double").alias("open"), col("high", c, "double").alias("high"),
        col("low", c, "double").alias("low"), c.alias("close"),
        col("adj_close", c, "double").alias("adj_close"),
        col("volume", F.lit(0).cast("bigint"), "bigint").alias("volume"), F.lit(source).alias("source"))


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return clean_bars(spark.read.format(fmt).options(**options).load(path))


def wide_to_bars(wide: DataFrame, symbols: list[str], fields: list[str]) -> DataFrame:
    """Long bar rows out of one wide frame with ``<symbol>_<field>`` columns."""
    per = [F.struct(F.lit(s).alias("symbol"), *[F.col(f"`{s}_{f}`").alias(f) for f in fields]) for s in symbols]
    return wide.select("date", F.explode(F.array(*per)).alias("r")).select("date", "r.*")


def watermarks(bars: DataFrame) -> DataFrame:
    """Last date and row count per symbol."""
    return bars.groupBy("symbol").agg(F.max("date").alias("last_date"), F.count(F.lit(1)).alias("price_count"))


def pivot_series(long: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Align single series (date, name, close) on date, one column per series."""
    names = names or CONTEXT_COLUMNS
    wide = long.groupBy("date").pivot("name", list(names)).agg(F.first("close"))
    return wide.select("date", *[F.col(n).alias(c) for n, c in names.items()])


def context_features(wide: DataFrame) -> DataFrame:
    """Returns and volatility measures of the context table (one row per date)."""
    w = Window.orderBy("date")
    out, have = {}, set(wide.columns)
    if "nifty200_close" in have:
        for n in (1, 5, 20):
            out[f"nifty200_{n}d_ret"] = pct_change(F.col("nifty200_close"), w, n)
    for name in ("nasdaq", "dow"):
        if f"{name}_close" in have:
            out[f"{name}_5d_ret"] = pct_change(F.col(f"{name}_close"), w, 5)
    if "india_vix" in have:
        out["india_vix_1d_chg"] = pct_change(F.col("india_vix"), w, 1)
        out["india_vix_pct252"] = rank_percentile(F.col("india_vix"), w, 252, 50)
    return wide.withColumns(out)


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Columns of ``df`` that the target table has, cast to its types."""
    have = set(df.columns)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in target.fields if f.name in have])


def dedupe(df: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """One row per key: the first one in ``order``; without an order the smallest row by all its columns."""
    rest = [F.col(c) for c in df.columns if c not in keys and not isinstance(df.schema[c].dataType, T.MapType)]
    w = Window.partitionBy(*keys).orderBy(*(order or rest or keys))
    return df.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key (NULL keys compare equal)."""
    fresh = dedupe(new, keys, order)
    k = fresh.select(*[F.col(c).alias(f"_{c}") for c in keys])
    cond = [old[c].eqNullSafe(k[f"_{c}"]) for c in keys]
    kept = old.join(k, cond, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Append rows of ``new`` whose key is not there yet."""
    fresh = dedupe(new, keys, order)
    o = old.select(*[F.col(c).alias(f"_{c}") for c in keys])
    cond = [fresh[c].eqNullSafe(o[f"_{c}"]) for c in keys]
    return old.unionByName(fresh.join(o, cond, "left_anti"), allowMissingColumns=True)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition_by: str,
                 order: list | None = None) -> None:
    """Upsert into a partitioned Parquet table, rewriting only the partitions ``new`` touches.

    The partition column must be a key or follow from one (as the year of a date):
    a key that moved to another partition would stay behind in its old one. A row of ``new``
    whose key is stored under another partition is refused.
    """
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the first load has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        dedupe(new, keys, order).write.partitionBy(partition_by).parquet(path)
        return
    if partition_by not in keys:
        moved = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(partition_by).alias("_part"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        if not new.join(moved, [*same, ~F.col(partition_by).eqNullSafe(F.col("_part"))], "left_semi").isEmpty():
            raise ValueError(f"a key would move to another {partition_by}")
    touched = new.select(partition_by).distinct()
    old = old.join(touched, partition_by, "left_semi").select(*old.columns)
    (upsert(old, new.select(*old.columns), keys, order)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_by).parquet(path))


def with_year(bars: DataFrame) -> DataFrame:
    """Partition column of the bars table."""
    return bars.withColumn("year", F.year("date"))


def import_log(spark: SparkSession, import_type: str, filename: str, rows: DataFrame, notes: str = "") -> DataFrame:
    """One audit row: type, file, number of rows, time."""
    return rows.agg(F.count(F.lit(1)).alias("rows_imported")).select(
        F.lit(import_type).alias("import_type"), F.lit(filename).alias("filename"), "rows_imported",
        F.current_timestamp().alias("imported_at"), F.lit(notes).alias("notes"))


def row_counts(named: dict[str, DataFrame]) -> DataFrame:
    """Number of rows per table."""
    out = None
    for name, df in named.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
