"""Scalar column functions: number and date cleaning, encodings, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeflow.params import DEFAULTS


def lookup(key: Column, table: dict, default=None) -> Column:
    """Small fixed map lookup as a CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    if out is None:
        return F.lit(default)
    return out if default is None else out.otherwise(F.lit(default))


def clean_number(col: Column) -> Column:
    """Number out of text such as '₹2,345.67', '23.5 %' or '120Cr'; NULL if there is none."""
    text = F.regexp_replace(F.trim(col), r"[₹,\s%]", "")
    return F.regexp_replace(text, "Cr$", "").try_cast("double")


def clean_float(col: Column) -> Column:
    """Broker CSV price; unreadable text counts as 0."""
    return F.coalesce(F.regexp_replace(F.trim(col), "[,₹]", "").try_cast("double"), F.lit(0.0))


def clean_int(col: Column) -> Column:
    """Broker CSV quantity, truncated; unreadable text counts as 0."""
    return F.coalesce(F.regexp_replace(F.trim(col), ",", "").try_cast("double").try_cast("bigint"),
                      F.lit(0).cast("bigint"))


def parse_day_first(col: Column) -> Column:
    """Date out of day-first text, also accepting ISO; NULL when nothing fits."""
    c = F.trim(col)
    iso, *formats = [F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "d-M-yyyy", "d/M/yyyy", "dd-MMM-yyyy")]
    # A failed attempt costs far more than a parse, so text that begins with a day is not tried as ISO.
    return F.coalesce(F.when(~c.rlike(r"^\d{1,2}[-/]"), iso), *formats)


def naive_date(ts: Column) -> Column:
    """Calendar date of a timestamp, time zone dropped."""
    return F.to_date(ts.cast("timestamp_ntz"))


def encode_cycle(col: Column) -> Column:
    return lookup(col, {"bull": 1, "neutral": 0, "bear": -1}, 0)


def decode_cycle(col: Column) -> Column:
    return lookup(col, {1: "bull", -1: "bear", 0: "neutral"})


def infer_timeframe(days: Column) -> Column:
    """Timeframe out of the holding period in days."""
    return (F.when(days == 0, "intraday").when(days <= 10, "swing")
            .when(days <= 60, "medium").otherwise("long_term"))


def tax_type(days: Column, p=DEFAULTS) -> Column:
    return F.when(days > p.ltcg_days, "LTCG").otherwise("STCG")


def format_money(col: Column) -> Column:
    """Rupee text; values of at least one lakh in lakh."""
    a = F.abs(col)
    return (F.when(col.isNull(), F.lit("–"))
            .when(a >= 100_000, F.concat(F.lit("₹"), F.format_number(col / 100_000, 2), F.lit("L")))
            .when(a >= 1_000, F.concat(F.lit("₹"), F.format_number(col, 2)))
            .otherwise(F.format_string("₹%.2f", col)))


def format_percent(col: Column, decimals: int = 1) -> Column:
    sign = F.when(col >= 0, "+").otherwise("")
    return F.when(col.isNull(), F.lit("–")).otherwise(
        F.concat(sign, F.format_string(f"%.{decimals}f%%", col)))


def threshold_for(cycle: Column, p=DEFAULTS) -> Column:
    """Signal threshold of the current market regime."""
    return lookup(cycle, p.signal_thresholds, p.signal_thresholds["neutral"])


def is_stale(classified_at: Column, now: Column, p=DEFAULTS) -> Column:
    """True when there is no classification or it is older than the limit."""
    hours = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(classified_at.cast("timestamp"))) / 3600
    return F.coalesce(hours > p.stale_hours, F.lit(True))
