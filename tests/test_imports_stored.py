"""Imported files are parsed once."""

import datetime

from pyspark.sql import functions as F

from tapeflow.functions.scalars import parse_day_first
from tapeflow.sources import broker_csv


def test_tradebook_is_parsed_once(spark, tmp_path):
    path = tmp_path / "book.csv"
    path.write_text("symbol,trade_date,trade_type,quantity,price\nabc,05-01-2024,buy,10,100\nABC,2024-01-09,sell,4,110\nabc,nonsense,sell,1,1\n")
    closed, open_ = broker_csv.import_tradebook(broker_csv.read_csv(spark, str(path)))
    assert not any(f.endswith("book.csv") for f in closed.inputFiles() + open_.inputFiles())
    assert [(r.symbol, r.entry_date, r.exit_date, r.qty) for r in closed.collect()] == [("ABC", datetime.date(2024, 1, 5), datetime.date(2024, 1, 9), 4)]
    assert [(r.symbol, r.qty) for r in open_.collect()] == [("ABC", 6)]


def test_day_first_dates(spark):
    day = datetime.date(2024, 2, 1)
    cases = {"2024-02-01": day, " 01-02-2024 ": day, "01/02/2024": day, "1-2-2024": day, "1/2/2024": day, "01-Feb-2024": day, "31-31-2024": None, "": None, "x": None, None: None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse_day_first(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == cases
