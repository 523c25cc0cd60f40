"""Dates are parsed once for each text that has one, and as before on odd texts."""

import datetime

from pyspark.sql import functions as F

from paperloom.operators import dates

AS_OF = datetime.date(2030, 1, 1)


def test_parsing_repeats_no_expression(spark):
    """A plan in which every use of a value repeats it holds dozens of patterns for one date, and thousands for a slip."""
    df = spark.createDataFrame([("x",)], "t string")
    count = lambda c: df.select(c.alias("d"))._jdf.queryExecution().analyzed().toString().count("regexp_extract(")
    assert count(dates.parsed_date(F.col("t"), F.lit(AS_OF))) <= 6
    assert count(dates.routing_date(F.col("t"), F.lit(AS_OF))) <= 24


def test_dates_as_before(spark):
    want = {
        "03/04/2020": datetime.date(2020, 3, 4), "25/12/99": datetime.date(1999, 12, 25), "12-31-68": None, "1.2.69": datetime.date(1969, 1, 2), "02/30/2020": None, "Sept. 9, 2011": datetime.date(2011, 9, 9),
        "7 May 2012": datetime.date(2012, 5, 7), "1/1/1949": None, "": None, "nothing": None, None: None,
    }
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", dates.parsed_date(F.col("t"), F.lit(AS_OF)).alias("d")).collect()
    assert {r.t: r.d for r in rows} == want
