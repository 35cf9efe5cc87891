"""Dates in texts, each as pandas reads it by itself."""

import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.functions.dates import parse_mixed

CELLS = """2024-01-05 10:10 PM|01/05/2024 1:02 AM|05-01-2024|13-01-2024|Jan 5 2024 10:00|5 January 2024|Fri, 05 Jan 2024 10:00:00 +0100
20240105T101010|20240105101010|20240105 1010|2024.01.05|5.1.2024|1/5/24|2024-01|2024|Jan 2024|January 5th, 2024 3:04pm|Fri Jan  5 10:10:10 2024
2024-01-05T10:10:10.123456789|2024-01-05 10:10:10 EST|2024/1/5 9:5|5-Jan-2024|5-Jan-24|2024-Jan-05|13/13/2024|2024-02-30|2024-01-05T10|2024-01-05 24:00:00
01-02-03|2024-001|05 Jan 2024 10:00:00 GMT|2024-01-05 10:10:10,5|Friday, January 5, 2024|20240105|2024-01-05T10:10:10+05|2024-1-5T1:2:3Z
0024-01-01|9999-01-01|2024-01-05 10:10:10 +0530|1/5/2024 13:05 PM|1/5/2024 12:05 AM|2024-01-05T10:10Z|Sept 5 2024|2024 01 05|05 01 2024|12/31/1999 23:59:59.5
2024-01-05 10:10:10.25-08:00|31.12.2023 08:15|8:15 31.12.2023|10:10 PM January 5, 2024|never|2024-13-01|1/32/2024|5th of May|x2024-01-05|2024-01-05x|12:61 1/5/2024|1 dec 1999 0:00
2024-01-05 10:60|Mon, 1 Jul 2024 1:02:03 -0330|2262-04-11 23:47:16|2262-04-12|1677-09-21|6/7/1970|MAY 3, 1995|3 may 1995 5 pm|2024-06-30T23:59:60Z""".replace("\n", "|").split("|")


def test_as_pandas_reads_each(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = {c: pd.to_datetime(pd.Series([c]), format="mixed", utc=True, errors="coerce")[0] for c in CELLS}
    assert sum(not pd.isna(w) for w in want.values()) > 45
    df = spark.createDataFrame([(c, pad + c + pad) for c in CELLS for pad in ("", " ")], "cell string, padded string")
    got = df.select("cell", F.unix_micros(parse_mixed(F.col("padded"))).alias("us")).collect()
    assert {(r.cell, r.us) for r in got} == {(c, None if pd.isna(w) else w.value // 1000) for c, w in want.items()}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_the_sessions_zone_says_nothing(spark, zone):
    df = spark.createDataFrame([("2024-07-05 10:00:00",), ("7/5/2024 10:00",), ("5 Jul 2024 10:00",), ("2024-07-05T10:00:00Z",), ("2024-07-05T12:00:00+02:00",)], "cell string")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert {r.us for r in df.select(F.unix_micros(parse_mixed(F.col("cell"))).alias("us")).collect()} == {1720173600 * 10**6}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_what_has_no_date(spark):
    df = spark.createDataFrame([(x,) for x in ("10:30", "", "  ", None, "nan", "5 pm", "123456789", "12345")], "cell string")
    assert df.select(parse_mixed(F.col("cell")).alias("t")).filter("t IS NOT NULL").count() == 0
