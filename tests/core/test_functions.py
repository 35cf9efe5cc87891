from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veilspark.functions import names, numeric, text, timestamps


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(("span", "step"), [(10, 1.0), (95, 10.0), (18, 2.0), (24, 2.5), (26, 5.0), (0.3, 0.05), (0, 1.0), (-3, 1.0), (float("inf"), 1.0)])
def test_nice_step(spark, span, step):
    assert one(spark, numeric.nice_step(F.lit(float(span))))[0] == pytest.approx(step)


def test_edges_are_a_grid_with_the_greatest_value_inside(spark):
    edges = one(spark, numeric.nice_edges(F.lit(3.0), F.lit(40.0)))[0]
    assert edges == [0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0]
    e = F.array(*map(F.lit, edges))
    assert one(spark, numeric.bin_of(e, F.lit(5.0)), numeric.bin_of(e, F.lit(4.999)), numeric.bin_of(e, F.lit(40.0)))[:] == (1, 0, 8)


def test_names():
    assert names.is_sensitive_name("Sentiment") and names.is_sensitive_name("created_at") and names.is_sensitive_name("ID") and not names.is_sensitive_name("value")
    assert not names.is_identifier_name("order_date") and names.is_identifier_name("user_id") and not names.is_identifier_name("idx")
    assert names.is_datetime_name("sample_time") and names.is_birth_name("date_of_birth")
    assert names.find_count_column(["a", "n_patients", "count"]) == "n_patients" and names.find_count_column(["mean", "nation"]) is None
    assert names.find_subject_key(["record_id", "Time_Traveler_ID", "id"]) == "Time_Traveler_ID" and names.find_subject_key(["o_custkey"]) is None


@pytest.mark.parametrize(("seconds", "label"), [(60, "~1/min or finer"), (61, "~1/5 min"), (86400, "~1/day"), (700000, "~coarser than weekly"), (0, "unknown"), (None, "unknown"), (float("inf"), "unknown")])
def test_cadence_label(spark, seconds, label):
    assert one(spark, timestamps.cadence_label(F.lit(seconds).cast("double")))[0] == label


@pytest.mark.parametrize(
    ("cell", "template"),
    [("2024-01-02T03:04:05Z", "%Y-%m-%dT%H:%M:%SZ"), ("2024-01-02 03:04:05.25+01:00", "%Y-%m-%d %H:%M:%S.%f%z"), ("2024-01-02", "%Y-%m-%d"), ("1700000000", "epoch_s"), ("1700000000000", "epoch_ms"), ("1700000000.5", "epoch_s_float"), ("soon", "other"), (" NaT ", None), (None, None)],
)
def test_format_of(spark, cell, template):
    found = one(spark, timestamps.format_of(F.lit(cell).cast("string")).alias("f")).f
    assert (found and found.template) == template


@pytest.mark.parametrize(
    ("cell", "want"),
    [("2025-01-02T03:04:05-08:00", datetime(2025, 1, 2, 11, 4, 5)), ("2025-01-02", datetime(2025, 1, 2)), ("01/02/2025", datetime(2025, 1, 2)), ("13/01/2025", datetime(2025, 1, 13)), ("Jan 3 2025", datetime(2025, 1, 3)), ("20250103", datetime(2025, 1, 3)), ("10:30", None), ("never", None)],
)
def test_parse_mixed(spark, cell, want):
    us = one(spark, F.unix_micros(timestamps.parse_mixed(F.lit(cell))).alias("u")).u
    assert us == (want and round((want - datetime(1970, 1, 1)).total_seconds() * 1e6))


def test_render_and_classify_agree(spark):
    ts = F.lit("2024-05-06 07:08:09.123456").cast("timestamp")
    made = [
        {"representation": "epoch_ms", "template": "epoch_ms"}, {"representation": "epoch_s", "template": "epoch_s"}, {"representation": "epoch_s", "template": "epoch_s_float"},
        {"representation": "iso8601", "granularity": "date", "template": "%Y-%m-%d"}, {"representation": "iso8601", "granularity": "datetime", "separator": "T", "timezone": "utc", "template": "%Y-%m-%dT%H:%M:%SZ"},
        {"representation": "iso8601", "granularity": "datetime_subsecond", "separator": " ", "timezone": "offset", "template": "%Y-%m-%d %H:%M:%S.%f%z"},
    ]
    for d in made:
        assert one(spark, timestamps.format_of(timestamps.render(ts, d)).alias("f")).f.template == d["template"]


@pytest.mark.parametrize(
    ("said", "left"),
    [
        ("KeyError: 'patient 12'", "KeyError: '<redacted>'"), ('"it\'s" and \'x\'', '"<redacted>" and \'<redacted>\''), ("mail a.b@c.org now", "mail <redacted> now"),
        ("file.py:12 value 123 and 4.5 and 7", "file.py:12 value <redacted> and <redacted> and 7"), ("é12 x12 12x", "é12 x12 <redacted>x"),
    ],
)
def test_scrub(spark, said, left):
    assert text.scrub_text(said) == left and one(spark, text.scrub(F.lit(said)))[0] == left



def test_uniforms_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("u", numeric.hashed_uniform(3, F.lit("c"), "id"))
    a, b = (sorted(x.collect()) for x in (df, spark.range(500).repartition(7).withColumn("u", numeric.hashed_uniform(3, F.lit("c"), "id"))))
    assert a == b and all(0 <= r.u < 1 for r in a) and abs(sum(r.u for r in a) / 500 - 0.5) < 0.05
