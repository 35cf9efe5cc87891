"""Order statistics and timelines against numpy and pandas, also where one key has a third of all rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.operators import order, temporal


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 50, list(range(-40, 60)), [0.0, -0.5, 1e-9, 1e12, 7.25, -3e5] * 7, list(np.random.default_rng(1).lognormal(3, 2, 500)), [float("nan"), 1.0, float("inf"), 4.0, None]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(g, None if v is None else float(v) * (1 + g)) for g in (0, 1) for v in values], "g int, v double")
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r.g: (r.n, r.q) for r in order.quantiles(df, "v", shares, ["g"]).collect()}
    finite = np.array([v for v in values if v is not None and math.isfinite(v)])
    for g in (0, 1):
        assert got[g][0] == len(finite) and np.allclose(got[g][1], np.quantile(finite * (1 + g), shares), rtol=1e-12)
    assert order.medians(df.filter("g = 0"), "v").first().median == pytest.approx(np.median(finite))


def test_no_values(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "g int, v double")
    assert order.quantiles(df, "v", [0.5], ["g"]).count() == 0 and order.medians(df, "v").first().median is None


def test_buckets_keep_the_order(spark):
    values = sorted({0.0, *np.random.default_rng(2).normal(0, 1, 300), *(s * 2.0**k for s in (-1, 1) for k in range(-1070, 1024, 61))})
    got = [r.b for r in spark.createDataFrame([(float(v),) for v in values], "v double").select("v", order.bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got)


def test_average_ranks(spark):
    values = [5.0, 1.0, 5.0, 3.0, -2.0, 0.0, 5.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.r for r in order.average_ranks(df, "v", "r").collect()}
    want = pd.Series(values).rank()
    assert all(got[i] == (None if math.isnan(w) else w) for i, w in enumerate(want))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100])
def test_parts(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(rng.integers(0, 4)), i, float(i)) for i in range(n)]
    got = {r.tie: r.part for r in order.parts(spark.createDataFrame(rows, "by long, tie long, v double"), 3, "by", "tie").collect()}
    ordered = [tie for _, tie, _ in sorted(rows)]
    want = np.concatenate([np.full(len(x), i + 1) for i, x in enumerate(np.array_split(ordered, 3))])
    assert [got[t] for t in ordered] == want.tolist()


def plain_sessions(df):
    """By pandas, subject after subject: each stamp's delta, session and the metrics."""
    out = []
    for sid, own in df.groupby("sid"):
        us = np.sort(own["us"].to_numpy())
        delta = np.diff(us) / 1e6
        out.append((sid, "coverage_days", (us[-1] - us[0]) / 1e6 / 86400.0))
        if not len(delta):
            continue
        median = np.median(delta)
        gap = np.concatenate([[False], delta > max(4 * median, 1.0)]) if median > 0 else np.zeros(len(us), bool)
        session = np.cumsum(gap)
        out += [(sid, "session_minutes", (us[session == k][-1] - us[session == k][0]) / 1e6 / 60.0) for k in range(session[-1] + 1)]
        out += [(sid, "gap_hours", d / 3600.0) for d in delta[gap[1:]]]
    return sorted(out)


def test_sessions_of_a_hot_subject(spark):
    """One subject has a third of all events, over many hours; others have few, or stamps that repeat."""
    rng = np.random.default_rng(5)
    rows = [(1, int(x)) for x in np.cumsum(rng.integers(1, 400, 3000)) * 1_000_000]
    rows += [(int(rng.integers(2, 300)), int(rng.integers(0, 10**12))) for _ in range(6000)] + [(999, 5_000_000)] * 4 + [(998, 1)]
    df = pd.DataFrame(rows, columns=["sid", "us"])
    events = spark.createDataFrame(df)
    got = sorted((r.sid, r.metric, r.value) for r in temporal.sessions(events).collect())
    want = plain_sessions(df)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])
    medians = {r.sid: r["median"] for r in temporal.subject_medians(temporal.deltas(events)).collect()}
    assert medians[1] == pytest.approx(np.median(np.diff(np.sort([u for s, u in rows if s == 1])) / 1e6))
    all_deltas = np.diff(np.sort(df["us"].to_numpy())) / 1e6
    assert temporal.cadence(events, by_subject=False).first().seconds == pytest.approx(np.median(all_deltas))


def test_no_window_over_a_whole_subject(spark):
    """The only windows over a subject are over its hours or its buckets."""
    events = spark.range(100).selectExpr("id % 3 AS sid", "id * 1000000 AS us")
    plan = temporal.deltas(events)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(us" in plan and "[sid#" in plan and all("hour" in line or "last" in line for line in plan.splitlines() if "windowspecdefinition" in line)
