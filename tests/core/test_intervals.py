import itertools
import math
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import synthesis
from veilspark.operators.intervals import interval_join, interval_sums
from veilspark.plans.queries import ORACLES, QUERIES

INF, NAN = math.inf, math.nan


def joined(spark, points, intervals):
    p = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(points)], "p long, k string, value double")
    s = spark.createDataFrame([(j, k, a, b) for j, (k, a, b) in enumerate(intervals)], "s long, k string, lo double, hi double")
    out = interval_join(p, "value", s, "lo", "hi", ["k"])
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    return sorted((r.p, r.s) for r in out.collect())


def brute(points, intervals):
    return [(i, j) for i, (k, v) in enumerate(points) for j, (m, a, b) in enumerate(intervals) if k is not None and k == m and None not in (v, a, b) and a <= v < b]


def test_against_every_pair(spark):
    rng = np.random.default_rng(1)
    points = [("ab"[i % 2], float(v)) for i, v in enumerate(rng.normal(size=300) * 10.0 ** rng.integers(-3, 6, 300))]
    intervals = [("ab"[i % 2], float(a), float(a + w)) for i, (a, w) in enumerate(zip(rng.normal(size=80) * 100, 10.0 ** rng.uniform(-4, 6, 80), strict=True))]
    got = joined(spark, points, intervals)
    assert got == brute(points, intervals) and len(got) > 500


def test_bounds_and_odd_numbers(spark):
    tiny = float(np.nextafter(1e300, INF))
    numbers = [0.0, -0.0, 1.0, -1.0, 0.5, 1e300, tiny, -1e300, 5e-324, INF, -INF, None, NAN, 2.0**53, 2.0**53 + 2]
    points = [("a", v) for v in numbers] + [(None, 1.0), ("b", 1.0)]
    ends = [v for v in numbers if v is not None and v == v]
    intervals = [("a", a, b) for a, b in itertools.product(ends, ends)] + [("a", None, 1.0), ("a", 0.0, NAN), (None, 0.0, 2.0)]
    assert joined(spark, points, intervals) == brute(points, intervals)
    assert joined(spark, points, []) == [] == joined(spark, [], intervals)


def summed(spark, points, intervals):
    """points: value, amount; intervals: key, lo, hi. key: (points met, sum), of keys that meet any."""
    p = spark.createDataFrame(points, "value double, amount double")
    s = spark.createDataFrame(intervals, "key string, lo double, hi double")
    out = interval_sums(p, "value", s, "lo", "hi", "key", {"n": F.lit(1), "total": F.col("amount")})
    return {r.key: (r.n, r.total) for r in out.collect() if r.n}


def sums_by_pairs(points, intervals):
    out = {}
    for (v, amount), (k, a, b) in itertools.product(points, intervals):
        if None not in (v, a, b) and a <= v < b:
            n, total = out.get(k, (0, None))
            out[k] = (n + 1, total if amount is None else amount + (total or 0.0))
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 250, 600])
def test_sums_against_every_pair(spark, n):
    rng = np.random.default_rng(n)
    points = [(float(v), float(a)) for v, a in zip(rng.integers(0, 2 * n, n) / 4, rng.integers(-99, 99, n), strict=True)]
    bounds = rng.integers(-4, 2 * n + 4, (60, 2)) / 4
    intervals = [(f"k{i % 40}", float(a), float(b)) for i, (a, b) in enumerate(bounds)]
    assert summed(spark, points, intervals) == sums_by_pairs(points, intervals)


def test_sums_of_odd_numbers(spark):
    numbers = [0.0, -0.0, 1.0, 1e300, -1e300, 5e-324, INF, -INF, None, NAN, 2.0**53]
    points = [(v, 1.0) for v in numbers] + [(0.5, None), (0.5, 2.0), (7.0, None)]
    ends = [v for v in numbers if v is not None and v == v]
    intervals = [(f"{i}", a, b) for i, (a, b) in enumerate(itertools.product(ends, ends))] + [("null", None, 1.0), ("nan", 0.0, NAN), ("none", 6.0, 8.0)]
    assert summed(spark, points, intervals) == sums_by_pairs(points, intervals)
    assert summed(spark, points, []) == {} == summed(spark, [], intervals)


def test_large_numbers_outside_leave_a_sum_exact(spark):
    points = [(0.0, 1e18), (1.0, 0.25), (2.0, 0.5), (3.0, -1e18)]
    assert summed(spark, points, [("a", 1.0, 3.0), ("b", 2.0, 3.0)]) == {"a": (2, 0.75), "b": (1, 0.5)}


def test_price_ranges_of_odd_rows(spark, tmp_path):
    """Suppliers that occur twice or have no number; prices that are none."""
    spark.createDataFrame([(i, v) for i, v in enumerate([30.0, 30.5, -60.0, None, NAN, INF, 999.0, 1029.99, 1030.0])] + [(None, 31.0)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(0, 1.0), (0, 1.0), (0, -2.0), (1, 1.0), (2, None), (None, 1.0), (None, 2.0), (3, NAN), (4, INF), (5, 5000.0)], "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    sql = ORACLES["orders_in_price_ranges"]
    for t in ("orders", "supplier"):
        sql = sql.replace(f" {t} ", f" '{tmp_path}/{t}.parquet/*.parquet' ")
    want = sorted(map(str, duckdb.sql(f"SELECT s_suppkey, n_orders, total FROM ({sql})").fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES["orders_in_price_ranges"](spark, str(tmp_path)).collect()) == want and len(want) == 7


def test_price_ranges_need_no_pairs(spark, tmp_path):
    """400,000 orders in 100,000 ranges: 10,000,000,000 pairs."""
    n, m = 400_000, 100_000
    spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") / 4).alias("o_totalprice")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(m).select(F.col("id").alias("s_suppkey"), (F.col("id") % 7).cast("double").alias("s_acctbal")).write.parquet(str(tmp_path / "supplier.parquet"))
    context = spark.sparkContext
    context.setJobGroup("ranges", "price ranges", True)
    late = threading.Timer(150, lambda: context.cancelJobGroup("ranges"))
    late.start()
    try:
        got = {r.s_suppkey: (r.n_orders, r.total) for r in QUERIES["orders_in_price_ranges"](spark, str(tmp_path)).collect()}
    finally:
        late.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == m
    for k, found in got.items():
        a = 120 * (k % 7)
        b = a + 4000 * (k % 50 + 1)
        assert found == (b - a, (a + b - 1) * (b - a) / 8)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 30, 366])
def test_permutations(spark, n):
    rows = spark.range(40).select("id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: synthesis.permuted(i, n, F.col("id"))).alias("p")).collect()
    assert all(sorted(r.p) == list(range(n)) for r in rows)
    assert n < 3 or len({tuple(r.p) for r in rows}) > 3


def test_session_days_are_drawn_without_replacement(spark):
    """Any days as likely as any others: each pair, triple and quadruple of a month's first days comes about."""
    col = {"temporal_coverage": {"min_month": "2024-02", "max_month": "2024-02"}}
    days = spark.range(20_000).select(synthesis.session_days(3, "t", col, F.col("id"), F.lit(50).cast("long")).alias("d"))
    rows = [tuple(r.d) for r in days.collect()]
    assert synthesis.days_of(col["temporal_coverage"]) == 28 and all(list(r) == sorted(set(r)) and 0 <= r[0] and r[-1] <= 28 for r in rows)
    assert {len(r) for r in rows} == {2, 3, 4}
    pairs = [r for r in rows if len(r) == 2]
    seen = np.zeros((29, 29))
    for a, b in pairs:
        seen[a, b] += 1
    expect = len(pairs) / (29 * 28 / 2)
    chi = sum((seen[a, b] - expect) ** 2 / expect for a in range(29) for b in range(a + 1, 29))
    assert chi < 405 + 6 * (2 * 405) ** 0.5
    few = spark.range(5).select(synthesis.session_days(3, "t", col, F.col("id"), F.lit(1).cast("long")).alias("d")).collect()
    assert all(len(r.d) == 1 for r in few)
