from datetime import datetime, timedelta

import pytest

from veilspark.config import Thresholds
from pyspark.sql import functions as F

from veilspark.operators import disclosure, formats, groups, profile, temporal
from veilspark.plans.dictionary import profile_columns, temporal_distribution
from veilspark.sources.files import ORDINAL

DAY0 = datetime(2024, 1, 1)


def events(spark, rows):
    df = spark.createDataFrame([(s, t) for s, t in rows], "sid string, t timestamp")
    return temporal.timeline(df, "sid", "t")


def regular(subjects=12, days=5, hours=range(8, 14)):
    return [(f"s{i}", DAY0 + timedelta(days=d, hours=h)) for i in range(subjects) for d in range(days) for h in hours]


def test_histogram_drops_small_bins_and_non_finite_values(spark):
    values = [float(i % 20) for i in range(200)] + [99.0] * 4 + [float("inf"), float("nan"), None]
    out = profile.grid_histogram(spark.createDataFrame([(v,) for v in values], "v double"), ["v"]).orderBy("lo").collect()
    assert sum(r["count"] for r in out) == 200 and all(r["count"] >= 5 and r.hi - r.lo == 10 for r in out)
    assert profile.grid_histogram(spark.createDataFrame([(1.0,)] * 50, "v double"), ["v"]).count() == 0


def test_column_profiles(spark):
    rows = [(i, f"secret {i}", "ab"[i % 2] if i > 2 else "rare", 30 + i % 7, f"2024-01-{i % 28 + 1:02d}", None) for i in range(60)]
    df = spark.createDataFrame(rows, f"{ORDINAL} long, note string, sex string, age long, day string, gone string")
    out = profile_columns(df)
    assert out["note"] == {"dtype": "object", "n": 60, "pct_missing": 0.0, "cardinality": 60, "sensitive": True, "values_suppressed": True, "categories": None}
    assert out["sex"]["categories"] == ["a", "b"] and out["sex"]["rare_categories_suppressed"] == 1
    assert out["day"]["sensitive"] and out["gone"]["pct_missing"] == 100.0 and out["gone"]["categories"] == []
    assert sum(b["count"] for b in out["age"]["histogram"]) == 60


def test_cardinality_cap(spark):
    df = spark.createDataFrame([(f"v{i % 51}",) for i in range(1000)], "v string")
    assert profile.categories(profile.value_counts(df)).first().suppressed_high_cardinality
    assert profile.categories(profile.value_counts(df), Thresholds(cardinality_cap=51)).first().categories[0] == "v0"


def test_first_values_of_many_columns(spark):
    """As taken column by column; columns with few values, or late ones, and stretches of the order."""
    rows = [(i // 40 << 33 | i, *(None if (i * 7 + c) % (c + 1) or (c == 5 and i < 300) else f"{c}-{i}" for c in range(8)), None) for i in range(400)]
    df = spark.createDataFrame(rows, "o long, " + ", ".join(f"`v.{c}` string" for c in range(8)) + ", none string").repartition(6)
    names = [c for c in df.columns if c != "o"]
    got = {}
    for r in profile.first_values(df, names, "o", 30).collect():
        got.setdefault(r.column, set()).add(r.value)
    want = {n: {x for x in [r[i] for r in rows if r[i] is not None][:30]} for i, n in enumerate(names, 1)}
    assert got == {n: v for n, v in want.items() if v} and len(got) == 7
    wide = spark.range(50).select(F.col("id").alias("o"), *(F.when(F.col("id") > c % 7, F.lit("2024-01-01")).alias(f"c{c}") for c in range(600)))
    plan = profile.date_valued(wide, wide.columns[1:], "o")
    assert plan.filter("date_valued").count() == 600 and plan._jdf.queryExecution().executedPlan().toString().count("Range (0, 50") <= 4


def test_date_valued_looks_at_the_first_rows(spark):
    rows = [(i, "2024-01-01" if i < 150 else "x") for i in range(5000)]
    df = spark.createDataFrame(rows[::-1], "o long, v string")
    assert profile.date_valued(df, ["v"], "o").first().date_valued
    assert not profile.date_valued(df.filter("o >= 150"), ["v"], "o").first().date_valued


def test_distribution(spark):
    out = temporal_distribution(events(spark, regular()))
    assert set(out) == {"n_contributors", "cadence", "session_minutes", "gap_hours", "diurnal_blocks", "coverage_days", "active_day_rate"}
    assert out["n_contributors"] == 12 and out["cadence"] == "~1/hour"
    assert list(out["diurnal_blocks"]) == ["00-04", "04-08", "08-12", "12-16", "16-20", "20-24"] and sum(out["diurnal_blocks"].values()) == pytest.approx(1)


@pytest.mark.parametrize("rows", [[(f"s{i}", DAY0) for i in range(20)], regular(subjects=3), []])
def test_no_distribution(spark, rows):
    assert temporal_distribution(events(spark, rows)) is None


def test_block_of_one_subject_is_zero(spark):
    rows = [(f"s{i}", DAY0 + timedelta(days=d, hours=h)) for i in range(8) for d in range(4) for h in range(10, 14)] + [("lone", DAY0 + timedelta(days=d, hours=2)) for d in range(4)]
    blocks = temporal_distribution(events(spark, rows))["diurnal_blocks"]
    assert blocks["00-04"] == 0.0 and sum(blocks.values()) == pytest.approx(1)


def test_every_bin_has_enough_subjects(spark):
    rows = [(f"s{i}", DAY0 + timedelta(days=d)) for i in range(6) for d in range(40)]
    rows += [(f"s{i}", DAY0 + timedelta(days=2, minutes=5 * j)) for i in range(2) for j in range(60)]
    assert all(r.n_subjects >= 5 and r["count"] >= 5 for r in temporal.clipped_histogram(temporal.sessions(events(spark, rows))).collect())


def test_sessions(spark):
    t = [0, 10, 20, 30, 500, 510]
    rows = [("a", DAY0 + timedelta(minutes=m)) for m in t] + [("b", DAY0)] + [("c", DAY0), ("c", DAY0), ("c", DAY0 + timedelta(hours=9))] + [(None, DAY0)]
    got = {}
    for r in temporal.sessions(events(spark, rows)).collect():
        got.setdefault((r.sid, r.metric), []).append(round(r.value, 6))
    assert sorted(got["a", "session_minutes"]) == [10.0, 30.0] and got["a", "gap_hours"] == [round(470 / 60, 6)]
    assert got["b", "coverage_days"] == [0.0] and ("b", "session_minutes") not in got
    assert got["c", "coverage_days"] == [0.375]
    assert not [k for k in got if k[0] is None]


def test_global_cadence_across_days(spark):
    rows = [("x", DAY0 + timedelta(hours=30 * i)) for i in range(10)]
    assert temporal.cadence(events(spark, rows), by_subject=False).first().seconds == 30 * 3600


def test_formats(spark):
    rows = [(f"s{i}", "2024-01-02T03:04:05Z") for i in range(12) for _ in range(3)] + [(f"p{i}", "2024-01-02 03:04:05") for i in range(6)] + [(f"q{i}", "2024-01-02T03:04:05.250Z") for i in range(2)]
    df = spark.createDataFrame(rows, "sid string, t string")
    found = formats.descriptor(formats.disclosed_formats(formats.format_counts(df, "t", "sid")).collect())
    assert found["template"] == "%Y-%m-%dT%H:%M:%SZ" and found["mixed"] and [m["template"] for m in found["minority"]] == ["%Y-%m-%d %H:%M:%S"]
    assert formats.descriptor([]) is None


@pytest.mark.parametrize(
    ("rows", "schema", "status", "left"),
    [
        ([(i,) for i in range(100)], "x int", "block", None), ([(i,) for i in range(20)], "val int", "allow", 20), ([("a", 9)], "email string, n int", "block", None),
        ([("a", 100), ("b", 3)], "group string, count int", "suppress", 1), ([("a", 100), ("b", 80)], "group string, count int", "allow", 2),
        ([("a", 100), ("b", 2)], "group string, n_patients int", "suppress", 1), ([("a", 80), ("b", None)], "group string, sample_size int", "suppress", 1), ([("a", "many")], "group string, n string", "suppress", 0),
    ],
)
def test_check_table(spark, rows, schema, status, left):
    verdict = disclosure.check_table(spark.createDataFrame(rows, schema))
    assert verdict.status == status and (None if verdict.rows is None else len(verdict.rows)) == left


def test_reconcile(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", -1.0), ("z", 2.0)], "feature string, beta double")
    same = groups.reconcile(a, a.withColumnRenamed("beta", "effect")).first()
    assert same[:] == (3, 1.0, pytest.approx(1.0), 1.0)
    flip = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 2.0)], "feature string, effect double")
    assert groups.reconcile(a, flip).first().direction_concordance == pytest.approx(2 / 3)
    none = groups.reconcile(a, spark.createDataFrame([("q", 1.0)], "feature string, beta double")).first()
    assert none.shared_features == 0 and none.direction_concordance is None and none.effect_rank_spearman is None
    with pytest.raises(ValueError):
        groups.reconcile(a, spark.createDataFrame([("q", 1.0)], "feature string, other double"))


def test_gaps_of_columns(spark):
    rows = [(f"p{i}", float(i % 10), 2.0 * (i % 10) + 1 if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "public_client_id string, a double, b double")
    assert groups.best_detected(df, ["b", "a"], 1) == ["a"]
    quality = groups.mean_quality(df, ["a", "b"], key="public_client_id").collect()
    assert {r.column for r in quality} == {"a", "b"} and all(r.r2 < 0.2 for r in quality)


def test_earliest_and_masks(spark):
    df = spark.createDataFrame([(k, d) for k in range(5) for d in (3, 1, 2)], "k int, d int")
    assert {r.d for r in groups.earliest_per_key(df, "k", "d").collect()} == {1}
    assert 60 < spark.range(1000).filter(groups.masked(1, 0.1, "id")).count() < 140
    assert groups.minimum_cell_export(spark.createDataFrame([("a", 1.0, 4), ("b", 1.0, 5), ("c", 1.0, None)], "feature string, beta double, n int")).count() == 1
