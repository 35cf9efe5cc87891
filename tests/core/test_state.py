import random

import pytest
from pyspark.sql import functions as F

from veilspark.config import Thresholds
from veilspark.operators import profile, state
from veilspark.plans import dictionary as D
from veilspark.plans.dictionary import profile_columns
from veilspark.plans.profile_state import ProfileState
from veilspark.sources.files import ORDINAL


def test_distinct_state_counts_as_sets_do(spark):
    rows = [(i - 40, 2**63 - 1 - (i % 3), i % 2 == 0, None if i % 5 else -(2**63), f"t{i % 9}", i / 4) for i in range(100)] * 2
    df = spark.createDataFrame(rows, "a long, b long, c boolean, d long, e string, f double")
    out = {r.column: (r.n, r.pct_missing, r.cardinality) for r in profile.column_summary(profile.distinct_state(df)).collect()}
    assert out == {"a": (200, 0.0, 100), "b": (200, 0.0, 3), "c": (200, 0.0, 2), "d": (200, 80.0, 1), "e": (200, 0.0, 9), "f": (200, 0.0, 100)}
    # 100 neighbouring numbers are three words: -40 to -1 in one, 0 to 59 in another
    assert profile.distinct_state(df, ["a"]).count() == 2


def test_distinct_state_of_times_and_dates(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:00.000001' + make_dt_interval(0, 0, 0, CAST(id % 7 AS DECIMAL(18, 6))) AS t, date'1960-01-01' + CAST(id % 4 AS INT) AS d FROM range(50)")
    for zone in ("UTC", "Europe/Berlin"):  # where the clock jumps over these times
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert {r.column: r.cardinality for r in profile.column_summary(profile.distinct_state(df)).collect()} == {"t": 7, "d": 4}
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)


def test_empty_state(spark):
    df = spark.createDataFrame([], "a long, b string")
    assert profile.column_summary(profile.distinct_state(df)).count() == 0
    assert state.histogram(state.cells(df.select("a"), ["a"])).count() == 0


def _bins(df):
    return sorted((r.column, r.lo, r.hi, r["count"]) for r in df.collect())


def _case(rng, parts):
    """Values of each part: whole numbers, hundredths, tenths or anything, on scales that differ by part."""
    kinds = (lambda: float(rng.randint(-(10**6), 10**6)), lambda: rng.randint(-3000, 3000) / 100, lambda: rng.randint(-50, 50) / 10, lambda: round(rng.uniform(-1e6, 1e6), 6))
    out = []
    for p in range(parts):
        of, scale, n = rng.choice(kinds), rng.choice([0.001, 0.1, 1.0, 1000.0]), rng.choice([0, 1, 5, 60])
        out += [(p, of() * scale) for _ in range(n)]
    return out


def test_histograms_of_merged_cells_are_those_of_the_rows(spark):
    rng = random.Random(11)
    cases = {f"c{i}": _case(rng, 3) for i in range(60)}
    rows = [(p, c, v) for c, values in cases.items() for p, v in values]
    df = spark.createDataFrame(rows, "p int, c string, v double").coalesce(2)
    wide = df.select("p", *(F.when(F.col("c") == c, F.col("v")).alias(c) for c in cases)).persist()
    names, every = list(cases), Thresholds(bin_min_count=1)
    want = _bins(profile.grid_histogram(wide, names, every))
    cells = None
    for p in range(3):
        one = state.cells(wide.filter(F.col("p") == p), names)
        cells = one if cells is None else cells.unionByName(one)
    cells = spark.createDataFrame(cells.collect(), cells.schema)
    assert _bins(state.histogram(cells, every)) == want and len({b[0] for b in want}) > 50
    assert _bins(state.histogram(state.merge_cells(cells), every)) == want
    wide.unpersist()


def test_cells_are_few_and_merge_step_by_step(spark):
    rng = random.Random(5)
    parts = [[rng.gauss(0, 10**k) for _ in range(3000)] for k in range(5)] + [[7.25] * 9, [float("nan"), float("inf"), None]]
    merged = None
    for values in parts:
        one = state.cells(spark.createDataFrame([(v,) for v in values], "v double"), ["v"])
        merged = one if merged is None else state.merge_cells(merged.unionByName(one))
        # cut the plan, as a written state does
        merged = spark.createDataFrame(merged.collect(), merged.schema)
    assert merged.count() <= 1001 and merged.agg(F.sum("n")).first()[0] == 15009
    whole = spark.createDataFrame([(v,) for p in parts for v in p], "v double")
    assert _bins(state.histogram(merged)) == _bins(profile.grid_histogram(whole, ["v"]))


SCHEMA = f"{ORDINAL} long, note string, sex string, age long, score double, day string, late string, flag boolean, gone string, essay string"


def _rows(a, b):
    long = ["x" * 100, "y" * 200]
    return [(i, f"secret {i}", "ab"[i % 2] if i > 2 else f"rare{i}", 30 + i % 7, i / 8, f"2024-01-{i % 28 + 1:02d}", f"2024-01-{i % 28 + 1:02d}" if i >= 150 else "none", i % 3 == 0, None, long[i % 2]) for i in range(a, b)]


def test_profile_of_parts_is_the_profile_of_the_whole(spark, tmp_path):
    whole = profile_columns(spark.createDataFrame(_rows(0, 400), SCHEMA))
    kept = ProfileState(spark, str(tmp_path / "state"))
    assert kept.columns() == {}
    for part, (a, b) in {"1/late": (100, 400), "0 ä%": (0, 90), "0b": (90, 100)}.items():
        kept.add(part, spark.createDataFrame(_rows(a, b), SCHEMA))
    assert kept.parts() == ["0 ä%", "0b", "1/late"] and kept.columns() == whole
    assert whole["essay"]["categories"] == ["x" * 100, "y" * 200] and whole["day"]["sensitive"] and not whole["late"]["sensitive"]
    # into a dictionary, as a layer of all rows is
    D.save(spark, str(tmp_path), {"data_dir": "", "sources": {}, "files": {}})
    path = str(tmp_path / "dictionary.json")
    kept.put(path, str(tmp_path), "kept")
    D.add_layer(spark, path, str(tmp_path), "whole", spark.createDataFrame(_rows(0, 400), SCHEMA))
    files = D.load(path, spark)["files"]
    assert files["kept"] == files["whole"] and (tmp_path / "synthetic_samples" / "kept.csv").read_bytes() == (tmp_path / "synthetic_samples" / "whole.csv").read_bytes()
    # a part in place of an older one, an empty part, and one less
    kept.add("0b", spark.createDataFrame(_rows(90, 95), SCHEMA))
    kept.add("2", spark.createDataFrame([], SCHEMA))
    assert kept.columns()["note"]["n"] == 395
    kept.remove("1/late")
    assert kept.columns() == profile_columns(spark.createDataFrame(_rows(0, 95), SCHEMA))
    with pytest.raises(KeyError):
        kept.remove("1/late")


def test_parts_must_be_alike(spark, tmp_path):
    kept = ProfileState(spark, str(tmp_path / "state"))
    kept.add("a", spark.createDataFrame([(1, "x")], "n long, t string"))
    with pytest.raises(ValueError, match="other columns"):
        kept.add("b", spark.createDataFrame([("1", "x")], "n string, t string"))
    with pytest.raises(ValueError, match="other columns"):
        ProfileState(spark, kept.path, Thresholds(cardinality_cap=7)).add("b", spark.createDataFrame([(1, "x")], "n long, t string"))
    for name in ("", "_x", ".x"):
        with pytest.raises(ValueError, match="name"):
            kept.add(name, spark.createDataFrame([(1, "x")], "n long, t string"))
    assert kept.parts() == ["a"] and not [p for p in (tmp_path / "state").iterdir() if p.name.startswith("_")]


def test_a_part_is_not_read_again(spark, tmp_path):
    import shutil

    df = spark.createDataFrame(_rows(0, 50), SCHEMA)
    df.write.parquet(str(tmp_path / "rows"))
    kept = ProfileState(spark, str(tmp_path / "state"))
    kept.add("a", spark.read.parquet(str(tmp_path / "rows")))
    shutil.rmtree(tmp_path / "rows")
    kept.add("b", spark.createDataFrame(_rows(50, 80), SCHEMA))
    assert kept.columns()["age"]["n"] == 80
