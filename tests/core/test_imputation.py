"""The imputer against plain solutions on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import imputation as I

NAN = float("nan")


def frame(spark, x, **more):
    names = [f"c.{i}" for i in range(x.shape[1])]  # a dot in each name
    rows = [(i, *(None if np.isnan(v) else float(v) for v in row), "kept") for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"`{n}` double" for n in names) + ", note string"), names


def matrix(df, names):
    return np.array([[NAN if r[n] is None else r[n] for n in names] for r in df.orderBy("id").collect()])


def plain_em(x, rounds=400):
    """Row by row, by inverses."""
    mean, cov = np.nanmean(x, 0), np.diag(np.nanvar(x, 0))
    for _ in range(rounds):
        full, spread = x.copy(), np.zeros_like(cov)
        for row in full:
            m = np.isnan(row)
            b = cov[np.ix_(m, ~m)] @ np.linalg.inv(cov[np.ix_(~m, ~m)])
            row[m] = mean[m] + b @ (row[~m] - mean[~m])
            spread[np.ix_(m, m)] += cov[np.ix_(m, m)] - b @ cov[np.ix_(~m, m)]
        mean = full.mean(0)
        cov = ((full - mean).T @ (full - mean) + spread) / len(x)
    return full


def gappy(rng, n, f, share, rank=2, noise=0.3):
    full = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, f)) + noise * rng.normal(size=(n, f))
    full = full * rng.uniform(0.1, 1000, f) + rng.uniform(-500, 500, f)
    return full, np.where(rng.random((n, f)) < share, NAN, full)


def test_greatest_likelihood_as_solved_row_by_row(spark):
    full, x = gappy(np.random.default_rng(1), 150, 5, 0.25)
    x = x[~np.isnan(x).all(1)]
    df, names = frame(spark, x)
    out = I.impute(df.repartition(5), names, shrink=False, rounds=400, tolerance=1e-10)
    got, want = matrix(out, names), plain_em(x)
    assert np.allclose(got[~np.isnan(x)], x[~np.isnan(x)]) and np.allclose(got, want, rtol=1e-5, atol=1e-5 * np.nanstd(x, 0).max())
    assert {r.note for r in out.collect()} == {"kept"} and out.columns == df.columns


def test_comes_to_rest_and_says_so(spark):
    _, x = gappy(np.random.default_rng(2), 200, 4, 0.2)
    df, names = frame(spark, x)
    cells = df.select(I.cells_of(df, names).alias("x"))
    assert I.fit(cells, 4).settled and not I.fit(cells, 4, rounds=2).settled


def test_the_evidence_draws_few_rows_to_the_diagonal(spark):
    """Thirty rows of sixty columns: without the prior the covariance has no inverse; with it held-out cells are
    guessed better than by means, and unrelated columns no worse than them."""
    rng = np.random.default_rng(3)
    for rank, least in ((1, 0.5), (0, -0.25)):
        full, x = gappy(rng, 30, 60, 0.1, rank or 1, 0.3 if rank else 1e6)
        df, names = frame(spark, x)
        got = matrix(I.impute(df, names), names)
        m = np.isnan(x)
        r2 = 1 - ((got - full)[m] ** 2 / np.nanvar(x, 0)[np.where(m)[1]]).sum() / (((np.nanmean(x, 0) - full) / np.nanstd(x, 0))[m] ** 2).sum()
        assert r2 > least
    moments = np.cov(rng.normal(size=(5000, 6)) @ rng.normal(size=(6, 6)), rowvar=False) * 5000
    assert I.shrunk(moments, 5000)[1] < 100  # with many rows the prior weighs next to nothing


def test_odd_columns(spark):
    x = np.array([[1.0, NAN, 5.0, NAN], [2.0, NAN, 5.0, NAN], [3.0, NAN, NAN, 7.0], [NAN, NAN, 5.0, NAN]])
    df, names = frame(spark, x)
    df = df.withColumn("c.3", F.when(F.col("id") == 0, float("inf")).otherwise(F.col("`c.3`")))
    got = matrix(I.impute(df, names), names)
    assert got[3, 0] == pytest.approx(2.0) and got[2, 2] == 5.0 and (got[:, 3] == 7.0).all() and np.isnan(got[:, 1]).all()
    assert I.impute(df.limit(0), names).count() == 0


def test_quality_is_against_the_training_means(spark):
    full, x = gappy(np.random.default_rng(5), 300, 6, 0.1)
    df, names = frame(spark, x)
    out = {r.metric: r.value for r in I.quality(df, names, I.held_out(7, 0.1, "id", 6), shrink=False, tolerance=1e-9).collect()}
    mask = np.array([r.m for r in df.select("id", I.held_out(7, 0.1, "id", 6).alias("m")).orderBy("id").collect()])
    train, held = np.where(mask, NAN, x), mask & ~np.isnan(x)
    guess, mean = plain_em(train, 200), np.nanmean(train, 0)
    e, t = np.where(held, (x - guess) ** 2, 0).sum(0), np.where(held, (x - mean) ** 2, 0).sum(0)
    assert out["cv_r2_pooled"] == pytest.approx(1 - e.sum() / t.sum(), abs=2e-4) and out["cv_r2_per_feature_median"] == pytest.approx(np.median(1 - e / t), abs=2e-4)
    assert (out["n_features"], out["n_persons"]) == (6, 300) and out["pct_missing_before"] == round(np.isnan(x).mean() * 100, 2)
    assert out["cv_r2_pooled"] > 0.5


def test_many_columns_within_memory(spark):
    """What the driver and a task hold grows with the square of the columns, not with the cube."""
    _, x = gappy(np.random.default_rng(6), 60, 300, 0.05, 3)
    df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>")
    model = I.fit(df, 300, rounds=3)
    assert model.cov.shape == (300, 300) and np.isfinite(model.fill(x)).all()
