"""Imputation by one multivariate normal distribution, fitted to incomplete rows by expectation-maximisation.

A round is one aggregate. Tasks sweep the covariance on the cells that a pattern of gaps leaves known, once for each
pattern they meet, which gives the regressions of the missing cells on the known ones; they sum the expected first and
second moments into one matrix of (F + 1)². The driver gets the sum of these matrices, whatever the number of rows, and
takes the next mean and covariance from it, until they no longer change. With few rows for the number of columns the
covariance is drawn towards its diagonal as far as the data's own evidence asks for."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import numeric as N
from veilspark.sources.scratch import written

#: Weights of the diagonal, in rows for each row there is, among which the evidence chooses.
WEIGHTS = np.logspace(-6, 3, 73)
#: Added to variances of 1, so that columns that say the same can be told apart.
JITTER = 1e-9
#: A column counts as constant below this share of its size.
CONSTANT = 1e-12
#: Rows that a task handles together.
TOGETHER = 4096


@dataclass
class Normal:
    """The fitted distribution of the columns, each less ``centre`` and divided by ``scale``; columns without a spread
    have their mean alone, and columns without any known cell none."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    #: Columns that vary.
    varies: np.ndarray
    #: Rounds it took, whether they came to rest, and the weight of the diagonal in rows.
    rounds: int = 0
    settled: bool = False
    weight: float = 0.0

    def fill(self, x: np.ndarray) -> np.ndarray:
        """(rows, columns) with NaN for gaps, filled with what is expected given a row's known cells."""
        out = np.where(np.isnan(x), self.centre, x)
        own = np.flatnonzero(self.varies)
        if len(own):
            z, _ = expected((x[:, own] - self.centre[own]) / self.scale[own], self.mean, self.cov)
            out[:, own] = np.where(np.isnan(x[:, own]), z * self.scale[own] + self.centre[own], x[:, own])
        return out


def expected(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x with its gaps at their expected values, and the sum over rows of the gaps' conditional covariances."""
    gap = np.isnan(x)
    out, spread = np.where(gap, mean, x), np.zeros_like(cov)
    holed = np.flatnonzero(gap.any(1))
    if not len(holed):
        return out, spread
    patterns, of = np.unique(np.packbits(gap[holed], axis=1), axis=0, return_inverse=True)
    order, of = np.argsort(of.ravel(), kind="stable"), of.ravel()
    starts = np.searchsorted(of[order], np.arange(len(patterns) + 1))
    for i in range(len(patterns)):
        rows = holed[order[starts[i] : starts[i + 1]]]
        m = gap[rows[0]]
        o = ~m
        if o.any():
            # the covariance swept on the known cells: regressions, and what they leave over
            b = np.linalg.solve(cov[np.ix_(o, o)], cov[np.ix_(o, m)])
            out[np.ix_(rows, m)] = mean[m] + (x[np.ix_(rows, o)] - mean[o]) @ b
            spread[np.ix_(m, m)] += len(rows) * (cov[np.ix_(m, m)] - cov[np.ix_(m, o)] @ b)
        else:
            spread += len(rows) * cov
    return out, spread


def _matrix(lists: pa.ListArray, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _summed(cells: DataFrame, n: int, shape: tuple[int, int], work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a matrix that ``work`` gives for some of them. What reaches the driver has its shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            x = _matrix(batch.column(0), n)
            for i in range(0, len(x), TOGETHER):
                total += work(x[i : i + TOGETHER])
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def add(own: pa.Table) -> pa.Table:
        return pa.table({"i": own.column("i").slice(0, 1), "v": pa.array([_matrix(own.column("v").combine_chunks(), shape[1]).sum(0)], pa.list_(pa.float64()))})

    rows = cells.select("x").mapInArrow(run, "i int, v array<double>").groupBy("i").applyInArrow(add, "i int, v array<double>").toArrow()
    out = np.zeros(shape)
    for i, v in zip(rows.column("i").to_pylist(), rows.column("v"), strict=True):
        out[i] = v.values.to_numpy()
    return out


def _log_gammas(f: int, a: float) -> float:
    return sum(math.lgamma(a - j / 2) for j in range(f))


def shrunk(moments: np.ndarray, n: float) -> tuple[np.ndarray, float]:
    """The covariance that sums of squares over n rows give, with an inverse Wishart prior around its diagonal, whose
    weight is the one under which the sums are likeliest; and that weight."""
    d = np.diag(moments) / n
    root = np.sqrt(d)
    values = np.maximum(np.linalg.eigvalsh(moments / np.outer(root, root)), 0.0)
    f = len(d)
    best, weight = -math.inf, 0.0
    for k in WEIGHTS * n:
        nu = k + f + 1
        evidence = _log_gammas(f, (nu + n) / 2) - _log_gammas(f, nu / 2) + nu / 2 * f * math.log(k) - (nu + n) / 2 * float(np.log(k + values).sum())
        if evidence > best:
            best, weight = evidence, k
    return (moments + weight * np.diag(d)) / (n + weight), weight


def column_moments(cells: DataFrame, n: int) -> np.ndarray:
    """Of each column the number of known cells, their sum and their sum of squares."""
    return _summed(cells, n, (3, n), lambda x: np.vstack([(~np.isnan(x)).sum(0), np.nansum(x, 0), np.nansum(x * x, 0)]))


def fit(cells: DataFrame, n: int, shrink: bool = True, rounds: int = 100, tolerance: float = 1e-6) -> Normal:
    """cells: x, the row's n numbers, NaN for gaps. ``shrink``: with the prior; without it the fit is that of greatest
    likelihood. Comes to rest once no mean changes by more than ``tolerance`` standard deviations, nor a covariance by
    as much of the product of two; every round takes one pass over the cells."""
    known, total, squares = column_moments(cells, n)
    with np.errstate(all="ignore"):
        centre = np.where(known > 0, total / known, np.nan)
        scale = np.sqrt(np.maximum(squares / known - centre**2, 0.0))
    varies = (known > 1) & (scale > CONSTANT * np.maximum(np.abs(centre), 1e-300))
    own = np.flatnonzero(varies)
    f = len(own)
    model = Normal(centre, np.where(varies, scale, 1.0), np.zeros(f), np.eye(f), varies)
    if not f:
        model.settled = True
        return model
    for model.rounds in range(1, rounds + 1):
        mean, cov, at, by = model.mean, model.cov, centre[own], scale[own]

        def work(x: np.ndarray, mean=mean, cov=cov, at=at, by=by) -> np.ndarray:
            z, spread = expected((x[:, own] - at) / by, mean, cov)
            z = np.column_stack([np.ones(len(z)), z])
            total = z.T @ z
            total[1:, 1:] += spread
            return total

        sums = _summed(cells, n, (f + 1, f + 1), work)
        count = sums[0, 0]
        new = sums[0, 1:] / count
        moments = sums[1:, 1:] - count * np.outer(new, new)
        moments = (moments + moments.T) / 2 + JITTER * count * np.eye(f)
        next_cov, model.weight = shrunk(moments, count) if shrink else (moments / count, 0.0)
        sd = np.sqrt(np.diag(next_cov))
        change = max(np.abs((new - mean) / sd).max(), np.abs((next_cov - cov) / np.outer(sd, sd)).max())
        model.mean, model.cov = new, next_cov
        if change <= tolerance:
            model.settled = True
            break
    return model


def cells_of(df: DataFrame, columns: Sequence[str]) -> Column:
    """The columns as one array of doubles; what is null or not finite is a gap, NaN."""
    gap = F.lit(float("nan"))
    x = lambda c: F.col(f"`{c}`").cast("double")
    return F.array(*(F.when(F.abs(x(c)) < math.inf, x(c)).otherwise(gap) for c in columns))


def _filled(df: DataFrame, n: int, model: Normal, column: str, out: str) -> DataFrame:
    """df with the array ``out``: the array ``column`` without gaps."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.schema.names.index(column)), n)
            full = [shared.value.fill(x[i : i + TOGETHER]) for i in range(0, len(x), TOGETHER)]
            lists = pa.array([row for part in full for row in part], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return df.mapInArrow(run, schema)


def impute(df: DataFrame, columns: Sequence[str], shrink: bool = True, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """df with the gaps of the columns, now doubles, filled with what is expected given each row's other columns. Known
    cells stay as they are. A column without known cells stays empty, and gaps of a constant one get its value."""
    names = list(columns)
    held = written(df.select(cells_of(df, names).alias("x")))
    model = fit(held, len(names), shrink, rounds, tolerance)
    plain = [f"c{i}" for i in range(len(df.columns))]  # columns may have any name
    rows = df.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(df.columns, plain, strict=True)), cells_of(df, names).alias("x"))
    full = _filled(rows, len(names), model, "x", "full")
    value = lambda i: F.when(~F.isnan(F.get("full", i)), F.get("full", i))
    return full.select(*((value(names.index(c)) if c in names else F.col(p)).alias(c) for c, p in zip(df.columns, plain, strict=True)))


def held_out(seed: int, share: float, key: str, n: int) -> Column:
    """Which of a row's n cells are held out: an array of booleans, by a hash of the key and the cell's place."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: N.hashed_uniform(seed, F.col(key), i) < share)


def quality(df: DataFrame, columns: Sequence[str], mask: Column, least: int = 5, shrink: bool = True, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """metric, value of the imputer on cells held out of the fit (``mask``: an array of booleans in the columns' order):
    cv_r2_pooled over all of them, cv_r2_per_feature_median over columns with at least ``least`` of them, n_features,
    n_persons (rows), pct_missing_before. Both R² are against each column's mean over the cells that were not held out."""
    n = len(columns)
    cells = df.select(cells_of(df, columns).alias("v"), mask.alias("mask"))
    hidden = F.zip_with("v", "mask", lambda v, m: F.when(m, F.lit(float("nan"))).otherwise(v))
    held = written(cells.withColumn("x", hidden))
    model = fit(held, n, shrink, rounds, tolerance)
    cell = F.explode(F.filter(F.transform("v", lambda v, i: F.struct(i.alias("i"), v.alias("v"), F.get("full", i).alias("guess"), F.get("mask", i).alias("mask"))), lambda c: c["mask"] & ~F.isnan(c["v"]) & ~F.isnan(c["guess"])))
    errors = _filled(held.select("v", "mask", "x"), n, model, "x", "full").select(cell.alias("c")).select("c.*")
    centre = F.get(F.array(*(F.lit(float(c)) for c in model.centre)), F.col("i"))
    by_column = errors.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col("v") - F.col("guess"), 2)).alias("e"), F.sum(F.pow(F.col("v") - centre, 2)).alias("t"))
    own = F.when((F.col("n") >= least) & (F.col("t") > 0), 1 - F.col("e") / F.col("t"))
    r2 = by_column.agg((1 - F.sum("e") / F.nullif(F.sum("t"), F.lit(0.0))).alias("pooled"), F.median(own).alias("middle"))
    share = held.agg(F.count(F.lit(1)).alias("rows"), (F.avg(F.aggregate("v", F.lit(0), lambda a, v: a + F.isnan(v).cast("int"))) * 100 / n).alias("missing"))
    one = r2.join(F.broadcast(share))  # one row each
    metrics = {"cv_r2_pooled": F.round("pooled", 4), "cv_r2_per_feature_median": F.round("middle", 4), "n_features": F.lit(float(n)), "n_persons": F.col("rows").cast("double"), "pct_missing_before": F.round("missing", 2)}
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()))).alias("m")).select("m.*")
