"""Group aggregates, effect tables and gaps of columns, as analysts' jobs use them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import numeric as N
from veilspark.operators import order

EFFECT_COLUMNS = ("beta", "effect")


def two_level_mean(df: DataFrame, unit: str, group: str, value: str) -> DataFrame:
    """group, n, mean, sd over the units' means."""
    units = df.groupBy(unit, group).agg(F.avg(value).alias("m"))
    return units.groupBy(group).agg(F.count("m").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))


def group_counts(df: DataFrame, group: str, subject: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(subject).alias("n_subjects"))


def earliest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the least by the order: a top-1 that is cut down before its shuffle."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_first", first).filter("_first = 1").drop("_first")


def tertile_means(df: DataFrame, by: str, value: str, *ties: str) -> DataFrame:
    """tertile, n, mean of value in thirds of the rows by ``by`` and the ties (numbers without nulls)."""
    rows = order.parts(df.select(by, *ties, F.col(value).alias("v")), 3, by, *ties, name="tertile")
    return rows.groupBy("tertile").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


def effects(df: DataFrame, name: str) -> DataFrame:
    """feature, and the first of EFFECT_COLUMNS under the given name."""
    found = next((c for c in EFFECT_COLUMNS if c in df.columns), None)
    if found is None:
        raise ValueError(f"no effect column of {EFFECT_COLUMNS} in {df.columns}")
    return df.select("feature", F.col(found).cast("double").alias(name))


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """shared_features, direction_concordance, effect_rank_spearman, replication_rate of two effect tables; null
    where nothing is shared (the rank correlation also for one feature). A zero effect agrees with nothing."""
    both = effects(left, "a").join(effects(right, "t"), "feature")
    same = F.coalesce((F.col("a") * F.signum("t") > 0), F.lit(False)).cast("double")
    rows = F.col("a").isNotNull() & F.col("t").isNotNull()
    ranked = order.average_ranks(order.average_ranks(both.filter(rows), "a", "ra"), "t", "rt")
    rank = ranked.agg(F.when(F.count(F.lit(1)) >= 2, F.corr("ra", "rt")).alias("effect_rank_spearman"))
    out = both.agg(F.count(F.lit(1)).alias("shared_features"), F.avg(same).alias("direction_concordance"))
    return out.join(F.broadcast(rank)).select("shared_features", "direction_concordance", "effect_rank_spearman", F.col("direction_concordance").alias("replication_rate"))


def minimum_cell_export(df: DataFrame, least: int = 5, columns: Sequence[str] = ("feature", "beta", "se", "n", "metric", "platform")) -> DataFrame:
    """The columns that leave a trusted environment, of rows with enough members."""
    return df.filter(F.coalesce(F.col("n") >= least, F.lit(False))).select(*(c for c in columns if c in df.columns))


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, pct_missing; one pass."""
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.col(c) * 100).alias("pct_missing")) for c in columns))).alias("x")).select("x.*")


def best_detected(df: DataFrame, columns: Sequence[str], top: int = 40) -> list[str]:
    """The columns with the fewest missing values."""
    return [r.column for r in missing_rates(df, columns).orderBy("pct_missing", "column").limit(top).collect()]


def masked(seed: int, share: float, *keys: Column | str) -> Column:
    """Whether a cell is held out, by a hash of its keys."""
    return N.hashed_uniform(seed, *keys) < share


def mean_quality(df: DataFrame, columns: Sequence[str], mask: Column | None = None, share: float = 0.1, key: str | None = None, least: int = 5) -> DataFrame:
    """column, n_masked, rmse, r2 of mean imputation on held-out cells: each column's mean is over the cells that
    aren't masked, and r2 is against the mean of those that are; columns of fewer than ``least`` masked cells are left out."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))
    held = mask if mask is not None else masked(7, share, F.col(key), F.col("_cell.column"))
    long = df.select("*", F.explode(cells).alias("_cell")).select(F.col("_cell.column").alias("column"), F.col("_cell.v").alias("v"), held.alias("held")).filter("v IS NOT NULL")
    means = long.groupBy("column").agg(F.avg(F.when(~F.col("held"), F.col("v"))).alias("guess"), F.avg(F.when(F.col("held"), F.col("v"))).alias("own"))
    errors = long.filter("held").join(F.broadcast(means), "column")  # one row a column
    out = errors.groupBy("column").agg(F.count(F.lit(1)).alias("n_masked"), F.sum(F.pow(F.col("v") - F.col("guess"), 2)).alias("e"), F.sum(F.pow(F.col("v") - F.col("own"), 2)).alias("t"))
    return out.filter(F.col("n_masked") >= least).select("column", "n_masked", F.sqrt(F.col("e") / F.col("n_masked")).alias("rmse"), (1 - F.col("e") / F.col("t")).alias("r2"))


def layer_counts(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.countDistinct(key).alias("n_persons"), F.count(F.lit(1)).alias("n_rows"))
