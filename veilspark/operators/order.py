"""Exact order statistics of any number of rows, without a task that sees them all.

Values fall into buckets whose order is theirs: 256 to each doubling, by sign and logarithm. The buckets of a group are
few, so their running counts tell in which one a rank lies, and only that one's distinct values are put in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets to each doubling, and what keeps the logarithm of the smallest double above 0.
TO_DOUBLING, ABOVE_ZERO = 256, 1100
_ALL = "_all"


def bucket(value: Column) -> Column:
    """A whole number that never falls as the value grows; finite values only."""
    v = value.cast("double")
    size = F.floor(F.log2(F.abs(v)) * TO_DOUBLING).cast("long") + ABOVE_ZERO * TO_DOUBLING
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))


def _counted(rows: DataFrame, value: str, groups: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Each group's distinct values with their counts and buckets; and its buckets, with the count before each and the
    group's total."""
    counts = rows.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("k")).withColumn("bucket", bucket(F.col(value)))
    own = Window.partitionBy(*groups)
    buckets = counts.groupBy(*groups, "bucket").agg(F.sum("k").alias("here"))
    before = F.coalesce(F.sum("here").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts, buckets.withColumns({"before": before, "total": F.sum("here").over(own)})


def quantiles(df: DataFrame, value: str, shares: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """groups, n and q, an array of the group's quantiles at the shares, by linear interpolation between neighbours.
    Null and non-finite values are left out; a group without values has no row."""
    finite = F.coalesce(~F.isnan(F.col(value).cast("double")) & (F.abs(value) < float("inf")), F.lit(False))
    names = list(groups) or [_ALL]
    rows = df.filter(finite).select(*(groups or [F.lit(0).alias(_ALL)]), F.col(value).cast("double").alias("v"))
    counts, buckets = _counted(rows, "v", names)
    place = [F.lit(float(p)) * (F.col("total") - 1) for p in shares]
    ranks = [r for p in place for r in (F.floor(p), F.ceil(p))]
    hit = F.array(*ranks).alias("ranks")
    inside = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("here"))
    wanted = buckets.withColumn("ranks", hit).filter(F.exists("ranks", inside)).select(*names, "bucket", "before", "total", "ranks")
    near = counts.join(wanted, [*names, "bucket"])
    so_far = F.sum("k").over(Window.partitionBy(*names, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    near = near.withColumn("after", so_far)
    at = lambda i: F.max(F.when((F.col("ranks")[i] < F.col("after")) & (F.col("ranks")[i] >= F.col("after") - F.col("k")), F.col("v")))
    found = near.groupBy(*names).agg(F.first("total").alias("n"), *(at(i).alias(f"r{i}") for i in range(2 * len(shares))))
    out = []
    for i, p in enumerate(shares):
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"r{2 * i}"), F.col(f"r{2 * i + 1}")
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high))
    return found.select(*groups, "n", F.array(*out).alias("q"))


def medians(df: DataFrame, value: str, groups: Sequence[str] = (), name: str = "median") -> DataFrame:
    """groups and the median of each; without groups always one row, null if there is no value.

    With groups, as of subjects, values are counted first, so what is put in order is a group's distinct values; the
    window over them runs through a table that spills, and keeps no group in memory."""
    if not groups:
        return quantiles(df, value, [0.5]).select(F.col("q")[0].alias(name)).agg(F.max(name).alias(name))
    finite = F.coalesce(~F.isnan(F.col(value).cast("double")) & (F.abs(value) < float("inf")), F.lit(False))
    counts = df.filter(finite).groupBy(*groups, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    own = Window.partitionBy(*groups).orderBy("v")
    after = F.sum("k").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.sum("k").over(Window.partitionBy(*groups).orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the values that at least half of all are at or below, and at least half at or above
    middle = counts.withColumns({"up": after, "down": before}).filter(F.abs(F.col("up") - F.col("down")) <= F.col("k"))
    return middle.groupBy(*groups).agg(((F.min("v") + F.max("v")) / 2.0).alias(name))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the rank from 1 of its finite value, ties sharing their mean (null for other values)."""
    rows = df.filter(F.col(value).isNotNull()).select(F.lit(0).alias(_ALL), F.col(value).cast("double").alias("v"))
    counts, buckets = _counted(rows, "v", [_ALL])
    near = counts.join(buckets.select("bucket", "before"), "bucket")
    so_far = F.sum("k").over(Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    ranks = near.select(F.col("v").alias("_v"), (so_far - (F.col("k") - 1) / 2.0).alias(name))
    return df.join(ranks, F.col(value).cast("double") == F.col("_v"), "left").drop("_v")


def parts(df: DataFrame, n: int, by: str, *ties: str, name: str = "part") -> DataFrame:
    """df with the number from 1 to n of the equal part that a row is in by the order of ``by`` and the ties (numbers,
    without nulls); the first parts have a row more where they can't be equal."""
    keys = [bucket(F.col(c)).alias(f"_b{i}") for i, c in enumerate((by, *ties))]
    rows = df.select("*", *keys)
    names = [f"_b{i}" for i in range(len(keys))]
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_here"))
    # one row a bucket of the order's columns, never one a row
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_here").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_here").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(by, *ties)) - 1 + F.col("_before")
    each, more = F.floor(F.col("_total") / n), F.col("_total") % n
    cut = more * (each + 1)
    part = F.when(rank < cut, F.floor(rank / (each + 1))).otherwise(more + F.floor((rank - cut) / F.greatest(each, F.lit(1)))) + 1
    return rows.join(sizes, names).withColumn(name, part.cast("int")).drop(*names, "_here", "_before", "_total")
