"""Mergeable partial profiles: what parts of a table say of its columns, kept so that the whole's profile is exact.

Distinct values are profile.distinct_state. Numbers are counted on a decimal grid that is at least ten times finer than
the bins of their own part's histogram. Bins of a wider range are never finer, and every allowed step is a multiple of a
finer power of ten, so a cell lies whole in one bin of any later whole: histograms of merged cells are those of the rows,
and a part's column has at most about a thousand cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.config import DEFAULTS, Thresholds
from veilspark.functions import numeric as N
from veilspark.operators import profile

#: Powers of ten that a cell is finer than the power of ten of its part's bins.
FINER = 1


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n.cast("double"))


def _edge(cell: Column, exponent: Column) -> Column:
    """cell * 10^exponent as the double nearest to that decimal, so an edge is the same number on every grid that has it."""
    return F.when(exponent < 0, cell / _power(-exponent)).otherwise(cell * _power(exponent))


def _cell(value: Column, exponent: Column) -> Column:
    """The greatest cell whose left edge is at or below the value."""
    near = F.floor(F.when(exponent < 0, value * _power(-exponent)).otherwise(value / _power(exponent)))
    return F.when(_edge(near, exponent) > value, near - 1).when(_edge(near + 1, exponent) <= value, near + 1).otherwise(near)


def _exponent(low: Column, high: Column) -> Column:
    """Of the cells of a part with these ends; null where there is but one value, which fits any grid."""
    return F.when(high > low, F.floor(F.log10((high - low) / N.TARGET_BINS)).cast("int") - FINER)


def cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, exponent, cell, n, low, high of the finite values of one part: a cell's rows and the least and greatest of
    its values. A column with one value has a single row without exponent and cell."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns))).alias("c")).select("c.*")
    long = long.filter(N.is_finite(F.col("v")))
    ends = long.groupBy("column").agg(F.min("v").alias("a"), F.max("v").alias("b")).select("column", _exponent(F.col("a"), F.col("b")).alias("exponent"))
    rows = long.join(F.broadcast(ends), "column")  # one row a column
    return _gather(rows.select("column", "exponent", _cell(F.col("v"), F.col("exponent")).alias("cell"), F.lit(1).cast("long").alias("n"), F.col("v").alias("low"), F.col("v").alias("high")))


def _gather(rows: DataFrame) -> DataFrame:
    return rows.groupBy("column", "exponent", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def merge_cells(states: DataFrame) -> DataFrame:
    """cells of the union of several parts: all of a column's on the coarser grid that the whole's range asks for."""
    ends = states.groupBy("column").agg(F.min("low").alias("a"), F.max("high").alias("b")).select("column", _exponent(F.col("a"), F.col("b")).alias("to"))
    rows = states.join(F.broadcast(ends), "column")  # one row a column
    coarser = F.floor(F.col("cell") / _power(F.col("to") - F.col("exponent")))
    cell = F.when(F.col("to").isNull(), None).when(F.col("exponent").isNull(), _cell(F.col("low"), F.col("to"))).otherwise(coarser)
    return _gather(rows.select("column", F.col("to").alias("exponent"), cell.cast("long").alias("cell"), "n", "low", "high"))


def histogram(states: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """column, lo, hi, count, as profile.grid_histogram of all rows that the cells were made of."""
    ends = states.groupBy("column").agg(F.min("low").alias("a"), F.max("high").alias("b")).filter("a < b")
    grid = F.broadcast(ends.select("column", N.nice_edges(F.col("a"), F.col("b")).alias("edges")))  # one row a column
    # a cell lies in one bin, that of any of its values
    counts = states.join(grid, "column").groupBy("column", "edges", N.bin_of(F.col("edges"), F.col("low")).alias("i")).agg(F.sum("n").alias("count"))
    return counts.filter(F.col("count") >= thresholds.bin_min_count).select("column", F.get("edges", F.col("i")).alias("lo"), F.get("edges", F.col("i") + 1).alias("hi"), "count")


def merge_first(states: DataFrame, part: str) -> DataFrame:
    """column, r, is_date of the union of parts' profile.first_dates, the parts in the order of ``part``: the first
    DATE_ROWS of the whole. At most DATE_ROWS rows a column and part come in."""
    place = F.row_number().over(Window.partitionBy("column").orderBy(part, "r"))
    return states.select("column", place.alias("r"), "is_date").filter(F.col("r") <= profile.DATE_ROWS)


def counts(state: DataFrame) -> DataFrame:
    """profile.value_counts of the text columns in a distinct_state."""
    return state.filter("word IS NULL").select("column", "value", F.col("n").alias("count"))
