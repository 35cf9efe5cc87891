"""Joins of numbers with intervals, as equi-joins, and sums over the numbers in each interval, without the join.

Interval lengths fall into doublings. A grid whose cells are as wide as a doubling is laid over all intervals of that
length, so each of them touches three cells at most, and a number lies in one cell of each grid there is. Numbers and
intervals are joined by grid and cell, and what meets is tested by its true bounds. Widths are powers of two, so cells are
exact. Intervals may overlap, and lie as densely as they like.

For sums, the distinct numbers and bounds get their places in one order, and sums are kept of blocks of neighbours: of 16,
of 16 of those, and so on. An interval is a few blocks of each size, so the work grows with numbers and intervals, and not
with the pairs that meet. Nothing is subtracted, so no digits are lost to sums that are larger than the interval's own."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.sources.scratch import written

#: Cells are numbered with whole numbers below this; a number beyond lies in no cell of that grid.
FARTHEST = 2.0**62
#: The grid, of one cell, of intervals without an end.
ENDLESS = 5000
#: A block holds two to this many of the next smaller ones; what monotonically_increasing_id has for a partition's own rows.
BLOCK_BITS, ROW_BITS = 4, 33


def _cell(value: Column, level: Column) -> Column:
    place = value / F.pow(F.lit(2.0), level)
    return F.when(level == ENDLESS, F.lit(0).cast("long")).when(F.abs(place) < FARTHEST, F.floor(place).cast("long"))


def _levels(lo: Column, hi: Column) -> Column:
    """The doubling of the length, at least as wide; no narrower than doubles near the bounds can be told apart."""
    length = F.greatest(hi - lo, F.greatest(F.abs(lo), F.abs(hi)) * 2.0**-52, F.lit(2.0**-1000))
    return F.when((F.abs(lo) == math.inf) | (F.abs(hi) == math.inf) | (length == math.inf), F.lit(ENDLESS)).otherwise(F.ceil(F.log2(length)).cast("int"))


def interval_join(points: DataFrame, value: str, intervals: DataFrame, lo: str, hi: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each row of points with each row of intervals of the same keys where lo <= value < hi. Columns other than the
    keys have different names. Nulls, NaN and intervals that end before they begin meet nothing."""
    names = list(keys)
    a, b, v = (F.col(c).cast("double") for c in (lo, hi, value))
    spans = intervals.filter((a < b) & ~F.isnan(a) & ~F.isnan(b)).withColumn("_level", _levels(a, b))
    # the lengths' doublings are few, whatever the number of intervals
    levels = [r[0] for r in spans.select("_level").distinct().collect()]
    spans = spans.withColumn("_cell", F.explode(F.when(F.col("_level") == ENDLESS, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(_cell(a, F.col("_level")), _cell(b, F.col("_level"))))))
    sound = points.filter(v.isNotNull() & ~F.isnan(v))
    placed = sound.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = placed.withColumn("_cell", _cell(v, F.col("_level"))).filter("_cell IS NOT NULL")
    met = placed.join(spans, [*names, "_level", "_cell"])
    return met.filter((v >= a) & (v < b)).drop("_level", "_cell")


def _in_order(numbers: DataFrame) -> DataFrame:
    """numbers: v, each one once. With its place, from 0, in the order of all."""
    rows = written(numbers.repartitionByRange("v").sortWithinPartitions("v").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS).alias("_part")
    # one row a partition
    parts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_part", part).join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part")
    return rows.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(2**ROW_BITS - 1)).drop("_part", "_before", "_at")


def _blocks_between(first: Column, end: Column, top: int) -> Column:
    """Structs of level, from, to: the largest blocks that make up the places from first to end, without it."""
    up = lambda j: F.shiftright(first + (2 ** (BLOCK_BITS * j) - 1), BLOCK_BITS * j)
    down = lambda j: F.shiftright(end, BLOCK_BITS * j)
    run = lambda j, a, b: F.struct(F.lit(j).alias("level"), a.alias("from"), b.alias("to"))
    out = [run(top, up(top), down(top))]
    for j in range(top):
        larger, a, b = up(j + 1) < down(j + 1), F.shiftleft(up(j + 1), BLOCK_BITS), F.shiftleft(down(j + 1), BLOCK_BITS)
        out += [run(j, up(j), F.when(larger, a).otherwise(down(j))), run(j, F.when(larger, b).otherwise(down(j)), down(j))]
    return F.array(*out)


def interval_sums(points: DataFrame, value: str, intervals: DataFrame, lo: str, hi: str, key: str, sums: Mapping[str, Column]) -> DataFrame:
    """The key of intervals, and sums over the points with lo <= value < hi, by name; of a key with several intervals,
    over all of them. Keys whose intervals hold no point have no row, or nulls. What meets is as in interval_join."""
    a, b, v = (F.col(c).cast("double") for c in (lo, hi, value))
    spans = intervals.filter((a < b) & ~F.isnan(a) & ~F.isnan(b)).select(F.col(key).alias("key"), a.alias("lo"), b.alias("hi"))
    own = points.filter(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    bounds = spans.select(F.explode(F.array("lo", "hi")).alias("v")).distinct().withColumn("_bound", F.lit(True))
    total = [F.sum(F.col(n)).alias(n) for n in sums]
    both = own.unionByName(bounds, allowMissingColumns=True).groupBy("v").agg(*total, F.max("_bound").alias("_bound"))
    places = written(_in_order(both))
    n, top = places.count(), 0
    while 2 ** (BLOCK_BITS * (top + 1)) < n:
        top += 1

    block = lambda c, j: F.shiftright(c, BLOCK_BITS * j)
    blocks = places.select(F.lit(0).alias("level"), F.col("place").alias("block"), *sums)
    if top:
        small = written(places.groupBy(block(F.col("place"), 1).alias("block")).agg(*total))
        levels = F.explode(F.array(*(F.struct(F.lit(j).alias("level"), block(F.col("block"), j - 1).alias("block")) for j in range(1, top + 1))))
        blocks = blocks.unionByName(small.select(levels.alias("b"), *sums).groupBy("b.level", "b.block").agg(*total))

    at = places.filter("_bound")
    first, end = (at.select(F.col("v").alias(c), F.col("place").alias(f"{c}_place")) for c in ("lo", "hi"))
    runs = spans.join(first, "lo").join(end, "hi").select("key", F.explode(_blocks_between(F.col("lo_place"), F.col("hi_place"), top)).alias("r")).select("key", "r.*").filter("from < to")
    pieces = runs.select("key", "level", F.explode(F.sequence("from", F.col("to") - 1)).alias("block"))
    return pieces.join(blocks, ["level", "block"]).groupBy(F.col("key").alias(key)).agg(*total)
