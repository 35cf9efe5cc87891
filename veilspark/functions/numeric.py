"""Binning on round grids, finite tests and hashed uniforms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bins that a range is cut into, about.
TARGET_BINS = 10
# fixed values: multiples of a power of ten that a step may be
STEP_MULTIPLES = (1.0, 2.0, 2.5, 5.0, 10.0)


def is_finite(c: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def nice_step(span: Column) -> Column:
    """The least allowed multiple of a power of ten that is at least a tenth of the span; 1 if that isn't above 0 and
    finite. Depends on the span alone, so edges fall on a round grid, never on a value of the data."""
    raw = span / TARGET_BINS
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.coalesce(*(F.when(raw <= m * power, m * power) for m in STEP_MULTIPLES), 10.0 * power)
    return F.when(is_finite(span) & (span > 0), step).otherwise(F.lit(1.0))


def nice_edges(low: Column, high: Column) -> Column:
    """Array of edges from the grid point at or below low to the one above high."""
    step = nice_step(high - low)
    start, stop = F.floor(low / step) * step, (F.floor(high / step) + 1) * step
    n = F.round((stop - start) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.round(start + i * step, 10))


def bin_of(edges: Column, value: Column) -> Column:
    """The place, from 0, of the left-closed bin that holds the value."""
    return F.size(F.filter(edges, lambda e: e <= value)) - 1


def hashed_uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone, not on partitions or order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)
