"""Temporal structure of per-subject event timelines, as k-safe aggregates of the cohort.

A timeline is (sid, us): the subject and integer microseconds. Per-subject rows stay inside the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.config import DEFAULTS, Thresholds
from veilspark.functions import numeric as N
from veilspark.functions.timestamps import cadence_label
from veilspark.operators import order
from veilspark.operators.intervals import interval_join
from veilspark.sources.scratch import written

#: A delta above so many of the subject's medians starts a session, but none of a second or less; rows a subject up
#: to which a column is a single event.
GAP_FACTOR, LEAST_GAP, SINGLE_EVENT = 4.0, 1.0, 1.1
LOW, HIGH = 0.05, 0.95
MICROS, DAY = 1_000_000.0, 86_400.0


def timeline(df: DataFrame, subject: Column | str, ts: Column | str) -> DataFrame:
    subject, ts = (F.col(c) if isinstance(c, str) else c for c in (subject, ts))
    return df.select(subject.alias("sid"), F.unix_micros(ts.cast("timestamp")).alias("us")).filter("us IS NOT NULL")


def month_bounds(events: DataFrame, *more: Column) -> DataFrame:
    """min_month, max_month, n_timestamps, and what else is asked of the rows in the same pass."""
    month = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM")
    return events.agg(month(F.min("us")).alias("min_month"), month(F.max("us")).alias("max_month"), F.count("us").alias("n_timestamps"), *more)


def _hour(us: Column) -> Column:
    return F.floor(us / (3600 * MICROS)).cast("long")


def _hours(rows: DataFrame, *subject: str) -> DataFrame:
    """One row for each hour that has stamps (of each subject): hour, first, and last before it in earlier hours."""
    hours = rows.groupBy(*subject, "hour").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    return hours.select(*subject, "hour", F.lag("last").over(Window.partitionBy(*subject).orderBy("hour")).alias("earlier"))


def deltas(events: DataFrame) -> DataFrame:
    """sid, us, delta: seconds since the subject's last stamp, null at the first. Rows without a subject are left out.

    Stamps are put in order hour by hour, and an hour's first one meets the last one before it, so a subject with a
    large share of all stamps is spread over its hours."""
    rows = events.filter("sid IS NOT NULL").select("sid", "us", _hour(F.col("us")).alias("hour"))
    rows = rows.withColumn("inside", F.lag("us").over(Window.partitionBy("sid", "hour").orderBy("us")))
    rows = rows.join(_hours(rows, "sid"), ["sid", "hour"])
    return rows.select("sid", "us", ((F.col("us") - F.coalesce("inside", "earlier")) / MICROS).alias("delta"))


def subject_medians(steps: DataFrame) -> DataFrame:
    """sid, median of its deltas (subjects of two stamps or more)."""
    return order.medians(steps.filter("delta IS NOT NULL"), "delta", ["sid"])


def cadence(events: DataFrame, by_subject: bool = True, positive: bool = False) -> DataFrame:
    """seconds, label: the median of the subjects' medians (of those above 0, if ``positive``), or of all deltas in
    order of time."""
    if by_subject:
        found = subject_medians(deltas(events))
        found = order.medians(found.filter("median > 0") if positive else found, "median", name="seconds")
    else:
        found = order.medians(global_deltas(events), "delta", name="seconds")
    return found.select("seconds", cadence_label(F.col("seconds")).alias("label"))


def global_deltas(events: DataFrame) -> DataFrame:
    """Deltas of all stamps in order of time, without one task that holds them all: each hour's stamps are ordered by
    themselves, and an hour's first one meets the last of the hours before it."""
    rows = events.select("us", _hour(F.col("us")).alias("hour"))
    inside = rows.select(((F.col("us") - F.lag("us").over(Window.partitionBy("hour").orderBy("us"))) / MICROS).alias("delta"))
    hours = rows.groupBy("hour").agg(F.min("us").alias("first"), F.max("us").alias("last"))  # one row an hour
    across = hours.select(((F.col("first") - F.lag("last").over(Window.orderBy("hour"))) / MICROS).alias("delta"))
    return inside.unionByName(across).filter("delta IS NOT NULL")


def sessions(events: DataFrame) -> DataFrame:
    """sid, metric, value: each session's length (session_minutes), each gap between two (gap_hours) and each
    subject's span (coverage_days). A subject with one stamp has a span only.

    Sessions are numbered by the gaps before a stamp: those of its hour, in order, and of the subject's earlier hours,
    of which there is one row each. Deltas and the result are written, as medians, sessions and what follows read
    them again."""
    steps = written(deltas(events))
    own = steps.join(subject_medians(steps), "sid", "left")
    limit = F.when(F.col("median") > 0, F.greatest(GAP_FACTOR * F.col("median"), F.lit(LEAST_GAP))).otherwise(float("inf"))
    cut = own.withColumn("gap", F.coalesce(F.col("delta") > limit, F.lit(False))).withColumn("hour", _hour(F.col("us")))
    running = Window.partitionBy("sid", "hour").orderBy("us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("sid").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = cut.groupBy("sid", "hour").agg(F.count_if("gap").alias("gaps")).select("sid", "hour", F.coalesce(F.sum("gaps").over(earlier), F.lit(0)).alias("gaps"))
    cut = cut.withColumn("here", F.sum(F.col("gap").cast("int")).over(running)).join(hours, ["sid", "hour"])
    cut = cut.withColumn("session", F.col("here") + F.col("gaps"))
    spans = cut.groupBy("sid", "session").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.max(F.when(F.col("gap"), F.col("delta"))).alias("before"), F.first("median").alias("median"))
    # the subject has two stamps if it has a median
    length = F.when(F.col("median").isNotNull(), (F.col("end") - F.col("start")) / MICROS / 60.0)
    parts = F.array(F.struct(F.lit("session_minutes").alias("metric"), length.alias("value")), F.struct(F.lit("gap_hours").alias("metric"), (F.col("before") / 3600.0).alias("value")))
    inner = spans.select("sid", F.explode(parts).alias("p")).select("sid", "p.metric", "p.value").filter("value IS NOT NULL")
    return written(inner.unionByName(coverage(events).select("sid", F.lit("coverage_days").alias("metric"), F.col("days").alias("value"))))


def coverage(events: DataFrame) -> DataFrame:
    """sid, days (of its span), active_days."""
    day = F.floor(F.col("us") / (DAY * MICROS))
    return events.filter("sid IS NOT NULL").groupBy("sid").agg(((F.max("us") - F.min("us")) / MICROS / DAY).alias("days"), F.countDistinct(day).alias("active_days"))


def active_day_rate(events: DataFrame) -> DataFrame:
    return coverage(events).agg(F.round(F.avg(F.col("active_days") / (F.col("days") + 1.0)), 4).alias("active_day_rate"))


def contributors(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct("sid").alias("n_contributors"), F.count(F.lit(1)).alias("n_timestamps"))


def longitudinal(counts: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """contributors() with k_safe (enough subjects), repeated (more than about one row each) and both."""
    safe, again = F.col("n_contributors") >= thresholds.k, F.col("n_timestamps") > SINGLE_EVENT * F.col("n_contributors")
    return counts.withColumns({"k_safe": safe, "repeated": again, "disclosed": safe & again})


def clipped_histogram(values: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """values: sid, metric, value. metric, lo, hi, count, n_subjects of each left-closed bin between the metric's 5th
    and 95th percentile, with at least bin_min_count values of at least k subjects."""
    rows = values.filter(N.is_finite(F.col("value")))
    # one row a metric, so these may be broadcast
    ends = order.quantiles(rows, "value", [LOW, HIGH], ["metric"])
    ends = ends.filter((F.col("n") >= 2) & (F.col("q")[1] > F.col("q")[0])).select("metric", F.col("q")[0].alias("p_low"), F.col("q")[1].alias("p_high"))
    ends = ends.withColumn("edges", N.nice_edges(F.col("p_low"), F.col("p_high")))
    inside = rows.join(F.broadcast(ends), "metric").filter(F.col("value").between(F.col("p_low"), F.col("p_high")))
    binned = inside.groupBy("metric", "edges", N.bin_of(F.col("edges"), F.col("value")).alias("i"))
    counts = binned.agg(F.count(F.lit(1)).alias("count"), F.countDistinct("sid").alias("n_subjects"), F.min("value").alias("a"), F.max("value").alias("b"))
    # one value alone in a metric would be pinned by its bin; a metric has few bins
    every = Window.partitionBy("metric")
    counts = counts.withColumn("spread", F.max("b").over(every) > F.min("a").over(every))
    counts = counts.filter(F.col("spread") & (F.col("count") >= thresholds.bin_min_count) & (F.col("n_subjects") >= thresholds.k))
    return counts.select("metric", F.round(F.get("edges", F.col("i")), 4).alias("lo"), F.round(F.get("edges", F.col("i") + 1), 4).alias("hi"), "count", "n_subjects")


def block_label(block: Column, hours: int) -> Column:
    return F.concat(F.lpad((block * hours).cast("string"), 2, "0"), F.lit("-"), F.lpad(((block + 1) * hours).cast("string"), 2, "0"))


def diurnal_counts(events: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """block, count, n_subjects, of the blocks that have events. Rows without a subject are left out."""
    hour = F.pmod(F.floor(F.col("us") / (3600 * MICROS)), F.lit(24))
    block = F.floor(hour / thresholds.diurnal_block_hours).cast("int")
    return events.filter("sid IS NOT NULL").groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("count"), F.countDistinct("sid").alias("n_subjects"))


def diurnal_profile(events: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """block (its label), weight: each block's share of the events in blocks with at least k subjects; all blocks are
    there, the others with 0."""
    n = 24 // thresholds.diurnal_block_hours
    seen = diurnal_counts(events, thresholds).filter(F.col("n_subjects") >= thresholds.k)
    total = F.sum("count").over(Window.partitionBy())  # over one row a block
    spark = events.sparkSession
    out = spark.range(n).select(F.col("id").cast("int").alias("block")).join(F.broadcast(seen), "block", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.select(block_label(F.col("block"), thresholds.diurnal_block_hours).alias("block"), F.coalesce(F.round(F.col("count") / F.nullif(total, F.lit(0)), 6), F.lit(0.0)).alias("weight"))


def tested_profile_bins(values: DataFrame, bins: DataFrame) -> DataFrame:
    """metric, lo, hi, real_subjects: for each disclosed bin the subjects with a value in it. Bins may overlap, but differ."""
    bins = written(bins.select("metric", "lo", "hi"))  # few, and read more than once
    inside = interval_join(values.select("metric", "sid", "value"), "value", bins, "lo", "hi", ["metric"])
    seen = inside.groupBy("metric", "lo", "hi").agg(F.countDistinct("sid").alias("n"))
    return bins.join(seen, ["metric", "lo", "hi"], "left").select("metric", "lo", "hi", F.coalesce("n", F.lit(0)).alias("real_subjects"))
