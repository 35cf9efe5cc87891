"""Continuous variants, beyond what files need: diurnal counts and fixed-gap sessions of event streams. State is
bounded by the watermark; counts are k-gated where they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.config import DEFAULTS, Thresholds


def diurnal_stream(events: DataFrame, ts: str, subject: str, late: str = "1 hour", thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """window_start, count, n_subjects of each block of hours that has enough subjects, once the watermark has passed
    it (append mode). Subjects are counted exactly: first each one's events of a block, then a block's subjects."""
    block = F.window(ts, f"{thresholds.diurnal_block_hours} hours")
    own = events.withWatermark(ts, late).filter(F.col(subject).isNotNull()).groupBy(block.alias("block"), F.col(subject).alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    counts = own.groupBy("block").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("n_subjects"))
    return counts.filter(F.col("n_subjects") >= thresholds.k).select(F.col("block.start").alias("window_start"), "count", "n_subjects")


def session_stream(events: DataFrame, ts: str, subject: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """subject, start, minutes, n of each session: stamps no further than the gap from the last."""
    session = F.session_window(ts, gap)
    out = events.withWatermark(ts, late).groupBy(session, F.col(subject)).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
    minutes = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 6e7
    return out.select(subject, "start", minutes.alias("minutes"), "n")
