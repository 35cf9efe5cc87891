"""Formats of timestamp texts: the dominant one, and those minority formats that enough subjects share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.config import DEFAULTS, Thresholds
from veilspark.functions.timestamps import format_of


def format_counts(df: DataFrame, column: str, subject: str | None = None) -> DataFrame:
    """format (struct), count, n_subjects (without a subject column, the rows stand in)."""
    rows = df.select(format_of(F.col(f"`{column}`")).alias("format"), (F.col(f"`{subject}`") if subject else F.lit(None)).alias("sid")).filter("format IS NOT NULL")
    out = rows.groupBy("format").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("sid").alias("n_subjects"))
    return out if subject else out.withColumn("n_subjects", F.col("count"))


def disclosed_formats(counts: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """rank, dominant, template and the rest of the format, for the most frequent one (ties by template) and those
    others with at least k subjects. The dominant format is a device's, so it is free."""
    rows = counts.select("format.*", "count", "n_subjects")  # one row a shape of formats
    place = F.row_number().over(Window.orderBy(F.desc("count"), "template"))
    top = F.first("template").over(Window.orderBy(F.desc("count"), "template"))
    kept = rows.withColumns({"rank": place, "dominant": F.col("template") == top})
    return kept.filter(F.col("dominant") | (F.col("n_subjects") >= thresholds.k)).drop("rank")


def descriptor(rows: list) -> dict | None:
    """From the few collected rows of disclosed_formats: the dominant format with mixed and minority."""
    rows = sorted((r.asDict() for r in rows), key=lambda r: (not r["dominant"], -r["count"], r["template"]))
    if not rows:
        return None
    parts = [{k: r[k] for k in ("representation", "granularity", "separator", "timezone", "template")} for r in rows]
    for p in parts:
        if re.search(r"\d", p["template"]):
            raise AssertionError(f"a format template holds a value: {p['template']}")
    out = parts[0] | {"mixed": len(parts) > 1}
    return out | {"minority": parts[1:]} if len(parts) > 1 else out
