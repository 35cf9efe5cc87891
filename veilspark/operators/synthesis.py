"""Synthetic tables from profiles alone. Every draw is a hash of the seed, the column and the row, so a table depends on
neither partitions nor order."""

from __future__ import annotations

import calendar
import datetime
import math
import re
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.names import is_datetime_name
from veilspark.functions.numeric import hashed_uniform
from veilspark.functions.timestamps import CADENCE_SECONDS, UNKNOWN, render

# fixed values: rows a synthetic subject has, about; the format where none was disclosed; months where none are known
ROWS_PER_SUBJECT = 30
DEFAULT_FORMAT = {"representation": "iso8601", "granularity": "datetime", "separator": "T", "timezone": "utc"}
DEFAULT_MONTHS = ("2015-01", "2020-12")


def id_pool(size: int = 50) -> list[str]:
    return [f"SYNTH_{i:04d}" for i in range(size)]


def _u(seed: int, name: str, what: str, *keys: Column | str) -> Column:
    return hashed_uniform(seed, F.lit(f"{name}/{what}"), *keys)


def _whole(u: Column, n: Column | int) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(u * n).cast("long")


def weighted_pick(u: Column, values: Sequence, weights: Sequence[float]) -> Column:
    """The value whose stretch of the summed weights holds u."""
    total, at, out = float(sum(weights)), 0.0, None
    for v, w in list(zip(values, weights, strict=True))[:-1]:
        at += w / total
        out = F.when(u < at, F.lit(v)) if out is None else out.when(u < at, F.lit(v))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def month_range(coverage: dict | None) -> tuple[Column, Column]:
    """Midnight of the first month's first day and of the last month's last one."""
    low, high = (coverage["min_month"], coverage["max_month"]) if coverage and coverage.get("min_month") else DEFAULT_MONTHS
    return F.to_timestamp(F.lit(f"{low}-01")), F.last_day(F.to_date(F.lit(f"{high}-01"))).cast("timestamp")


def random_timestamp(u: Column, coverage: dict | None) -> Column:
    start, end = month_range(coverage)
    a, b = F.unix_seconds(start), F.unix_seconds(end)
    return F.timestamp_seconds(a + _whole(u, F.greatest(b - a, F.lit(1)) + 1))


def pick_hour(u: Column, v: Column, blocks: dict[str, float] | None) -> Column:
    """A block by its weight and an hour in it, each equally likely; without weights, any hour."""
    blocks = {k: max(float(w), 0.0) for k, w in (blocks or {}).items()}
    if sum(blocks.values()) <= 0:
        return _whole(u, 24)
    start = weighted_pick(u, [int(k.split("-")[0]) for k in blocks], list(blocks.values()))
    width = max(1, min(int(k.split("-")[1]) - int(k.split("-")[0]) for k in blocks))
    return start + _whole(v, width)


def draw_value(seed: int, name: str, col: dict, row: Column) -> Column:
    """A cell by what the profile discloses: histogram, categories, a number, a time, or a fake token."""
    u, v = _u(seed, name, "pick", row), _u(seed, name, "value", row)
    dtype = str(col.get("dtype", "")).lower()
    if bins := col.get("histogram"):
        weights = [b["count"] for b in bins]
        low, high = weighted_pick(u, [float(b["lo"]) for b in bins], weights), weighted_pick(u, [float(b["hi"]) for b in bins], weights)
        out = low + v * (high - low)
        return F.bround(out).cast("long") if "int" in dtype else out
    if cats := col.get("categories"):
        return F.element_at(F.array(*map(F.lit, cats)), (_whole(u, len(cats)) + 1).cast("int"))
    if "int" in dtype or "float" in dtype or "double" in dtype:
        return F.bround(v * 100).cast("long") if "int" in dtype else F.round(v * 100, 3)
    if is_datetime_name(name):
        return render(random_timestamp(v, col.get("temporal_coverage")), DEFAULT_FORMAT)
    tag = re.sub(r"[^A-Za-z0-9]", "", name)[:8] or "col"
    return F.concat(F.lit(f"FAKE_{tag}_"), F.lpad(_whole(v, 10_000).cast("string"), 4, "0"))


def _is_time(col: dict) -> bool:
    return bool(col.get("format") or col.get("temporal_distribution"))


def synthesize(spark: SparkSession, columns: dict[str, dict], n_rows: int = 100, seed: int = 0, join_keys: Sequence[str] = (), pool: Sequence[str] | None = None) -> DataFrame:
    """A table of exactly n_rows rows. If it has a join key, a pool of ids and a column with a temporal distribution,
    rows come as subjects' timelines; else each column is drawn by itself."""
    subject = next((n for n in columns if n in set(join_keys)), None)
    primary = next((n for n, c in columns.items() if c.get("temporal_distribution")), None)
    if subject and pool and primary:
        return _timelines(spark, columns, n_rows, seed, subject, list(pool), primary)
    row = F.col("id")
    out = {}
    for name, col in columns.items():
        if name in join_keys and pool:
            out[name] = F.element_at(F.array(*map(F.lit, pool)), (_whole(_u(seed, name, "id", row), len(pool)) + 1).cast("int"))
        elif col.get("format"):
            out[name] = render(random_timestamp(_u(seed, name, "time", row), col.get("temporal_coverage")), col["format"])
        else:
            out[name] = draw_value(seed, name, col, row)
    return spark.range(n_rows).select(*(c.alias(n) for n, c in out.items()))


def permuted(place: Column, n: int, *keys: Column) -> Column:
    """Where a permutation of 0 to n - 1 that the keys draw puts a place: a Feistel network over pairs from Z_a x Z_b,
    the smallest rectangle that holds n numbers. It is walked on from numbers that aren't among them, of which there are
    fewer than a, so the walk ends."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def shuffled(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), (x % b).cast("long")
        for i in range(2):
            left = F.pmod(left + _whole(hashed_uniform(2 * i, right, *keys), a), F.lit(a))
            right = F.pmod(right + _whole(hashed_uniform(2 * i + 1, left, *keys), b), F.lit(b))
        return left * b + right

    once = shuffled(place.cast("long"))
    if a * b == n:
        return once
    return F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), once, lambda x, _: F.when(x < n, x).otherwise(shuffled(x)))


def days_of(coverage: dict | None) -> int:
    """Days from the first of the range to its last."""
    low, high = (coverage["min_month"], coverage["max_month"]) if coverage and coverage.get("min_month") else DEFAULT_MONTHS
    first, last = (datetime.date(int(m[:4]), int(m[5:7]), 1) for m in (low, high))
    return (last - first).days + calendar.monthrange(last.year, last.month)[1] - 1


def session_days(seed: int, name: str, col: dict, subject: Column, want: Column) -> Column:
    """The days of a subject's sessions, from the range's first one on, in order: two to four, fewer if the range has
    fewer or the subject wants fewer stamps; drawn without replacement, any days as likely as any others."""
    days = days_of(col.get("temporal_coverage")) + 1
    n = F.least(_whole(_u(seed, name, "sessions", subject), 3) + 2, F.lit(days), want)
    return F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: permuted(i, days, F.lit(seed), F.lit(f"{name}/day"), subject)))


def stamps(seed: int, name: str, col: dict, subject: Column, days: Column, place: Column, want: Column) -> Column:
    """The place-th of a subject's ``want`` timestamps in order: a session on each of ``days``, each from an hour of the
    diurnal profile on, in steps of the cadence, none after the range's end."""
    dist, coverage = col.get("temporal_distribution") or {}, col.get("temporal_coverage")
    start, end = month_range(coverage)
    first, last = F.unix_seconds(start), F.unix_seconds(end)
    n = F.size(days).cast("long")
    each, more = F.floor(want / n), want % n
    # the first ``more`` sessions have one stamp more
    session = F.when(place < more * (each + 1), F.floor(place / (each + 1))).otherwise(more + F.floor((place - more * (each + 1)) / each))
    inside = F.when(place < more * (each + 1), place % (each + 1)).otherwise((place - more * (each + 1)) % each)
    day = F.get(days, session.cast("int"))
    hour = pick_hour(_u(seed, name, "block", subject, session), _u(seed, name, "hour", subject, session), dist.get("diurnal_blocks"))
    minute = _whole(_u(seed, name, "minute", subject, session), 60)
    step = CADENCE_SECONDS.get(dist.get("cadence"), CADENCE_SECONDS[UNKNOWN])
    return F.least(first + day * 86_400 + hour * 3_600 + minute * 60 + inside * step, last)


def _stamp_at(seed: int, name: str, col: dict, days: str, place: Column) -> Column:
    return stamps(seed, name, col, F.col("s"), F.col(days), place, F.col("w"))


def _timelines(spark: SparkSession, columns: dict[str, dict], n_rows: int, seed: int, subject: str, pool: list[str], primary: str) -> DataFrame:
    n = max(1, min(len(pool), n_rows // ROWS_PER_SUBJECT))
    each, more = divmod(n_rows, n)
    # a subject's stamps are made and sorted once (a late session may run into the next), then dealt to its rows
    subjects = spark.range(n).select(F.col("id").alias("s"), F.when(F.col("id") < more, each + 1).otherwise(each).cast("long").alias("w"))
    times = [n for n, c in columns.items() if _is_time(c)]
    places = F.sequence(F.lit(0).cast("long"), F.col("w") - 1)
    subjects = subjects.filter("w > 0").withColumns({f"_d_{i}": session_days(seed, name, columns[name], F.col("s"), F.col("w")) for i, name in enumerate(times)})
    own = [F.sort_array(F.transform(places, partial(_stamp_at, seed, name, columns[name], f"_d_{i}"))).alias(f"_t_{i}") for i, name in enumerate(times)]
    first = F.col("s") * each + F.least(F.col("s"), F.lit(more))
    subjects = subjects.select("s", first.alias("first"), F.arrays_zip(places.alias("p"), *own).alias("rows"))
    rows = subjects.select("s", "first", F.explode("rows").alias("r"))
    rows = rows.select((F.col("first") + F.col("r.p")).alias("id"), "s", *(F.timestamp_seconds(F.col(f"r._t_{i}")).alias(f"_t_{name}") for i, name in enumerate(times)))
    main = columns[primary].get("format") or DEFAULT_FORMAT
    minority = main.get("minority", [])
    out = {}
    for name, col in columns.items():
        t = F.col(f"_t_{name}") if name in times else None
        if name == subject:
            out[name] = F.element_at(F.array(*map(F.lit, pool)), (F.col("s") + 1).cast("int"))
        elif name == primary:
            text = None
            for i, fmt in enumerate(minority, 1):
                text = F.when(F.col("s") == i, render(t, fmt)) if text is None else text.when(F.col("s") == i, render(t, fmt))
            out[name] = render(t, main) if text is None else text.otherwise(render(t, main))
        elif t is not None:
            out[name] = render(t, col.get("format") or main)
        else:
            out[name] = draw_value(seed, name, col, F.col("id"))
    return rows.orderBy("id").select(*(c.alias(n) for n, c in out.items()))
