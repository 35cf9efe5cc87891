"""Timestamps: epoch units, cadence labels, value-free format descriptors and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.dates import parse_mixed  # noqa: F401  (one of what is said of timestamps)

# fixed values: longest seconds between stamps, label
CADENCES = (
    (60, "~1/min or finer"),
    (300, "~1/5 min"),
    (900, "~1/15 min"),
    (3600, "~1/hour"),
    (21600, "~1/6 hours"),
    (86400, "~1/day"),
    (604800, "~1/week"),
)
COARSEST, UNKNOWN = "~coarser than weekly", "unknown"
# fixed values: seconds between stamps that a label stands for when data are made
CADENCE_SECONDS = dict((label, s) for s, label in CADENCES) | {COARSEST: 1209600, UNKNOWN: 3600}
# fixed values: cells that mean nothing
NULLISH = ("", "nan", "nat", "none", "null")

def epoch_unit(median_abs: Column) -> Column:
    """Unit of an epoch whose median size is given: s, ms, or null if it is no epoch."""
    m = median_abs
    return F.when((m >= 1e9) & (m < 1e11), "s").when((m >= 1e12) & (m < 1e14), "ms")


def from_epoch(c: Column, unit: str) -> Column:
    scale = {"s": 1e6, "ms": 1e3}[unit]
    return F.timestamp_micros(F.round(c.cast("double") * scale).cast("long"))


def cadence_label(seconds: Column) -> Column:
    label = F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0) | (seconds == float("inf")), UNKNOWN)
    for most, name in CADENCES:
        label = label.when(seconds <= most, name)
    return label.otherwise(COARSEST)


def format_of(c: Column) -> Column:
    """Descriptor of a cell's format: representation, granularity, separator, timezone, template; null if the cell
    means nothing. Only its shape counts, so no descriptor holds a digit of the data."""
    s = F.trim(c.cast("string"))
    iso = r"^\d{4}-\d{2}-\d{2}([T ])\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
    sep, sub, zone = (F.regexp_extract(s, iso, i) for i in (1, 2, 3))

    def made(representation, granularity, separator, timezone, template) -> Column:
        cells = zip(("representation", "granularity", "separator", "timezone", "template"), (representation, granularity, separator, timezone, template), strict=True)
        return F.struct(*((v if isinstance(v, Column) else F.lit(v).cast("string")).alias(n) for n, v in cells))

    subsecond = sub != ""
    timed = made(
        "iso8601", F.when(subsecond, "datetime_subsecond").otherwise("datetime"), sep,
        F.when(zone == "", "naive").when(zone == "Z", "utc").otherwise("offset"),
        F.concat(F.lit("%Y-%m-%d"), sep, F.lit("%H:%M:%S"), F.when(subsecond, ".%f").otherwise(""), F.when(zone == "", "").when(zone == "Z", "Z").otherwise("%z")),
    )
    return (
        F.when(s.isNull() | F.lower(s).isin(*NULLISH), None)
        .when(s.rlike(r"^\d{12,}$"), made("epoch_ms", "datetime", None, "naive", "epoch_ms"))
        .when(s.rlike(r"^\d+$"), made("epoch_s", "datetime", None, "naive", "epoch_s"))
        .when(s.rlike(r"^\d+\.\d+$"), made("epoch_s", "datetime_subsecond", None, "naive", "epoch_s_float"))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), made("iso8601", "date", None, "naive", "%Y-%m-%d"))
        .when(s.rlike(iso), timed)
        .otherwise(made("other", "unknown", None, "unknown", "other"))
    )


def render(ts: Column, descriptor: dict) -> Column:
    """Text of a timestamp in a format."""
    kind = descriptor.get("representation")
    if kind == "epoch_ms":
        return F.unix_millis(ts).cast("string")
    if kind == "epoch_s":
        if descriptor.get("template") == "epoch_s_float":
            return F.format_string("%.3f", F.unix_micros(ts) / 1e6)
        return F.unix_seconds(ts).cast("string")
    if descriptor.get("granularity") == "date":
        return F.date_format(ts, "yyyy-MM-dd")
    sep = "'T'" if descriptor.get("separator") == "T" else " "
    sub = ".SSSSSS" if descriptor.get("granularity") == "datetime_subsecond" else ""
    tail = {"utc": "Z", "offset": "+00:00"}.get(descriptor.get("timezone"), "")
    return F.concat(F.date_format(ts, f"yyyy-MM-dd{sep}HH:mm:ss{sub}"), F.lit(tail))
