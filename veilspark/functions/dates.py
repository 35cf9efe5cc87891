"""Dates as people write them, read cell by cell: ISO, numbers in either order, names of months, compact digits, ctime
and mail headers, with clock times of 12 or 24 hours and offsets.

A cell's shape decides what it is: the first shape that fits puts year, month and day in order and leaves the rest, which
holds a time of day or nothing. Then one text in ISO form is cast, once a cell. A shape's expression runs only where the
shapes before it don't fit, and what it yields is bound once and not computed again for each part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: how English names days and months
_DAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_NTH = r"(?:st|nd|rd|th)?"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*[ap]\.?m\.?)?"
_REST = r"((?:[T\s,].*)?)$"

#: Shapes in the order they are tried, and what they are rewritten to: year-month-day|rest.
SHAPES = (
    (rf"^(\d{{4}})([-/. ])(\d{{1,2}})\2(\d{{1,2}}){_REST}", "$1-$3-$4|$5"),
    (rf"^(1[3-9]|2\d|3[01])([-/. ])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_REST}", "$4-$3-$1|$5"),  # can't be a month
    (rf"^(\d{{1,2}})([-/. ])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_REST}", "$4-$1-$3|$5"),
    (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})((?:\D.*)?)$", "$1-$2-$3|$4:$5:$6$7"),
    (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})((?:[^\d:].*)?)$", "$1-$2-$3|$4:$5$6"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_REST}", "$1-$2-$3|$4"),
    (rf"(?i)^{_DAY}(\d{{1,2}}){_NTH}[-\s/.]+{_MONTH}\.?,?[-\s/.]+(\d{{4}}|\d{{2}}){_REST}", "$3-$2-$1|$4"),
    (rf"(?i)^{_DAY}{_MONTH}\.?[-\s]+(\d{{1,2}}){_NTH},?[-\s]+(\d{{4}}){_REST}", "$3-$1-$2|$4"),
    (rf"(?i)^{_DAY}{_MONTH}\.?\s+(\d{{1,2}})\s+({_CLOCK})\s+(\d{{4}})$", "$4-$1-$2|$3"),
    (rf"(?i)^(\d{{4}})[-/\s.]{_MONTH}[-/\s.](\d{{1,2}}){_REST}", "$1-$2-$3|$4"),
    (rf"(?i)^{_MONTH}\.?[-\s,]+(\d{{4}})$", "$2-$1-1|"),
    (r"^(\d{4})-(\d{1,2})$", "$1-$2-1|"),
    (r"^(\d{4})$", "$1-1-1|"),
)
_TIME = r"(?i)^[\sT,]*(?:at\s+)?(\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:,\d+|(\.\d{1,9})\d*)?)?)?\s*(?:([ap])\.?m\.?)?\s*(?:(z|[a-z]{3,4})|([+-])(\d{1,2}):?(\d{2})?)?\s*$"
#: Microseconds from 1970 that 64-bit nanoseconds reach; what lies beyond is no timestamp.
FARTHEST = 9_223_372_036_854_775


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _year(y: Column) -> Column:
    """Two digits mean the year less than fifty years from now."""
    now = F.year(F.current_date())
    full = y.cast("int") + F.floor(now / 100).cast("int") * 100
    return F.when(F.length(y) == 2, F.when(full >= now + 50, full - 100).when(full < now - 50, full + 100).otherwise(full)).otherwise(y.cast("int"))


def _time(rest: Column) -> Column:
    """" h:m:s.fraction zone" as a cast takes it: midnight of nothing, null of what is no time."""
    part = lambda i: F.regexp_extract(rest, _TIME, i)
    half, hour = F.lower(part(5)), part(1).cast("int")
    hour = F.when(half == "", hour).when(hour <= 12, hour % 12 + F.when(half == "p", 12).otherwise(0))
    filled = lambda i: F.when(part(i) == "", "0").otherwise(part(i))
    zone = F.when(part(7) == "", "Z").otherwise(F.concat(part(7), F.lpad(part(8), 2, "0"), F.lit(":"), F.lpad(part(9), 2, "0")))
    timed = F.concat(F.lit(" "), hour.cast("string"), F.lit(":"), filled(2), F.lit(":"), filled(3), part(4), zone)
    return F.when(F.trim(rest) == "", " 0:0:0Z").when(rest.rlike(_TIME), timed)


def _cast(found: Column) -> Column:
    """found: year-month-day|rest."""
    part = lambda i: F.regexp_extract(found, r"^(\d+)-(\w+)-(\d+)\|(.*)$", i)
    month = F.when(part(2).rlike("^[0-9]"), part(2)).otherwise(((F.call_function("locate", F.lower(F.substring(part(2), 1, 3)), F.lit(_MONTHS)) + 2) / 3).cast("int").cast("string"))
    return F.concat(F.lpad(_year(part(1)).cast("string"), 4, "0"), F.lit("-"), month, F.lit("-"), part(3), _bound(part(4), _time)).try_cast("timestamp")


def parse_mixed(c: Column) -> Column:
    """The timestamp of a text, by itself, whatever the column's other cells look like; without an offset it is UTC,
    and of two numbers that may both be a month the first one is. Null where the text is none, or a time without a date."""
    text = F.trim(c.cast("string"))
    plain = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?"
    iso = F.when(text.rlike(f"{plain}$"), F.concat(text, F.lit("Z")).try_cast("timestamp")).when(text.rlike(rf"{plain}(Z|[+-]\d{{2}}:\d{{2}})$"), text.try_cast("timestamp"))
    late = F.when(text.rlike(rf"(?i)^{_CLOCK}\s+\S"), F.regexp_replace(text, rf"(?i)^({_CLOCK})\s+(.*)$", "$2 $1")).otherwise(text)

    def shaped(t: Column) -> Column:
        found = F
        for pattern, ordered in SHAPES:
            found = found.when(t.rlike(pattern), F.regexp_replace(t, pattern, ordered))
        return _bound(found, _cast)

    ts = F.coalesce(iso, F.when(text.rlike("[0-9]"), _bound(late, shaped)))
    return F.when(F.abs(F.unix_micros(ts)) <= FARTHEST, ts)
