"""Column profiles: counts, cardinalities, categories, sensitivity and grid histograms, k-safe.

One aggregate serves all of the summary, so a wide table costs one shuffle and no plan with thousands of expressions:
whole numbers meet as words of bits, 64 neighbouring values a row, other values by themselves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.config import DEFAULTS, Thresholds
from veilspark.functions import numeric as N
from veilspark.functions.names import is_sensitive_name

#: Share of distinct values above which a column identifies; rows and share that make a column one of dates.
NEAR_UNIQUE, DATE_ROWS, DATE_SHARE = 0.9, 200, 0.6
#: Bytes above which a value may be counted by its digest.
LONG = 64
MICROS_A_DAY = 86_400_000_000


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.NumericType, T.BooleanType))


def cell_text(df: DataFrame, name: str, digests: bool) -> Column:
    c = F.col(f"`{name}`").cast("string")
    is_text = isinstance(df.schema[name].dataType, T.StringType)
    return F.when(F.octet_length(c) > LONG, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(c) if digests and is_text else c


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, digests: bool = False) -> DataFrame:
    """column, value (text), count; null is a value. digests: long values are counted by their SHA-256, which is
    enough for cardinalities and keeps whole texts out of the shuffle."""
    names = list(columns or df.columns)
    cells = F.array(*(F.struct(F.lit(n).alias("column"), cell_text(df, n, digests).alias("value")) for n in names))
    return df.select(F.explode(cells).alias("c")).select("c.column", "c.value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def whole(field: T.StructField) -> Column | None:
    """The column as a whole number that differs where its values do; None if its type has none."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(field.dataType, T.BooleanType):
        return c.cast("int").cast("long")
    if isinstance(field.dataType, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(field.dataType, T.TimestampNTZType):  # by its own clock: a cast would read it in the session's zone
        seconds = F.hour(c) * 3600 + F.minute(c) * 60
        return F.unix_date(c.cast("date")).cast("long") * MICROS_A_DAY + seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_micros(c) if isinstance(field.dataType, T.TimestampType) else None


def distinct_state(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, value, word, bits, n: which values a column has, exactly, and how many rows. States of parts of a table
    are merged by merge_distinct.

    A whole number v sets bit v mod 64 of the word v div 64; bits are or-ed in fixed-width hash aggregates before and
    after the shuffle, so dense ids take a 64th of the rows, and scattered ones no more rows than values. Other values
    are texts (long ones their SHA-256) with bit 0. Rows without a value have null bits."""
    names = list(columns or df.columns)

    def cell(name: str) -> Column:
        number = whole(df.schema[name])
        if number is None:
            c = cell_text(df, name, True)
            word, bits = F.lit(None).cast("long"), F.when(c.isNotNull(), F.lit(1).cast("long"))
        else:
            c, word = F.lit(None).cast("string"), F.shiftright(number, 6)
            bits = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))
        return F.struct(F.lit(name).alias("column"), c.alias("value"), word.alias("word"), bits.alias("bits"))

    cells = df.select(F.explode(F.array(*(cell(n) for n in names))).alias("c")).select("c.*")
    return cells.groupBy("column", "value", "word").agg(F.bit_or("bits").alias("bits"), F.count(F.lit(1)).alias("n"))


def merge_distinct(states: DataFrame) -> DataFrame:
    """One distinct_state of the union of several parts' ones."""
    return states.groupBy("column", "value", "word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def column_summary(state: DataFrame) -> DataFrame:
    """From distinct_state: column, n, pct_missing, cardinality."""
    n, some = F.sum("n"), F.col("bits").isNotNull()
    missing = F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0))
    values = F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0).cast("long"))
    return state.groupBy("column").agg(n.alias("n"), F.round(missing * 100.0 / n, 2).alias("pct_missing"), values.alias("cardinality"))


def categories(counts: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """From value_counts: column, cardinality, suppressed_high_cardinality, categories (those with k rows, in order;
    null above the cardinality cap) and rare_categories_suppressed (how many have fewer)."""
    some = counts.filter(F.col("value").isNotNull())
    common = F.col("count") >= thresholds.k
    sizes = some.groupBy("column").agg(F.count(F.lit(1)).alias("cardinality"), F.count_if(~common).alias("rare"))
    few = sizes.filter(F.col("cardinality") <= thresholds.cardinality_cap).select("column")
    # one row a column, so it may be broadcast; each has at most cardinality_cap values
    kept = some.filter(common).join(F.broadcast(few), "column").groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("categories"))
    small = F.col("cardinality") <= thresholds.cardinality_cap
    out = sizes.join(F.broadcast(kept), "column", "left")
    return out.select(
        "column", "cardinality", (~small).alias("suppressed_high_cardinality"),
        F.when(small, F.coalesce("categories", F.array().cast("array<string>"))).alias("categories"),
        F.when(small, F.col("rare")).alias("rare_categories_suppressed"),
    )


def near_unique(summary: DataFrame) -> DataFrame:
    return summary.select("column", (F.col("cardinality") / F.greatest("n", F.lit(1)) > NEAR_UNIQUE).alias("near_unique"))


def first_values(df: DataFrame, columns: Sequence[str], ordinal: str | Column, n: int, of: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """column, value, r: the first n non-null values of each column in the rows' order, each as ``of`` makes it, with
    its place from 1.

    Two passes, whatever the number of columns. The first counts values by column and stretch of the order (a split of
    the scan, by its ordinals), so the second takes each column's from those stretches alone that its first n lie in;
    there, every task keeps n of a column before anything is shuffled."""
    o = (F.col(ordinal) if isinstance(ordinal, str) else ordinal).cast("long")
    stretch = F.shiftright(o, 33)
    there = F.array(*(F.col(f"`{c}`").isNotNull().cast("long") for c in columns))
    counts = df.select(stretch.alias("stretch"), F.posexplode(there).alias("i", "n")).groupBy("stretch", "i").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a stretch
    needed = counts.withColumn("before", before).filter((F.col("before") < n) & (F.col("n") > 0)).groupBy("i").agg(F.max("stretch").alias("last"))
    cells = F.array(*(of(F.col(f"`{c}`").cast("string")) for c in columns))
    rows = df.select(o.alias("o"), stretch.alias("stretch"), F.posexplode(cells).alias("i", "value")).filter("value IS NOT NULL")
    rows = rows.join(F.broadcast(needed), "i").filter(F.col("stretch") <= F.col("last"))  # one row a column
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("o"))).filter(F.col("r") <= n)
    return first.select(F.get(F.lit(list(columns)), F.col("i")).alias("column"), "value", "r")


def first_dates(df: DataFrame, columns: Sequence[str], ordinal: str | Column) -> DataFrame:
    """column, r, is_date: whether each of the first DATE_ROWS non-null values, in the rows' order, begins with a date."""
    first = first_values(df, columns, ordinal, DATE_ROWS, lambda c: F.substring(c, 1, 10))
    return first.select("column", "r", F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}").alias("is_date"))


def mostly_dates(first: DataFrame, columns: Sequence[str]) -> DataFrame:
    """From first_dates: column, date_valued."""
    found = first.groupBy("column").agg((F.avg(F.col("is_date").cast("double")) >= DATE_SHARE).alias("date_valued"))
    names = first.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(found), "column", "left").select("column", F.coalesce("date_valued", F.lit(False)).alias("date_valued"))


def date_valued(df: DataFrame, columns: Sequence[str], ordinal: str | Column) -> DataFrame:
    """column, date_valued: whether most of the first DATE_ROWS non-null values, in the rows' order, begin with a date;
    of columns without values, no."""
    return mostly_dates(first_dates(df, columns, ordinal), columns)


def grid_histogram(df: DataFrame, columns: Sequence[str], thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """column, lo, hi, count of each left-closed bin on a round grid with at least bin_min_count rows. Null and
    non-finite values are left out; a column with fewer than two distinct values has no bins."""
    cells = F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("double").alias("v")) for n in columns))
    long = df.select(F.explode(cells).alias("c")).select("c.column", "c.v").filter(N.is_finite(F.col("v")))
    # one row a column, so it may be broadcast
    grid = long.groupBy("column").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low < high").select("column", N.nice_edges(F.col("low"), F.col("high")).alias("edges"))
    counts = long.join(F.broadcast(grid), "column").groupBy("column", "edges", N.bin_of(F.col("edges"), F.col("v")).alias("i")).agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") >= thresholds.bin_min_count).select("column", F.get("edges", F.col("i")).alias("lo"), F.get("edges", F.col("i") + 1).alias("hi"), "count")


def cohort_size(df: DataFrame, subject: str) -> DataFrame:
    return df.agg(F.countDistinct(subject).alias("cohort_n"))


def sensitive_columns(df: DataFrame, summary: DataFrame, ordinal: str) -> DataFrame:
    """column, sensitive: by name, or for text columns by near-unique or date-like values."""
    text = [f.name for f in df.schema if not is_numeric(f) and f.name != ordinal]
    return sensitive(summary, date_valued(df, text, ordinal) if text else None, df.columns, text)


def sensitive(summary: DataFrame, dates: DataFrame | None, columns: Sequence[str], text: Sequence[str]) -> DataFrame:
    """column, sensitive, from column_summary and from date_valued of the text columns."""
    named = [n for n in columns if is_sensitive_name(n)]
    out = near_unique(summary)
    out = out.withColumn("date_valued", F.lit(False)) if dates is None else out.join(dates, "column", "left")
    is_text = F.col("column").isin(*text) if text else F.lit(False)
    by_name = F.col("column").isin(*named) if named else F.lit(False)
    return out.select("column", (by_name | (is_text & (F.col("near_unique") | F.coalesce("date_valued", F.lit(False))))).alias("sensitive"))
