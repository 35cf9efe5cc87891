"""Statistical disclosure control of one output table."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.config import DEFAULTS, Thresholds
from veilspark.functions.names import find_count_column, is_identifier_name


@dataclass
class Verdict:
    #: allow, suppress or block.
    status: str
    reason: str
    #: The very rows that were checked and may be released, at most row_cap; None if blocked.
    rows: list[Row] | None = None
    schema: T.StructType | None = None

    def table(self, like: DataFrame) -> DataFrame | None:
        """The rows as a table of the same session."""
        return None if self.rows is None else like.sparkSession.createDataFrame(self.rows, self.schema)

    def csv(self) -> str:
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(self.schema.names)
        writer.writerows(["" if v is None else v for v in row] for row in self.rows)
        return out.getvalue()


def suppress_small_cells(df: DataFrame, count_column: str, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Rows whose count is at least k; a null or unreadable count is too small."""
    return df.filter(F.coalesce(F.col(f"`{count_column}`").try_cast("double") >= thresholds.k, F.lit(False)))


def over_the_cap(thresholds: Thresholds = DEFAULTS) -> Verdict:
    return Verdict("block", f"more rows than the cap of {thresholds.row_cap}")


def check_table(df: DataFrame, thresholds: Thresholds = DEFAULTS) -> Verdict:
    """Too many rows or an identifying column block a table; small cells are dropped; else it is clean. The table is
    computed once, up to one row over the cap, and the verdict holds the rows it is about."""
    column = find_count_column(df.columns)
    small = F.lit(False) if column is None else ~F.coalesce(F.col(f"`{column}`").try_cast("double") >= thresholds.k, F.lit(False))
    found = df.select(small.alias("small"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")).limit(thresholds.row_cap + 1).collect()
    if len(found) > thresholds.row_cap:
        return over_the_cap(thresholds)
    if named := next((c for c in df.columns if is_identifier_name(c)), None):
        return Verdict("block", f"identifier-like column: {named}")
    kept = [r.row for r in found if not r.small]
    if gone := len(found) - len(kept):
        return Verdict("suppress", f"{gone} cells smaller than k={thresholds.k} dropped", kept, df.schema)
    return Verdict("allow", "clean aggregate", kept, df.schema)
