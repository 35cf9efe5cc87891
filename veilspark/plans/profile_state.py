"""A table's profile kept as the partial profiles of its parts, so that a new part is profiled alone.

Parts are files, days or layers; each has a folder of small Parquet tables (distinct values, cells of numbers, whether
first values are dates, few long texts), written beside the others and moved to its place when whole. The profile is
read from these alone: no part's rows are read again. They hold values of persons and stay where the rows stay."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.config import DEFAULTS, Thresholds
from veilspark.operators import profile, state
from veilspark.plans import dictionary as D
from veilspark.sources import files as S
from veilspark.sources.store import Store, join

_SCHEMAS = {
    "distinct": "column string, value string, word long, bits long, n long",
    "cells": "column string, exponent int, cell long, n long, low double, high double",
    "first": "column string, r int, is_date boolean",
    "texts": "column string, value string, text string",
}


def few_texts(df: DataFrame, columns: Sequence[str], cap: int) -> DataFrame:
    """column, value, text: the long texts that distinct_state has digests of, of columns with at most cap values."""
    few = df.select(*(F.col(f"`{c}`") for c in columns))
    sizes = profile.column_summary(profile.distinct_state(few)).filter(F.col("cardinality") <= cap).select("column")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), profile.cell_text(df, c, True).alias("value"), F.col(f"`{c}`").cast("string").alias("text")) for c in columns))
    long = df.select(F.explode(cells).alias("c")).select("c.*").filter(F.octet_length("text") > profile.LONG)
    return long.join(F.broadcast(sizes), "column").groupBy("column", "value").agg(F.first("text").alias("text"))  # one row a column


class ProfileState:
    """path: a folder in any store, without anything else in it. Parts have the same columns of the same types; their
    order, which says what the first rows are, is that of their names."""

    def __init__(self, spark: SparkSession, path: str, thresholds: Thresholds = DEFAULTS) -> None:
        self.spark, self.path, self.thresholds = spark, path.rstrip("/"), thresholds
        self.store = Store(spark)

    def parts(self) -> list[str]:
        return sorted(unquote(n) for n in self.store.names(self.path) if not n.startswith("_"))

    def _folder(self, part: str) -> str:
        return join(self.path, quote(part, safe=""))

    def _read_meta(self, part: str) -> dict:
        return json.loads(self.store.read(join(self._folder(part), "meta.json")))

    def add(self, part: str, df: DataFrame, kinds: dict[str, str] | None = None) -> None:
        """Profiles a part, in place of an older one of its name. A part whose columns differ from the others', or that
        was counted under another cap of categories, is refused. An empty table is a part without rows."""
        if not part or part.startswith(("_", ".")):
            raise ValueError("a part's name must not be empty or begin with _ or .")
        rows = df if S.ORDINAL in df.columns else df.withColumn(S.ORDINAL, F.monotonically_increasing_id())
        kinds = kinds or D._kinds(rows)
        names = list(kinds)
        types = {n: rows.schema[n].dataType.simpleString() for n in names}
        numeric = [n for n in names if profile.is_numeric(rows.schema[n])]
        text = [n for n in names if n not in numeric]
        meta = {"kinds": kinds, "types": types, "numeric": numeric, "cap": self.thresholds.cardinality_cap}
        for other in self.parts():
            if other != part and self._read_meta(other) != meta:
                raise ValueError(f"part {part!r} has other columns or thresholds than {other!r}")
        new = join(self.path, f"_{uuid.uuid4().hex}")
        self.store.make(new)
        try:
            strings = [n for n in text if isinstance(rows.schema[n].dataType, T.StringType)]
            tables = {
                "distinct": profile.distinct_state(rows, names) if names else None,
                "cells": state.cells(D.as_numbers(rows, numeric, kinds), numeric) if numeric else None,
                "first": profile.first_dates(rows, text, S.ORDINAL) if text else None,
                "texts": few_texts(rows, strings, self.thresholds.cardinality_cap) if strings else None,
            }
            for name, schema in _SCHEMAS.items():
                out = tables[name] if tables[name] is not None else self.spark.createDataFrame([], schema)
                cast = [F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(schema)]
                out.select(*cast).write.parquet(join(new, name))
            self.store.write(join(new, "meta.json"), json.dumps(meta))
            self.store.move(new, self._folder(part))
        except BaseException:
            self.store.delete(new)
            raise

    def remove(self, part: str) -> None:
        if part not in self.parts():
            raise KeyError(part)
        self.store.delete(self._folder(part))

    def _table(self, name: str) -> DataFrame:
        """All parts' rows with ``part``, their place in order."""
        parts = self.parts()
        found = self.spark.read.schema(_SCHEMAS[name]).parquet(*(join(self._folder(p), name) for p in parts))
        # a folder's name, as its place in the path; quoted once more where the listing quotes
        places = {quote(p, safe=""): i for i, p in enumerate(parts)}
        if len(places) == 1:
            return found.withColumn("part", F.lit(0))
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
        once, twice = (F.create_map(*(F.lit(x) for p, i in m.items() for x in (p, i))) for m in (places, {quote(p, safe=""): i for p, i in places.items()}))
        return found.select("*", F.coalesce(F.try_element_at(once, folder), F.try_element_at(twice, folder)).alias("part"))

    def summary(self) -> DataFrame:
        return profile.column_summary(profile.merge_distinct(self._table("distinct")))

    def histogram(self) -> DataFrame:
        return state.histogram(self._table("cells"), self.thresholds)

    def categories(self) -> DataFrame:
        counted = state.counts(profile.merge_distinct(self._table("distinct")))
        texts = self._table("texts").groupBy("column", "value").agg(F.first("text").alias("text"))
        whole = counted.join(texts, ["column", "value"], "left")
        return profile.categories(whole.select("column", F.coalesce("text", "value").alias("value"), "count"), self.thresholds)

    def columns(self) -> dict[str, dict]:
        """As dictionary.profile_columns of all parts' rows."""
        parts = self.parts()
        if not parts:
            return {}
        meta = self._read_meta(parts[0])
        kinds, numeric = meta["kinds"], meta["numeric"]
        if not kinds:
            return {}
        text = [n for n in kinds if n not in numeric]
        summary = self.summary().persist()
        try:
            facts = {r.column: r for r in summary.collect()}  # one row a column
            dates = profile.mostly_dates(state.merge_first(self._table("first"), "part"), text) if text else None
            sensitive = {r.column: r.sensitive for r in profile.sensitive(summary, dates, list(kinds), text).collect()}
        finally:
            summary.unpersist()
        bins, named = self.histogram(), self.categories()
        return D.describe(kinds, numeric, facts, sensitive, self.thresholds, lambda few: bins.filter(F.col("column").isin(few)), lambda few: named.filter(F.col("column").isin(few)))

    def put(self, dict_path: str, out_dir: str, name: str, join_keys: Sequence[str] = ("public_client_id",)) -> dict:
        """The dictionary's entry of that name from the kept parts, as dictionary.add_layer writes it from all rows."""
        columns = self.columns()
        rows = max((c["n"] for c in columns.values()), default=0)
        return D.put_profile(self.spark, dict_path, out_dir, name, {"file_metadata": [], "row_count": rows, "columns": columns}, join_keys)
