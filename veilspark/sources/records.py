"""Records of delimited text, cut where a spreadsheet's or pandas' reader would cut them: a quote opens a quoted cell only
where a cell begins, and is a character like any other elsewhere; in a quoted cell two quotes are one, delimiters and line
breaks are text, and what follows the closing quote up to the delimiter belongs to the cell.

A file is read in splits, and whether a split begins inside quotes depends on all splits before it. But between lines the
reader is in one of two states only, so what a split does is a function of two states, found without knowing the first
one. These functions, one row a split, are composed in the file's order by window functions; then every split cuts its
lines knowing its true state. Only records that cross a split are moved."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDINAL = "_ordinal"


class Reader:
    """Cuts a line (what lies between two \\n) into what belongs to different records."""

    def __init__(self, delimiter: str) -> None:
        self.delimiter = delimiter
        self._quoted = re.compile('(?:[^"]++|"")*+')
        self._plain = re.compile(f"[^\r{re.escape(delimiter)}]*+")

    def cut(self, line: str, inside: bool) -> tuple[list[str], bool]:
        """The pieces, of which the first goes on with an open record if ``inside``, and whether the last one is open.
        \\r outside quotes ends a record; before a line's end it is part of that end."""
        out, begin, at, n = [], 0, 0, len(line)
        if not inside and line.startswith('"'):
            inside, at = True, 1
        while True:
            if inside:
                at = self._quoted.match(line, at).end()
                if at == n:
                    out.append(line[begin:])
                    return out, True
                inside, at = False, at + 1
            at = self._plain.match(line, at).end()
            if at == n:
                out.append(line[begin:])
                return out, False
            if line[at] == "\r":
                out.append(line[begin:at])
                if at + 1 == n:
                    return out, False
                begin = at + 1
            at += 1
            if line.startswith('"', at):
                inside, at = True, at + 1

    def cells(self, record: str) -> list[str]:
        csv.field_size_limit(sys.maxsize)
        return next(csv.reader([record], delimiter=self.delimiter), [""])


def _special(lines: pa.Array) -> pa.Array:
    """Lines with a quote, or a \\r that isn't the last character."""
    return pc.or_(pc.match_substring(lines, '"'), pc.match_substring_regex(lines, "\r."))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """Rows of one split that follow each other: (file, start), from, to."""
    files, starts = batch.column("file"), batch.column("start")
    at = 0
    if len(set(starts.to_pylist())) == 1 and len(pc.unique(files)) == 1:
        yield (files[0].as_py(), starts[0].as_py()), 0, batch.num_rows
        return
    for key, own in groupby(zip(files.to_pylist(), starts.to_pylist(), strict=True)):
        n = sum(1 for _ in own)
        yield key, at, at + n
        at += n


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """value, ORDINAL, and the split (file, start) of each line of a file, or of all files in a folder."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select("value", F.monotonically_increasing_id().alias(ORDINAL), meta["file_path"].alias("file"), meta["file_block_start"].alias("start"))


_EFFECT = "file string, start long, plain boolean, outside boolean, inside boolean, closes boolean"


def effects(lines: DataFrame, delimiter: str, skip: int) -> DataFrame:
    """One row a split: whether it ends inside quotes if it begins outside them, or inside them, and whether the open
    record ends in it in the latter case; plain: neither quotes nor single \\r. ``skip``: lines above a file's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, key, state, seen = Reader(delimiter), None, [], 0

        def row() -> pa.RecordBatch:
            values = [*key, *state]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["file", "start", "plain", "outside", "inside", "closes"])

        for batch in batches:
            for now, begin, end in _runs(batch):
                if now != key:
                    if key is not None:
                        yield row()
                    key, state, seen = now, [True, False, True, False], 0
                top = max(0, min(end - begin, skip - seen)) if key[1] == 0 else 0
                seen += end - begin
                own = batch.column("value").slice(begin + top, end - begin - top)
                for line in own.filter(_special(own)).to_pylist():
                    pieces, inside = reader.cut(line, state[2])
                    outside = inside if state[1] == state[2] else reader.cut(line, state[1])[1]
                    state = [False, outside, inside, state[3] or not inside or len(pieces) > 1]
        if key is not None:
            yield row()

    return lines.select("value", "file", "start").mapInArrow(run, _EFFECT)


def composed(found: DataFrame) -> DataFrame:
    """Of each split: whether it begins inside quotes (begins), the split its first record then began in (owner), whether
    it ends inside quotes (ends) and whether the record that is open then began in it (opened).

    A function of two states is constant, or keeps or swaps them: the state before a split is what the last constant
    one gave, swapped as often as splits since then swap."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    swaps = F.col("outside") & ~F.col("inside")
    rows = found.withColumn("swaps", F.coalesce(F.sum(swaps.cast("long")).over(before), F.lit(0)) + swaps.cast("long"))
    last = F.last(F.when(F.col("outside") == F.col("inside"), F.struct("outside", "swaps")), ignorenulls=True).over(before)
    rows = rows.withColumn("last", last).withColumn("so_far", F.coalesce(F.lag("swaps").over(Window.partitionBy("file").orderBy("start")), F.lit(0)))
    odd = (F.col("so_far") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1
    rows = rows.withColumn("begins", F.coalesce("last.outside", F.lit(False)) != odd)
    rows = rows.withColumn("ends", F.when(F.col("begins"), F.col("inside")).otherwise(F.col("outside")))
    rows = rows.withColumn("opened", F.col("ends") & (~F.col("begins") | F.col("closes")))
    owner = F.last(F.when(F.col("opened"), F.col("start")), ignorenulls=True).over(before)
    return rows.select("file", "start", "plain", "begins", "ends", "opened", F.when(F.col("begins"), owner).alias("owner"))


_CUT = f"value string, cells array<string>, {ORDINAL} long, file string, start long, owner long"


def _cut(lines: DataFrame, delimiter: str, skip: int) -> DataFrame:
    """lines with begins and owner of their split: records, with their cells where quotes matter, and pieces of records
    that cross splits, with the split that their record began in (owner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, key, inside, seen, owner, names = Reader(delimiter), None, False, 0, None, [x.split()[0] for x in _CUT.split(", ")]
        open_piece: list[str] = []
        first, out = 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out:
                kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []

        def piece() -> None:
            """What is open at the end of a split."""
            if inside:
                out.append(("\n".join(open_piece), None, first, *key, key[1] if owner is None else owner))

        for batch in batches:
            for now, begin, end in _runs(batch):
                if now != key:
                    piece()
                    # from here on ``owner`` is the split that the open record began in, None for this one
                    key, seen, open_piece = now, 0, []
                    inside, owner = batch.column("begins")[begin].as_py(), batch.column("owner")[begin].as_py()
                    first = batch.column(ORDINAL)[begin].as_py()
                top = max(0, min(end - begin, skip - seen)) if key[1] == 0 else 0
                seen += end - begin
                own, ordinals = batch.column("value").slice(begin + top, end - begin - top), batch.column(ORDINAL).slice(begin + top, end - begin - top)
                special = _special(own)
                if not inside and not pc.any(special).as_py():  # the usual case: lines are records
                    yield from flush()
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pc.replace_substring_regex(own, "\r$", ""), pa.nulls(n, pa.list_(pa.string())), ordinals, pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
                    continue
                for line, ordinal, odd in zip(own.to_pylist(), ordinals.to_pylist(), special.to_pylist(), strict=True):
                    if not odd:
                        if inside:
                            open_piece.append(line)
                        else:
                            out.append((line.removesuffix("\r"), None, ordinal, *key, None))
                        continue
                    pieces, after = reader.cut(line, inside)
                    for i, text in enumerate(pieces):
                        if i or not inside:
                            open_piece, first, owner = [], ordinal, None
                        open_piece.append(text)
                        if i + 1 < len(pieces) or not after:
                            whole = "\n".join(open_piece)
                            out.append((whole, reader.cells(whole) if owner is None and '"' in whole else None, first, *key, owner))
                    inside = after
                if len(out) >= 1000:
                    yield from flush()
        if key is not None:
            piece()
        yield from flush()

    return lines.select("value", ORDINAL, "file", "start", "begins", "owner").mapInArrow(run, _CUT)


def _joined(pieces: DataFrame, delimiter: str) -> DataFrame:
    """Records whose pieces lie in several splits."""
    parts = F.sort_array(F.collect_list(F.struct("start", "value")))
    whole = pieces.groupBy("file", "owner").agg(F.min(ORDINAL).alias(ORDINAL), F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(delimiter)
        for batch in batches:
            values = batch.column("value").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array([reader.cells(v) for v in values], pa.list_(pa.string())), batch.column(ORDINAL)], names=["value", "cells", ORDINAL])

    return whole.select("value", ORDINAL).mapInArrow(run, f"value string, cells array<string>, {ORDINAL} long")


def cells_of(spark: SparkSession, path: str, delimiter: str, skip: int) -> DataFrame:
    """cells and ORDINAL, which grows in the order of the records of a file. Blank lines are left out. A file that ends
    inside quotes is refused: where its last record began, nobody knows."""
    lines = lines_of(spark, path)
    # one row a split, as many as the reader itself plans on the driver; a file without quotes is not read again
    splits = spark.createDataFrame(composed(effects(lines, delimiter, skip)).collect(), "file string, start long, plain boolean, begins boolean, ends boolean, opened boolean, owner long")
    states = splits.select(F.every("plain").alias("plain"), F.some("ends").alias("crossed"), F.count_distinct("file").alias("files")).first()
    by_value = F.split("value", re.escape(delimiter), -1)
    if states.plain and states.files <= 1:
        rows = lines.filter(F.col(ORDINAL) >= skip).select(F.regexp_replace("value", "\r$", "").alias("value"), F.lit(None).cast("array<string>").alias("cells"), ORDINAL)
    else:
        unclosed = splits.withColumn("next", F.lead("start").over(Window.partitionBy("file").orderBy("start"))).filter("next IS NULL AND ends").first()
        if unclosed:
            raise ValueError(f"{unclosed.file} ends inside quotes")
        known = lines.join(F.broadcast(splits), ["file", "start"])
        rows = _cut(known, delimiter, skip).filter("owner IS NULL").select("value", "cells", ORDINAL)
        if states.crossed:
            crossing = known.filter("begins OR ends")
            rows = rows.unionByName(_joined(_cut(crossing, delimiter, skip).filter("owner IS NOT NULL"), delimiter))
    blank = " " if delimiter == "\t" else " \t"
    return rows.filter(F.col("cells").isNotNull() | ~F.col("value").rlike(f"^[{blank}]*$")).select(F.coalesce("cells", by_value).alias("cells"), ORDINAL)
