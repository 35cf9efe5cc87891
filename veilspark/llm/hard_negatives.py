"""Hard-negative mining with exact integer scores by the method of the Four Russians.

A vector's integers are cut into bit planes (two's complement), and the bits of eight dimensions of a plane are one byte.
For an anchor, and each group of eight dimensions, a table holds the sums of all 256 subsets of its eight components. A
candidate's score is then read off: from the highest plane down, what is there so far is doubled, and the table entries
that the plane's bytes point at are added. Nothing is estimated.

Anchors and candidates meet in pairs of blocks, each of a bounded size. Positives are sought among the blocks of the
anchor's label alone, negatives among all, since the band they must lie in is known only by then."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import common as C

#: Dimensions of a group: one byte.
GROUP = 8
#: Positives of an anchor, negatives of a pair; the band, in per cent of the positive's score.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Integers are the floors of so many times a component.
SCALE = 256
#: Anchors and candidates of a block, about; anchors and candidates that are scored together, so that sums stay in cache.
ANCHORS, CANDIDATES, TOGETHER, AT_ONCE = 512, 8192, 32, 2048
#: No inner product may reach this.
_MOST = 2**62


def planes_for(low: int, high: int) -> int:
    """Bits of two's complement that hold all of low to high."""
    return max((x if x >= 0 else ~x).bit_length() for x in (low, high)) + 1


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """(n, d) integers to (n, planes, groups) bytes: bit j of byte g of plane k is bit k of dimension 8 g + j."""
    n, d = values.shape
    groups = -(-d // GROUP)
    wide = np.zeros((n, groups * GROUP), np.int64)
    wide[:, :d] = values
    out = np.empty((n, planes, groups), np.uint8)
    for k in range(planes):
        out[:, k] = np.packbits((wide >> k & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def subset_sums(values: np.ndarray) -> np.ndarray:
    """(anchors, d) integers to (groups, 256, anchors): the sums of every subset of each eight dimensions."""
    n, d = values.shape
    groups = -(-d // GROUP)
    wide = np.zeros((n, groups * GROUP), values.dtype)
    wide[:, :d] = values
    parts = wide.reshape(n, groups, GROUP).transpose(1, 2, 0)
    out = np.zeros((groups, 1 << GROUP, n), values.dtype)
    for j in range(GROUP):  # the upper half of the subsets so far has dimension j, too
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + parts[:, j : j + 1]
    return out


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(candidates, anchors): the inner products, shifted and added from looked-up sums."""
    planes, groups = packed.shape[1], packed.shape[2]
    total = np.zeros((len(packed), tables.shape[2]), tables.dtype)
    for k in range(planes - 1, -1, -1):
        plane = tables[0][packed[:, k, 0]]
        for g in range(1, groups):
            plane += tables[g][packed[:, k, g]]
        if k == planes - 1:  # the sign's plane
            np.negative(plane, out=plane)
        np.left_shift(total, 1, out=total)
        total += plane
    return total


def _first(values: np.ndarray, sound: np.ndarray, k: int) -> np.ndarray:
    """Where the k greatest of the sound values are, greatest first; of equal ones the earlier first."""
    at = np.flatnonzero(sound)
    if len(at) > k:
        own = values[at]
        border = np.partition(own, len(own) - k)[len(own) - k]
        at = at[own >= border]
        if len(at) > k:  # ties at the border
            own = values[at]
            at = np.concatenate([at[own > border], at[own == border][: k - int((own > border).sum())]])
    return at[np.lexsort((at, -values[at]))]


def _integers(table: pa.Table | pa.RecordBatch, column: str = "v") -> np.ndarray:
    lists = table.column(column)
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def _sound(rows: DataFrame) -> DataFrame:
    """id, label, v (whole numbers) and d of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & (F.size(e) > 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(e, lambda x: F.floor(SCALE * x)).cast("array<long>").alias("v"), F.size(e).alias("d"))


def _packed(rows: DataFrame, planes: int) -> DataFrame:
    """rows with their bit planes as bytes."""
    schema = T.StructType([*rows.schema, T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = [b""] * batch.num_rows
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                for i, row in zip(at, pack(_integers(batch.take(pa.array(at))), planes), strict=True):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _meet(anchors: DataFrame, candidates: DataFrame, sizes: DataFrame, keys: list[str], few: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of their blocks, each row once for each block of the other side. ``sizes``: a and c,
    the rows of either side by ``keys``; ``few`` marks those of its rows that may be broadcast."""
    sizes = sizes.select(F.struct(*keys).alias("key"), F.ceil(F.col("a") / ANCHORS).cast("int").alias("ab"), F.ceil(F.col("c") / CANDIDATES).cast("int").alias("cb"), few.alias("few"))
    both = []
    for side, own, other, name, its in ((anchors, "ab", "cb", "ablock", "cblock"), (candidates, "cb", "ab", "cblock", "ablock")):
        rows = C.join_hot(side.withColumn("key", F.struct(*keys)), sizes, "key", F.col("few"), "inner")
        both.append(rows.select(*side.columns, F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(name), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(its)))
    return both[0], both[1]


def _scored(anchors: pa.Table, candidates: pa.Table, planes: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each anchor its row and its scores with all candidates of a block."""
    values = _integers(anchors)
    packed = np.frombuffer(b"".join(candidates.column("packed").to_pylist()), np.uint8).reshape(candidates.num_rows, planes, -1)
    bound = int(np.abs(values).max(initial=0)) * values.shape[1] << planes
    values = values.astype(np.int32 if bound < 2**31 else np.int64)
    for i in range(0, len(values), TOGETHER):
        tables = subset_sums(values[i : i + TOGETHER])
        parts = [scores(tables, packed[j : j + AT_ONCE]) for j in range(0, len(packed), AT_ONCE)]
        for j, own in enumerate(np.ascontiguousarray(np.concatenate(parts).T)):
            yield i + j, own


def mine(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of ``anchors`` and each of
    its five best rows of the same label, the ten best rows of other labels whose score lies between 30 and 90 per cent of
    the positive's. Both have vec_id, label and embedding.

    Rows with a null vec_id or label, a null or empty vector, or a null or non-finite component take no part; vectors of
    another length than the anchor's don't meet it. Scores are inner products of floor(256 x), higher first, ties by
    smaller vec_id. Rows with the anchor's own id aren't its candidates; other ids that repeat are candidates as often as
    they occur; of an anchor id's rows the one of least label and vector is the anchor. A zero or negative positive has
    the band that the inequalities leave (zero alone; none). Integers whose inner products could exceed 64 bits are
    refused. Empty tables give no rows; other columns, whatever their names, are left out; there are no texts.
    """
    scratch = C.Scratch(rows.sparkSession, "hard-negatives")
    base = scratch.put(_sound(rows), "rows")
    span = base.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"), F.max("d").alias("d"), F.count(F.lit(1)).alias("n")).first()
    low, high, n = span.low or 0, span.high or 0, span.n
    planes = planes_for(low, high)
    if max(abs(low), abs(high)) * (span.d or 0) << planes >= _MOST:
        raise ValueError("components are too large for inner products in 64 bits")
    candidates = scratch.put(_packed(base.select("id", "label", "d", "v"), planes).drop("v"), "packed")
    asked = _sound(anchors).groupBy("id").agg(F.min(F.struct("label", "v", "d")).alias("r")).select("id", "r.label", "r.v", "r.d")
    asked = scratch.put(asked, "anchors")

    best = "anchor_id long, positive_id long, positive_score long"

    def positives(a: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and c.num_rows:
            c = c.sort_by("id")
            ids, own_ids = c.column("id").to_numpy(), a.column("id").to_numpy()
            for i, own in _scored(a, c, planes):
                at = _first(own, ids != own_ids[i], POSITIVES)
                out += zip([own_ids[i]] * len(at), ids[at], own[at], strict=True)
        return pa.table([pa.array([int(r[x]) for r in out], pa.int64()) for x in range(3)], ["anchor_id", "positive_id", "positive_score"])

    by = ["d", "label"]
    sizes = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).join(asked.groupBy(*by).agg(F.count(F.lit(1)).alias("a")), by)
    a, c = _meet(asked, candidates.select("id", "label", "d", "packed"), sizes, by, F.col("c") >= C.HOT_SHARE * n)
    keys = [*by, "ablock", "cblock"]
    found = a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(positives, best)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    found = scratch.put(found.withColumn("p", rank).filter(F.col("p") <= POSITIVES), "positives")

    # the band of each positive, with the anchor
    bands = found.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("p", "positive_score")).alias("bands"))
    asked = scratch.put(asked.join(bands.hint("merge"), "id"), "asked")

    def negatives(a: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and c.num_rows:
            c = c.sort_by("id")
            ids, labels, own_ids, own_labels = c.column("id").to_numpy(), c.column("label").to_numpy(), a.column("id").to_numpy(), a.column("label").to_numpy()
            bands = a.column("bands").to_pylist()
            for i, own in _scored(a, c, planes):
                other = (labels != own_labels[i]) & (ids != own_ids[i])
                for band in bands[i]:
                    score = band["positive_score"]
                    least, most = -(-LEAST * score // 100), MOST * score // 100
                    if least <= most:
                        at = _first(own, other & (own >= least) & (own <= most), NEGATIVES)
                        out += zip([own_ids[i]] * len(at), [band["p"]] * len(at), ids[at], own[at], strict=True)
        return pa.table([pa.array([int(r[x]) for r in out], pa.int64()) for x in range(4)], ["anchor_id", "p", "negative_id", "negative_score"])

    by = ["d"]
    sizes = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).join(asked.groupBy(*by).agg(F.count(F.lit(1)).alias("a")), by)
    a, c = _meet(asked, candidates.select("id", "label", "d", "packed"), sizes, by, F.col("c") >= C.HOT_SHARE * n)
    keys = [*by, "ablock", "cblock"]
    below = a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(negatives, "anchor_id long, p long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "p").orderBy(F.desc("negative_score"), "negative_id"))
    below = scratch.put(below.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES), "negatives")
    scratch.keep("positives", "negatives")
    return below.join(found, ["anchor_id", "p"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(rows, rows.filter(F.col("vec_id") % 100 == 0))


OP12_SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
