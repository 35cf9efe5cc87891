"""Approximate nearest neighbours: 2-stable (Gaussian) projections to few dimensions, indexed by a kd-tree. A query
meets the points in the order of their projected distance and verifies their true distances until a chi-square test
says that what is left can hardly be nearer.

The upper part of the tree is fitted on a bounded sample; its leaves are cells of all points, each of which has its own
lower part. A query goes through the cell it lies in, and with the distance it found there through those other cells
alone that the same test leaves over."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import common as C

#: Dimensions of the projection (even, for the closed form of the chi-square distribution), and the seed it is drawn with.
DIMENSIONS, SEED = 32, 20240601
#: A neighbour is missed with a probability of at most 1 - SURE.
SURE = 0.95
#: Points of a cell, about, and of a leaf; points verified between two tests (at first, then up to four times as many); queries that go through a cell together.
CELL, LEAF, CHUNK, BLOCK = 20_000, 512, 32, 2_000
#: Points that the cells' borders are fitted on, about.
SAMPLE = 10_000


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p; m even: P = 1 - exp(-x/2) * sum of (x/2)^i / i! for i < m/2."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        done = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if done < p else (low, x)
    return high


def axes(d: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((d, DIMENSIONS))


def _widest(points: np.ndarray) -> int:
    return int(np.argmax(points.max(0) - points.min(0)))


def beyond(near: np.ndarray | float, test: float, far: float) -> np.ndarray | bool:
    """Whether squared projected distances say that the true ones exceed ``far``; a bit of room for rounding."""
    return near * (1 - 1e-9) > test * far * far + 1e-12


@dataclass
class Cells:
    """The tree's upper part: (axis, border, below, above) of each split, where a number under 0 is cell -1 - number."""

    splits: list[tuple[int, float, int, int]]
    count: int

    @classmethod
    def fit(cls, points: np.ndarray, count: int) -> Cells:
        """Borders that part the sample into ``count`` equal cells, fewer where points lie together."""
        splits: list[tuple[int, float, int, int]] = []
        cells = 0

        def part(own: np.ndarray, n: int) -> int:
            nonlocal cells
            axis = _widest(own) if len(own) > 1 else 0
            side = own[:, axis] if len(own) else np.zeros(0)
            border = np.quantile(side, (n // 2) / n) if n > 1 and len(own) > 1 else 0.0
            if n < 2 or len(own) < 2 or not 0 < (low := side <= border).sum() < len(own):
                cells += 1
                return -cells
            at = len(splits)
            splits.append((axis, float(border), 0, 0))
            splits[at] = axis, float(border), part(own[low], n // 2), part(own[~low], n - n // 2)
            return at

        part(points, count)
        return cls(splits, cells)

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))] if self.splits else []
        while todo:
            at, own = todo.pop()
            axis, border, below, above = self.splits[at]
            low = points[own, axis] <= border
            for to, part in ((below, own[low]), (above, own[~low])):
                if to < 0:
                    out[part] = -1 - to
                elif len(part):
                    todo.append((to, part))
        return out


class ProjectionTree:
    """A kd-tree over the projections of distinct vectors, split at medians of the widest side. ids: for each vector
    the ids that have it."""

    def __init__(self, ids: list[np.ndarray], vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.axes = axes(vectors.shape[1])
        self.points = self.vectors @ self.axes
        self.test = chi_square_quantile(SURE, DIMENSIONS)
        leaves, todo = [], [np.arange(len(ids))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            half = len(own) // 2
            by = np.argpartition(self.points[own, _widest(self.points[own])], half)
            todo += [own[by[:half]], own[by[half:]]]
        self.leaves = leaves
        self.low = np.array([self.points[x].min(0) for x in leaves])
        self.high = np.array([self.points[x].max(0) for x in leaves])

    def search(self, own_id: int, query: np.ndarray, k: int, bound: float = math.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and distances of the k nearest found, nearest first, ties to the smaller id, and how many vectors were
        verified. ``bound``: a distance that k others are known to keep to."""
        q = query @ self.axes
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        boxes = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(boxes, kind="stable")
        best_ids, best, verified, far, step = np.empty(0, np.int64), np.empty(0), 0, bound, CHUNK
        wait, wait_near = np.empty(0, np.int64), np.empty(0)
        for at, leaf in enumerate(order):
            if beyond(boxes[leaf], self.test, far) and not len(wait):
                break
            own = self.leaves[leaf]
            off = self.points[own] - q
            near = np.einsum("ij,ij->i", off, off)
            hope = ~beyond(near, self.test, far)
            wait, wait_near = np.concatenate([wait, own[hope]]), np.concatenate([wait_near, near[hope]])
            # those no farther than the next leaf's box come in their order now
            now = wait_near <= (boxes[order[at + 1]] if at + 1 < len(order) else math.inf)
            ready, ready_near = wait[now], wait_near[now]
            wait, wait_near = wait[~now], wait_near[~now]
            by = np.argsort(ready_near, kind="stable")
            ready, ready_near = ready[by], ready_near[by]
            i = 0
            while i < len(ready):
                if beyond(ready_near[i], self.test, far):
                    return best_ids, best, verified
                some = ready[i : i + step]
                i, step = i + step, min(2 * step, 4 * CHUNK)
                off = self.vectors[some] - query
                true = np.sqrt(np.einsum("ij,ij->i", off, off))
                verified += len(some)
                hope = true <= far
                if not hope.any():
                    continue
                ids = np.concatenate([best_ids, *(self.ids[x] for x in some[hope])])
                best = np.concatenate([best, np.repeat(true[hope], [len(self.ids[x]) for x in some[hope]])])
                keep = np.flatnonzero(ids != own_id)
                keep = keep[np.lexsort((ids[keep], best[keep]))[:k]]
                best_ids, best = ids[keep], best[keep]
                if len(best) == k:
                    far = min(far, best[-1])
        return best_ids, best, verified


def _valid(df: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(e, lambda x: x != 0)
    return df.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), e.alias("v"), F.size(e).alias("d"))


def _distinct(base: DataFrame, k: int) -> DataFrame:
    """v, d and the smallest k + 1 ids of each distinct vector, as often as they have it (k times at most): no query
    needs more of them. A vector of very many rows is cut down before it is shuffled."""
    counted = base.groupBy("v", "d", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy("v", "d").orderBy("id"))).filter(F.col("r") <= k + 1)
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "n"))), lambda x: F.array_repeat(x["id"], x["n"])))
    return first.groupBy("v", "d").agg(ids.alias("ids"))


def _placed(df: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """df with the cell that v lies in."""
    shared = df.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int32)
            for d in pdf["d"].unique():
                if d in shared.value:
                    at = np.flatnonzero(pdf["d"] == d)
                    cell[at] = shared.value[d].of(np.vstack(pdf["v"].iloc[at].to_numpy()) @ axes(d))
            yield pdf.assign(cell=cell)

    return df.mapInPandas(run, T.StructType([*df.schema, T.StructField("cell", T.IntegerType())]))


def _boxes(points: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vectors its cells' numbers and the least and greatest projections in them: one row a cell."""
    sides = [f"{x}{i}" for x in "ab" for i in range(DIMENSIONS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (d, cell), own in pdf.groupby(["d", "cell"]):
                p = np.vstack(own["v"].to_numpy()) @ axes(d)
                yield pd.DataFrame([[d, cell, *p.min(0), *p.max(0)]], columns=["d", "cell", *sides])

    rows = points.select("v", "d", "cell").mapInPandas(run, ", ".join(["d int", "cell int", *(f"{x} double" for x in sides)]))
    found = rows.groupBy("d", "cell").agg(*((F.min if x[0] == "a" else F.max)(x).alias(x) for x in sides)).toPandas()
    return {int(d): (own["cell"].to_numpy(), own[sides[:DIMENSIONS]].to_numpy(), own[sides[DIMENSIONS:]].to_numpy()) for d, own in found.groupby("d")}


def _searched(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """asked: id, v, d, cell, bound. query_id, vec_id, score of the k nearest that each query finds in the cell. Cells
    that more than BLOCK queries visit go through several tasks."""
    visits = asked.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    split = F.broadcast(visits.filter("blocks > 1"))  # one row for each full BLOCK of queries at most
    asked = asked.join(split, ["d", "cell"], "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    points = points.join(split, ["d", "cell"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))

    def search(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(ask):
            tree = ProjectionTree([np.asarray(x, np.int64) for x in own["ids"]], np.vstack(own["v"].to_numpy()))
            for i, v, bound in zip(ask["id"].to_numpy(np.int64), ask["v"], ask["bound"], strict=True):
                ids, far, _ = tree.search(i, np.asarray(v, float), k, bound)
                out.append(pd.DataFrame({"query_id": i, "vec_id": ids, "score": far}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ("d", "cell", "block")
    return points.select("ids", "v", *keys).groupBy(*keys).cogroup(asked.select("id", "v", "bound", *keys).groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the k nearest rows of vectors by Euclidean distance.
    Both have vec_id and embedding. ``cell``: points of a cell, about.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do null ids; vectors
    of another length than the query's aren't its candidates. A row with the query's own id isn't either, so rows
    that repeat an id never meet. Equal distances: the smaller id first. A query row that is repeated gives its rows
    once. Fewer than k candidates: all of them. Empty tables give no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    scratch = C.Scratch(spark, "ann")
    points = scratch.put(_distinct(_valid(vectors), k), "distinct")
    counts = {r.d: r.n for r in points.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = {d: math.ceil(n / cell) for d, n in counts.items() if n > cell}
    cells = {}
    if large:
        share = min(1.0, SAMPLE / sum(counts[d] for d in large))
        sample = points.filter(F.col("d").isin(*large) & (F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(1e6 * share))).select("d", "v").toPandas()
        for d, own in sample.groupby("d"):
            cells[int(d)] = Cells.fit(np.vstack(own["v"].to_numpy()) @ axes(int(d)), large[d])
    points = scratch.put(_placed(points, cells), "points")
    asked = scratch.put(_placed(_valid(queries).dropDuplicates(["id"]).withColumn("bound", F.lit(math.inf)), cells), "asked")
    found = scratch.put(_searched(points, asked, k), "found")
    if cells:
        boxes, test = spark.sparkContext.broadcast(_boxes(points)), chi_square_quantile(SURE, DIMENSIONS)
        have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("far"))
        have = have.filter(F.col("n") >= k).select(F.col("query_id").alias("id"), "far")
        bounded = asked.drop("bound").join(have, "id", "left").withColumn("bound", F.coalesce("far", F.lit(math.inf))).drop("far")

        def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i, v, d, home, bound in zip(*(pdf[c] for c in ("id", "v", "d", "cell", "bound")), strict=True):
                    if d not in boxes.value:
                        continue
                    numbers, low, high = boxes.value[d]
                    q = np.asarray(v, float) @ axes(d)
                    gap = np.maximum(np.maximum(low - q, q - high), 0.0)
                    go = numbers[~beyond(np.einsum("ij,ij->i", gap, gap), test, bound) & (numbers != home)]
                    if len(go):
                        yield pd.DataFrame({"id": i, "v": [v] * len(go), "d": d, "cell": go, "bound": bound})

        more = bounded.select("id", "v", "d", "cell", "bound").mapInPandas(others, "id long, v array<double>, d int, cell int, bound double")
        found = found.unionByName(scratch.put(_searched(points, scratch.put(more, "visits"), k), "more"))
    scratch.keep("found", "more")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
