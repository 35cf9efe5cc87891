"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics. Each class
has a mean and a covariance shrunk towards the pooled variances; a score comes from the difference of the two log
densities, by Mahalanobis distances through cached Cholesky factors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import common as C

#: Share of the pooled diagonal in a class's covariance, and the least variance of a statistic.
SHRINKAGE, LEAST_VARIANCE = 0.05, 1e-5
THRESHOLD = 0.3
#: Bins of the log-density difference between -60 and 60, on which the link to a probability is fitted.
BINS, REACH = 240, 60.0

_MARKS = b"|#%&*$!?.,;:-_=/\\<>{}[]()@\"'^~`+"
_GROUPS = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n",
    "other": bytes(range(128, 256)), "mark": _MARKS, "pipe": b"|", "odd": b"#%&*$^~@=", "bang": b"!?", "stop": b".", "comma": b",",
}
_TABLE = np.zeros((256, len(_GROUPS)))
for _i, _group in enumerate(_GROUPS.values()):
    _TABLE[list(_group), _i] = 1
_AT = {x: i for i, x in enumerate(_GROUPS)}

NAMES = ("log_bytes", "log_lines", "upper", "digit", "other", "mark", "pipe", "odd", "bang", "stop", "comma", "word_length", "word_spread", "distinct_words", "top_word", "distinct_lines", "byte_entropy", "short_lines")


def statistics(text: str) -> list[float]:
    """What NAMES says of the whole text, each bounded or on a log scale; of the empty text, zeros."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    by = counts @ _TABLE
    share = lambda name: math.sqrt(by[_AT[name]] / n)
    p = counts[counts > 0] / n
    words = text.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = text.split("\n")
    m = max(1, len(words))
    # distinct words fall with length; against the square root of the length they hardly do
    return [
        math.log1p(n), math.log1p(len(lines)), share("upper"), share("digit"), share("other"), share("mark"), share("pipe"), share("odd"), share("bang"), share("stop"), share("comma"),
        math.log1p(lengths.mean()), math.log1p(lengths.std()), math.log(len(kinds) + 1) / math.log(m + 2), math.sqrt(max(kinds.values(), default=0) / m),
        len(set(lines)) / len(lines), float(-(p * np.log(p)).sum()), math.sqrt(sum(len(x) < 40 for x in lines) / len(lines)),
    ]


@dataclass
class Discriminant:
    means: np.ndarray
    #: Inverse Cholesky factors of the covariances, and their log determinants.
    factors: np.ndarray
    log_dets: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        x = x / self.scale
        logs = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return logs[1] - logs[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.difference(x), -REACH, REACH) * self.slope + self.offset
        return 1 / (1 + np.exp(-z))


def fit_discriminant(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From the counts, sums and sums of outer products of two classes. A class without rows takes the other's."""
    d = sums.shape[1]
    if not n.sum():
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), np.ones(d), 0.0, 0.0)
    for c in (0, 1):
        if not n[c]:
            n, sums, squares = n.copy(), sums.copy(), squares.copy()
            n[c], sums[c], squares[c] = n[1 - c], sums[1 - c], squares[1 - c]
    means = sums / n[:, None]
    covs = squares / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.maximum(np.tensordot(n / n.sum(), covs, 1).diagonal(), LEAST_VARIANCE)
    scale = np.sqrt(pooled)
    factors, dets = [], []
    for c in (0, 1):
        a = max(shrinkage, min(1.0, d / n[c]))  # few rows say little of a covariance
        cov = (1 - a) * covs[c] / np.outer(scale, scale) + a * np.eye(d)
        low = np.linalg.cholesky((cov + cov.T) / 2)
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(means / scale, np.array(factors), np.array(dets), scale)


def fit_link(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and offset of a logistic link from a histogram of both classes over x, lightly pulled to 0."""
    w = np.array([0.0, 0.0])
    total = n0 + n1
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -500, 500)))
        g = np.array([(x * (total * p - n1)).sum() + 1e-3 * w[0], (total * p - n1).sum() + 1e-3 * w[1]])
        v = total * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    return max(0.0, float(w[0])), float(w[1])


def document_statistics(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return C.map_text(docs, "text", [T.StructField("x", T.ArrayType(T.DoubleType()))], lambda: lambda texts: {"x": [statistics(t) for t in texts]}, ["doc_id"])


def train(spark: SparkSession, stats: DataFrame, labels: DataFrame) -> Discriminant:
    """stats: doc_id, x. labels: doc_id, y (0 or 1). Class sums are added up where the rows are; the driver gets one
    number for each pair of statistics and class."""
    rows = stats.join(labels.hint("merge"), "doc_id").select("x", "y")
    d = len(NAMES)
    size = 1 + d + d * d

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, size))
        for pdf in batches:
            x, y = np.array(pdf["x"].tolist()).reshape(-1, d), pdf["y"].to_numpy()
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pd.DataFrame({"y": np.repeat([0, 1], size), "i": np.tile(np.arange(size), 2), "s": sums.ravel()})

    got = np.zeros((2, size))
    for r in rows.mapInPandas(moments, "y int, i int, s double").groupBy("y", "i").agg(F.sum("s").alias("s")).collect():
        got[r.y, r.i] = r.s
    model = fit_discriminant(got[:, 0], got[:, 1 : 1 + d], got[:, 1 + d :].reshape(2, d, d))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((2, BINS))
        for pdf in batches:
            x, y = np.array(pdf["x"].tolist()).reshape(-1, d), pdf["y"].to_numpy()
            at = np.clip((model.difference(x) + REACH) * BINS / (2 * REACH), 0, BINS - 1).astype(int)
            for c in (0, 1):
                out[c] += np.bincount(at[y == c], minlength=BINS)
        yield pd.DataFrame({"y": np.repeat([0, 1], BINS), "i": np.tile(np.arange(BINS), 2), "s": out.ravel()})

    hist = np.zeros((2, BINS))
    for r in rows.mapInPandas(spread, "y int, i int, s double").groupBy("y", "i").agg(F.sum("s").alias("s")).collect():
        hist[r.y, r.i] = r.s
    if hist.sum():
        model.slope, model.offset = fit_link((np.arange(BINS) + 0.5) * 2 * REACH / BINS - REACH, *hist)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of label 1), predicted. labels: doc_id, y; rows with null in either are left out,
    and an id that has several labels counts for each.

    Null or empty text: all statistics are 0, and it has a score like any text. Null doc_id: scored, never trained
    on. Repeated rows: the same score. No usable label: every score is 0.5. An empty table gives no rows; other
    columns are left out.
    """
    spark = docs.sparkSession
    stats = C.Scratch(spark, "quality").put(document_statistics(docs), "statistics")
    model = train(spark, stats, labels.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = C.id_remainder(F.col("doc_id"), 5) == 0
    labels = C.table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("y"))
    return score_quality(C.table(spark, sf_dir, "documents"), labels).select("doc_id", held_out.alias("held_out"), "score", "predicted")
