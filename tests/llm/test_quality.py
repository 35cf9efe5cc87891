import zlib

import numpy as np

from tests.llm.helpers import documents, odd
from veilspark.llm import quality as Q


def test_statistics_are_finite():
    for text in ["", " ", "\n\n", "word", "É" * 100, "a b\nc d", "\ud800", "x" * 100_000]:
        x = Q.statistics(text)
        assert len(x) == len(Q.NAMES) and np.isfinite(x).all()


def test_discriminant_matches_densities():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (4000, 3)), rng.normal(1, 2, (4000, 3))
    n = np.array([4000.0, 4000.0])
    model = Q.fit_discriminant(n, np.array([a.sum(0), b.sum(0)]), np.array([a.T @ a, b.T @ b]), shrinkage=0.0)
    x = rng.normal(0, 2, (50, 3))

    def log_density(x, rows):
        c, m = np.cov(rows.T, bias=True), rows.mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) - 0.5 * np.linalg.slogdet(c)[1]

    assert np.abs(model.difference(x) - (log_density(x, b) - log_density(x, a))).max() < 0.2


def test_score_by_its_definition(spark):
    """Densities with shrunken covariances, and the link that fits the training rows best, all from numpy."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    x = {i: np.array(Q.statistics(t or "")) for i, t in docs.items()}
    rows = [np.array([x[i] for i, y in labels.items() if y == c]) for c in (0, 1)]
    covs = [np.cov(r.T, bias=True) for r in rows]
    n = np.array([len(r) for r in rows])
    scale = np.sqrt(np.maximum(((n[0] * covs[0] + n[1] * covs[1]) / n.sum()).diagonal(), Q.LEAST_VARIANCE))
    d = len(scale)
    logs = []
    for r, c, k in zip(rows, covs, n, strict=True):
        a = max(Q.SHRINKAGE, min(1.0, d / k))
        c = (1 - a) * c / np.outer(scale, scale) + a * np.eye(d)
        inverse, m = np.linalg.inv(c), r.mean(0) / scale
        logs.append({i: -0.5 * (v / scale - m) @ inverse @ (v / scale - m) - 0.5 * np.linalg.slogdet(c)[1] for i, v in x.items()})
    far = {i: float(np.clip(logs[1][i] - logs[0][i], -Q.REACH, Q.REACH)) for i in x}
    out = {r.doc_id: (r.score, r.predicted, r.held_out) for r in Q.op8_quality(spark, sf).collect()}
    inside = [i for i in x if 1e-9 < out[i][0] < 1 - 1e-9]
    z = np.array([np.log(out[i][0] / (1 - out[i][0])) for i in inside])
    slope, offset = np.polyfit([far[i] for i in inside], z, 1)
    assert slope > 0 and np.abs(slope * np.array([far[i] for i in inside]) + offset - z).max() < 1e-5
    assert all(out[i][1] == int(out[i][0] >= Q.THRESHOLD) and out[i][2] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in x)
    place = {i: (min(Q.BINS - 1, int((far[i] + Q.REACH) * Q.BINS / (2 * Q.REACH))) + 0.5) * 2 * Q.REACH / Q.BINS - Q.REACH for i in labels}
    wrong = [1 / (1 + np.exp(-(slope * place[i] + offset))) - y for i, y in labels.items()]
    assert abs(sum(wrong) + 1e-3 * offset) < 1e-3 and abs(sum(w * place[i] for w, i in zip(wrong, labels, strict=True)) + 1e-3 * slope) < 1e-2


def test_one_class_or_none(spark):
    docs = odd(spark)
    for labels in ([], [(1, 1)], [(1, None), (None, 1)]):
        out = Q.score_quality(docs, spark.createDataFrame(labels, "doc_id long, y int")).collect()
        assert len(out) == 10 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert {r.score for r in Q.score_quality(docs, spark.createDataFrame([], "doc_id long, y int")).collect()} == {0.5}
    assert Q.score_quality(documents(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, y int")).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = Q.op8_quality(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.97
