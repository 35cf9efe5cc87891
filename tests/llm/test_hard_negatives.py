import math

import duckdb
import numpy as np
import pytest

from veilspark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, p string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "x") for i, v, y in rows], SCHEMA)


def brute(rows, anchors):
    """rows, anchors: (id, vector, label) that take part."""
    q = lambda v: [math.floor(256 * x) for x in v]
    out = []
    for a, va, ya in anchors:
        scored = [(-sum(x * y for x, y in zip(q(va), q(v), strict=True)), i, y) for i, v, y in rows if i != a and len(v) == len(va)]
        for s, p, _ in sorted(x for x in scored if x[2] == ya)[:5]:
            band = sorted(x for x in scored if x[2] != ya and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(band, 1)]
    return sorted(out)


def test_blocks_ties_and_a_hot_label(spark, monkeypatch):
    """Many blocks, few distinct scores, and a label that holds most rows."""
    monkeypatch.setattr(H, "ANCHORS", 7)
    monkeypatch.setattr(H, "CANDIDATES", 40)
    monkeypatch.setattr(H, "TOGETHER", 3)
    monkeypatch.setattr(H, "AT_ONCE", 16)
    rng = np.random.default_rng(1)
    for d, scale in ((11, 0.02), (64, 1.0), (3, 40.0)):
        rows = [(i, (rng.integers(-3, 4, d) * scale / 3).tolist(), int(min(rng.integers(0, 9), 4)) if i % 2 else 0) for i in range(300)]
        anchors = [r for r in rows if r[0] % 10 == 0]
        got = H.mine(frame(spark, rows), frame(spark, anchors))
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, anchors)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.25], 3), (4, [-1.0, 0.0], 1), (5, [0.0, 0.0], 1), (6, [0.0, 0.0], 2), (2**60 + 1, [0.5, 0.0], 2), (7, [1.0], 1), (8, [1.0, 1.0, 1.0], 2)]
    rows = sound + [(10, None, 1), (11, [], 1), (12, [1.0, None], 1), (13, [nan, 1.0], 2), (14, [inf, 1.0], 2), (15, [1.0, 1.0], None), (None, [1.0, 1.0], 2)]
    got = H.mine(frame(spark, rows), frame(spark, rows + rows[:1]))
    assert sorted(tuple(r) for r in got.collect()) == brute(sound, sound)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    empty = frame(spark, rows).limit(0)
    assert H.mine(empty, frame(spark, rows)).count() == 0 and H.mine(frame(spark, rows), empty).count() == 0


def test_rows_that_repeat(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2)]
    got = sorted((r.anchor_id, r["rank"], r.negative_id) for r in H.mine(frame(spark, rows), frame(spark, rows[:1])).collect())
    assert got == [(0, 1, 2), (0, 2, 2)]


def test_too_large_for_sixty_four_bits(spark):
    with pytest.raises(ValueError, match="too large"):
        H.mine(frame(spark, [(0, [1e300], 1)]), frame(spark, [(0, [1e300], 1)]))
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(np.random.default_rng(2).integers(-(2**20), 2**20, (40, 5)))]
    assert sorted(tuple(r) for r in H.mine(frame(spark, rows), frame(spark, rows)).collect()) == brute(rows, rows)


def test_scores_are_inner_products():
    rng = np.random.default_rng(3)
    for d, low, high in ((64, -160, 160), (7, 0, 1), (9, -1, 0), (1, -5, 200), (16, 0, 0)):
        a, c = rng.integers(low, high + 1, (5, d)), rng.integers(low, high + 1, (33, d))
        got = H.scores(H.subset_sums(a), H.pack(c, H.planes_for(low, high)))
        assert (got == c @ a.T).all()
    assert [H.planes_for(*x) for x in ((0, 0), (-1, 0), (0, 1), (-2, 1), (-129, 127), (-128, 127))] == [1, 1, 2, 2, 9, 8]


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    out = H.op12_hard_negatives(spark, sf)
    want = {tuple(r) for r in db.execute(f"SELECT {', '.join(out.columns)} FROM ({H.OP12_SQL})").fetchall()}
    assert {tuple(r) for r in out.collect()} == want
