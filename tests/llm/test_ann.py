import numpy as np

from veilspark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(ids, vectors, q, k=10):
    far = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
    far[ids == ids[q]] = np.inf
    order = [i for i in np.lexsort((ids, far))[:k] if np.isfinite(far[i])]
    return [(int(ids[i]), far[i]) for i in order]


def test_whole_table_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, vectors = rows.vec_id.to_numpy(), np.vstack(rows.embedding).astype(float)
    got: dict = {}
    for r in ann.op9_ann(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 100 == 0}
    hits = total = 0
    for q, found in got.items():
        want = brute(ids, vectors, int(np.flatnonzero(ids == q)[0]))
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and [s for _, _, s in found] == sorted(s for _, _, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want})
        total += len(want)
    assert hits / total >= 0.93


def test_many_shards_and_ties(spark):
    rng = np.random.default_rng(2)
    vectors = np.vstack([np.tile([1.0, 2, 3, 4], (200, 1)), rng.normal(size=(300, 4))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v], "") for i, v in enumerate(vectors)], SCHEMA)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id in (0, 250)"), cell=60).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert [got[0][i] for i in range(1, 11)] == [(i, 0.0) for i in range(1, 11)]
    want = brute(np.arange(500), vectors.astype(float), 250)
    assert [got[250][i][0] for i in range(1, 11)] == [v for v, _ in want]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (2**60 + 1, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df, df).collect())
    root = round(2**0.5, 6)
    assert [g for g in got if g[0] == 0] == [(0, 1, 2**60 + 1, 1.0), (0, 2, 1, root)]
    assert {g[0] for g in got} == {0, 1, 2**60 + 1}
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def share_verified(vectors, queries, k=10):
    """Of all vectors, what a query's search through one tree verifies, and its recall."""
    tree, ids = ann.ProjectionTree([np.array([i]) for i in range(len(vectors))], vectors), np.arange(len(vectors))
    verified, hits = [], []
    for q in queries:
        found, far, n = tree.search(q, vectors[q], k)
        assert (np.diff(far) >= 0).all()
        verified.append(n / len(vectors))
        hits.append(len({*found.tolist()} & {v for v, _ in brute(ids, vectors, q, k)}) / k)
    return np.mean(verified), np.mean(hits)


def test_the_stopping_test_spares_more_than_half(spark):
    """On the table; and the share falls where there are more vectors."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    share, recall = share_verified(np.vstack(rows.embedding).astype(float), range(0, 2000, 50))
    rng = np.random.default_rng(3)
    made = rng.normal(size=(200, 64))[rng.integers(0, 200, 20_000)] + 0.3 * rng.normal(size=(20_000, 64))
    large_share, large_recall = share_verified(made, range(0, 20_000, 500))
    print("verified, recall on the table and on 20,000 vectors in clusters:", share, recall, large_share, large_recall)
    assert share < 0.5 and recall > 0.92 and large_share < 0.05 and large_recall > 0.92


def test_without_the_stopping_test_all_are_verified(monkeypatch):
    monkeypatch.setattr(ann, "beyond", lambda near, test, far: near < 0)
    vectors = np.random.default_rng(4).normal(size=(500, 16))
    assert share_verified(vectors, range(5)) == (1.0, 1.0)


def test_cells_and_blocks(spark, monkeypatch):
    """Several cells, of which a query leaves some out, and more queries than a task takes."""
    monkeypatch.setattr(ann, "BLOCK", 7)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 24)) * 5
    vectors = centres[rng.integers(0, 20, 1000)] + rng.normal(size=(1000, 24))
    df = spark.createDataFrame([(i, [float(x) for x in v], "") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, score string")
    got: dict = {}
    for r in ann.nearest(df, df.filter("vec_id % 10 = 0"), cell=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = [len({v for _, v, _ in got[q]} & {v for v, _ in brute(np.arange(1000), vectors, q)}) for q in range(0, 1000, 10)]
    assert len(got) == 100 and all(len(x) == 10 for x in got.values()) and sum(hits) / 1000 > 0.92
    points = vectors @ ann.axes(24)
    cells = ann.Cells.fit(points, 10)
    sizes = np.bincount(cells.of(points))
    assert cells.count == 10 and sizes.min() > 60 and sizes.max() < 140
    assert ann.Cells.fit(np.ones((50, 32)), 4).count == 1 and ann.Cells.fit(np.zeros((0, 32)), 4).count == 1


def test_a_vector_of_many_rows(spark):
    rows = [(i, [1.0, 2.0], "") for i in range(3000)] + [(3000 + i, [1.0, 2.0 + i], "") for i in range(1, 5)] + [(0, [1.0, 2.0], "")] * 30
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, df.filter("vec_id IN (0, 2999)")).collect())
    assert got == [(0, i, i) for i in range(1, 11)] + [(2999, i, 0) for i in range(1, 11)]


def test_quantile():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 0.01
