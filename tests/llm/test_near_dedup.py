import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import BIG, documents, odd
from veilspark.llm import common as C
from veilspark.llm import near_dedup as N
from veilspark.llm.components import components


def brute(rows, k, percent):
    """doc_id: (size, smallest doc_id reached), by all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    post = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            post[x].append(i)
    for i, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for j in post[x]:
                both[j] += j < i
        for j, n in both.items():
            if n and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rng, base, n):
    words = list(base)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = f"new{rng.randrange(40)}"
        elif kind < 0.7 and len(words) > 3:
            del words[at]
        else:
            words.insert(at, f"add{rng.randrange(40)}")
    return " ".join(words)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_groups_of_edited_copies(spark, k, percent):
    """Copies with few to many edits: chains, near misses and outsiders, in large and small groups."""
    rng = random.Random(k)
    rows = []
    for size in (150, 30, 5, 2):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        rows += [edited(rng, base, rng.randrange(0, 9)) for _ in range(size)]
    rows += [" ".join(f"z{rng.randrange(9000)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(documents(spark, rows), k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = N.op5_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_odd_rows(spark):
    out = N.near_duplicates(odd(spark), 3, 85).collect()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out}
    assert len(out) == 10
    assert {(1, 2, 1, True), (BIG, 2, 1, False), (None, 2, None, True), (None, 0, None, True), (2, 0, 2, True), (4, 0, 4, True), (6, 2, 6, True)} <= got
    assert N.near_duplicates(documents(spark, []), 3, 85).count() == 0
    assert sorted(r.doc_id for r in N.drop_near_duplicates(odd(spark).filter("doc_id IS NOT NULL")).select("doc_id").distinct().collect()) == [1, 2, 3, 4, 5, 6]


def test_dropping_keeps_rows_and_columns(spark):
    docs = odd(spark)
    for c in ("key", "keys", "digest", "rep", "n", "component", "a.b"):
        docs = docs.withColumn(c, F.lit("kept"))
    out = N.drop_near_duplicates(docs).collect()
    assert [*docs.columns] == [*out[0].asDict()] and all(r["a.b"] == r["keys"] == "kept" for r in out)
    assert sorted((r.doc_id is None, r.doc_id) for r in out if r.doc_id is not None) == [(False, i) for i in (1, 1, 2, 3, 4, 5, 6)]
    assert sum(r.doc_id is None for r in out) == 2


def test_one_bucket_of_half_the_rows(spark):
    """A boilerplate text with small edits makes half the table, so its band keys are hot."""
    base = [f"word{i}" for i in range(120)]
    rows = [(i, " ".join(base[:100] + [f"own{i}"])) for i in range(600)] + [(1000 + i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(600)]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(documents(spark, rows), 3, 85).collect()}
    assert got == {i: 0 for i in range(600)} | {1000 + i: 1000 + i for i in range(600)}


def test_few_words_are_one_shingle():
    a, b, c = N.shingle_sets(["One  two", "one\ttwo", "one"], 3)
    assert len(a) == len(b) == len(c) == 1 and a[0] == b[0] != c[0]


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    for size in (1, 3, 40, 2000):
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(size * 0.9)], rng.integers(0, 2**63, size - int(size * 0.9)).astype(np.uint64)]))
        s = N.sketches([x, y], 512)
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((s[0] == s[1]).mean() - true) < 0.12


def test_bands_meet_the_miss():
    for percent in (80, 85, 95):
        n, rows = N.bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** n <= N.MISS and n <= N.MOST_BANDS


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5000)] + [(7, 3), (3, 7)]
    got = {r.node: r.component for r in components(C.Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(100)}
    assert components(C.Scratch(spark, "test"), spark.createDataFrame([], "a long, b long"), "c").count() == 0
