import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import BIG, documents, odd
from veilspark.llm import mixing as M


def waterfill(sizes):
    """Targets by the rule itself: share by weight, stop at three times the size, reshare the excess."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, targets, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weights[s] for s in names if s not in capped)
        targets = {s: 3 * sizes[s] if s in capped else left * weights[s] / w for s in names}
        over = {s for s in names if s not in capped and targets[s] > 3 * sizes[s]}
        if not over:
            return targets
        capped |= over


def check(out, near=0.02):
    by = {}
    for r in out:
        assert r.copies in (0, 1, 2, 3)
        e = by.setdefault(r.skey, [0, 0, r.source_size, r.target])
        e[0] += r.size
        e[1] += r.copies * r.size
    assert all(e[0] == e[2] for e in by.values())
    want = waterfill({k[1:] if k[0] == "a" else None: e[2] for k, e in by.items()})
    for k, e in by.items():
        assert e[3] == pytest.approx(want[k[1:] if k[0] == "a" else None]) and abs(e[1] - e[3]) <= max(near * e[3], 1)
    return by


def test_targets_and_reruns(spark):
    rows = [(i, "w " * (1 + i * 7919 % 300), ["a", "b", "c", "d", None][min(i % 7, 4)]) for i in range(2000)]
    first = M.allocate(documents(spark, rows)).collect()
    check(first)
    again = M.allocate(documents(spark, rows[::-1]).repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in first) == sorted((r.doc_id, r.copies) for r in again)


def test_capped_and_hot_sources(spark):
    """One source with most rows, all of a size; small ones that reach three times their size."""
    rows = [(i, "x y z", "big") for i in range(3000)] + [(5000 + i, "w " * 20, "a") for i in range(3)] + [(6000 + i, "v " * (i + 1), "zz") for i in range(40)]
    by = check(M.allocate(documents(spark, rows)).collect())
    assert by["aa"][1] == 3 * by["aa"][0]


def test_mix_repeats_rows(spark):
    docs = documents(spark, [(i, f"t{i} " * (1 + i % 50), "ab"[i % 2]) for i in range(400)])
    plan = {r.doc_id: r.copies for r in M.allocate(docs).collect()}
    out = M.mix(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}


def test_clashing_names_and_reruns(spark):
    docs = documents(spark, [(i, f"t{i} " * (1 + i % 50), "ab"[i % 2]) for i in range(60)] * 2)
    for c in ("mix_key", "mix_copies", "mix_copy", "key", "row", "place", "copies", "a.b", "size", "target"):
        docs = docs.withColumn(c, F.col("doc_id").cast("string"))
    docs = docs.withColumn("other", F.monotonically_increasing_id())
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    first, again = (sorted(map(str, M.mix(d).collect())) for d in (docs, docs.repartition(5, "other")))
    assert first == again
    for r in M.mix(docs).collect():
        assert all(r[c] == str(r.doc_id) for c in ("mix_key", "mix_copies", "mix_copy", "key", "row", "place", "a.b"))


def test_words_are_counted(spark):
    texts = ["", " ", "a", " a b\tc\n\nd ", "x\x0by\x0cz", "a\u2003b c", None, "é ü", "w " * 5000]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r.n for r in df.select(M.count_words(F.col("x")).alias("n")).collect()] == [len((x or "").encode().split()) for x in texts]


def test_odd_rows(spark):
    out = M.allocate(odd(spark)).collect()
    assert len(out) == 10 and {r.size for r in out if r.doc_id in (2, 3, 4)} == {0} and {r.doc_id for r in out} >= {None, BIG}
    assert M.allocate(documents(spark, [])).count() == 0
    assert all(r.target == 0 for r in M.allocate(documents(spark, [(1, None), (2, " ")])).collect())
    assert M.mix(odd(spark)).count() >= 1


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = M.op10_mixing(spark, sf).collect()
    sizes, taken = {}, {}
    for r in out:
        s = docs[r.doc_id].source
        assert r.size == len(docs[r.doc_id].text.encode().split()) and r.taken <= 3 * r.size
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
    want = waterfill(sizes)
    assert len(out) == len(docs) and all(r.target == pytest.approx(want[docs[r.doc_id].source]) and r.source_size == sizes[docs[r.doc_id].source] for r in out)
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in want)
