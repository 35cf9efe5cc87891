import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents, odd
from veilspark.llm import brown_lm as B


def base(rows, train):
    c = Counter()
    for t in train:
        c.update([*B.tokens(t), B.END])
    n, v = sum(c.values()), len(c)
    below = math.log10(n + 0.1 * (v + 1))
    return n, [(len(w), sum(c[x] > 0 for x in w), sum(math.log10(c[x] + 0.1) - below for x in w)) for w in ([*B.tokens(t), B.END] for t in rows)]


@pytest.mark.parametrize("held", [B.HELD, 40])
def test_base_score_and_counts(spark, monkeypatch, held):
    """Also with most words outside the held ones."""
    monkeypatch.setattr(B, "HELD", held)
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = {r.doc_id: r for r in B.op7_brown_lm(spark, sf).collect()}
    n, want = base([t for _, t in rows], [t for i, t in rows if zlib.crc32(str(i).encode()) % 10])
    for (i, _), (k, known, logs) in zip(rows, want, strict=True):
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (k, known, n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r.base_score - logs) < 1e-6 and r.score < 0


def test_the_model_predicts_better_than_single_words(spark):
    out = [r for r in B.op7_brown_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_class_model_sums_to_one(spark):
    """Over all words, known or not, what may follow a word: each class's words and its one slot for others."""
    from veilspark.llm import common as C

    docs = documents(spark, [(i, " ".join(f"w{(i * j) % 17}" for j in range(20))) for i in range(40)])
    m, vocabulary = B.train_classes(docs, C.Scratch(spark, "test"), classes=6)
    assert np.allclose((10**m.transitions).sum(1), 1)
    of = {w: m.of_unit[i] for i, w in enumerate(m.words[:-1])} | {B.END: m.of_unit[-1]}
    total = np.zeros(6)
    for w, c in zip(m.words, m.counts, strict=True):
        total[of[w]] += (c + B.ADDED) / 10 ** m.below[of[w]]
    assert np.allclose(total + B.ADDED / 10**m.below, 1)


def by_definition(rows, model, table):
    """Scores of (text, trained) rows by the model's formulas, from its classes alone."""
    of, count, classes = {r.word: r["class"] for r in table}, {r.word: r.c for r in table}, len(model.transitions)
    ends, buckets = sum(trained for _, trained in rows), model.of_unit[len(model.words) - 1 : -1]
    of[B.END], count[B.END] = classes - 1, ends
    class_of = lambda w: of[w] if w in of else buckets[B.bucket(w)]
    tokens, kinds = np.zeros(classes), np.zeros(classes)
    for w, c in of.items():
        tokens[c] += count[w]
        kinds[c] += 1
    grid = np.zeros((classes, classes))
    for text, trained in rows:
        if trained:
            path = [classes - 1, *map(class_of, B.tokens(text)), classes - 1]
            np.add.at(grid, (path[:-1], path[1:]), 1)
    own = (tokens + 1) / (tokens + 1).sum()
    step = (grid + B.TRANSITION_PRIOR * own) / (grid.sum(1, keepdims=True) + B.TRANSITION_PRIOR)
    out = []
    for text, _ in rows:
        before, logs = classes - 1, 0.0
        for w in (*B.tokens(text), B.END):
            c = class_of(w)
            logs += math.log10(step[before, c]) + math.log10((count.get(w, 0) + B.ADDED) / (tokens[c] + B.ADDED * (kinds[c] + 1)))
            before = c
        out.append(logs)
    return out


@pytest.mark.parametrize("held", [B.HELD, 60])
def test_score_by_its_definition(spark, monkeypatch, held):
    from pyspark.sql import functions as F

    from veilspark.llm import common as C

    monkeypatch.setattr(B, "HELD", held)
    monkeypatch.setattr(B, "CLUSTERED", 50)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    out = {r.doc_id: r.score for r in B.op7_brown_lm(spark, sf).collect()}
    rows = spark.createDataFrame([(r.doc_id, r.text) for r in docs], "doc_id long, text string").withColumns({"scored": F.lit(True), "trained": B.C.id_remainder(F.col("doc_id"), 10) != 0})
    model, table, _ = B._learn(rows, C.Scratch(spark, "test"))
    want = by_definition([(r.text, zlib.crc32(str(r.doc_id).encode()) % 10 != 0) for r in docs], model, table.collect())
    assert np.allclose([out[r.doc_id] for r in docs], want, rtol=1e-9, atol=1e-6)


def test_a_sweep_puts_every_word_where_it_is_likeliest(spark):
    """Against trying all classes with the whole likelihood, each word by itself."""
    from veilspark.llm import common as C

    rng, classes = np.random.default_rng(8), 5
    texts = [" ".join(f"w{rng.integers(0, 12)}" for _ in range(30)) for _ in range(40)]
    words = [f"w{i}".encode() for i in range(12)]
    of = {w: int(c) for w, c in zip(words, rng.integers(0, classes - 1, 12), strict=True)}
    docs = documents(spark, list(enumerate(texts))).selectExpr("doc_id", "text", "true AS scored", "true AS trained")
    # half of the words are held; the others count as the class of their bucket
    held = [*words[:6], B.END]
    of = {w: c if w in held else 2 for w, c in of.items()}
    encoded = B.encode(docs, held, np.ones(7))
    swept, before = B.sweep(encoded, held, np.array([*(of[w] for w in held[:-1]), classes - 1]), np.full(2 * B.ENDINGS, 2), classes, C.Scratch(spark, "test"), "met")
    got = {r.word: r["class"] for r in swept.collect()}

    def likelihood(of):
        grid = np.zeros((classes, classes))
        for t in texts:
            path = [classes - 1, *(of[w] for w in B.tokens(t)), classes - 1]
            np.add.at(grid, (path[:-1], path[1:]), 1)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(grid) - f(grid.sum(0)) - f(grid.sum(1))

    assert before == pytest.approx(likelihood(of) / sum(len(B.tokens(t)) + 1 for t in texts))
    near = 0
    for w in words:
        tried = [likelihood(of | {w: c}) for c in range(classes - 1)]
        near += tried[got[w]] >= max(tried) - 3.0  # but for pairs of the word with itself
    assert near == 12


def test_the_sweep_over_all_words_raises_the_likelihood(spark):
    from veilspark.llm import common as C

    model, _ = B.train_classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), C.Scratch(spark, "test"))
    before, after = model.likelihoods
    print("likelihood of a token by classes, before and after:", before, after)
    assert after > before + 0.05


def test_exchange_finds_alternating_classes():
    a = np.array([0, 0, 1, 1, 2, 2, 3, 3])
    b = np.array([2, 3, 2, 3, 0, 1, 0, 1])
    of = B.exchange(a, b, np.full(8, 50.0), 5, 3, 10)
    assert of[0] == of[1] != of[2] == of[3]


def test_every_training_word_has_the_class_of_its_neighbours(spark, monkeypatch):
    """Rare words of two kinds: each kind stands between words of its own, whatever the words' endings."""
    from veilspark.llm import common as C

    monkeypatch.setattr(B, "CLUSTERED", 4)
    rows = [(i, " ".join(f"a{i % 2} x{i}{j}q b{i % 2}" if i % 2 else f"a{i % 2} y{i}{j}q b{i % 2}" for j in range(5))) for i in range(200)]
    scratch = C.Scratch(spark, "test")
    m, others = B.train_classes(documents(spark, rows), scratch, classes=8)
    of = {r.word.decode(): r["class"] for r in others.collect()}
    assert len(of) == 1004 and sum(r.c for r in others.collect()) == 3000
    of = {w: c for w, c in of.items() if w[0] in "xy"}
    assert len({c for w, c in of.items() if w[0] == "x"}) == 1 == len({c for w, c in of.items() if w[0] == "y"}) and len(set(of.values())) == 2
    assert B.grown(B.CLASSES, 8 * B.DISTINCT) == 2 * B.CLASSES and B.grown(B.CLUSTERED, 8 * B.DISTINCT) == 2 * B.CLUSTERED


def test_words_and_buckets_of_whole_columns():
    """Columns of texts are cut, and words put into buckets, as each by itself."""
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "\x1cA\x0bB\u00a0b ", "\u00c9T\u00c9 !..", "a", "..x?!", "\u4e2d.", *("".join(rng.choice(list("aBz.,!?\u00e9 \n\t")) for _ in range(60)) for _ in range(300))]
    for part in (pa.array(texts), pa.array(texts).slice(5), pa.array([], pa.string())):
        words, n = B.cut(part)
        want = [B.tokens(t) for t in part.to_pylist()]
        assert n.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]
        assert B.buckets_of(words).tolist() == [B.bucket(w) for w in words.to_pylist()]
    at, k = rng.integers(0, 40, 500), rng.integers(1, 9, 500)
    for more in (1, 1 << 52):  # with keys and numbers in 64 bits, and beyond them
        keys, sums = B._sum(at * 1000, k * more)
        assert keys.tolist() == [1000 * x for x in np.flatnonzero(np.bincount(at))] and (sums == np.bincount(at, k)[keys // 1000].astype(int) * more).all()


def test_numbers_of_a_text_are_one_cell(spark):
    """Steps hand on a text's words as one binary, not as arrays that Spark moves number by number; no words are lost."""
    rows = documents(spark, [(0, "b a c a C d"), (1, None), (2, "a c")]).selectExpr("doc_id", "text", "true AS scored", "true AS trained")
    got = B.encode(rows, [b"a", B.END], np.array([3.0, 3.0]))
    assert not [f.name for f in got.schema if f.dataType.typeName() == "array"]
    texts = []
    for r in sorted(got.collect(), key=lambda r: r.doc_id):
        rare = bytes(r.rare).split(b" ") if r.rare is not None else []
        path, times, bucket = (np.frombuffer(x, np.int32).tolist() for x in (r.path, r.times, r.bucket))
        assert bucket == [B.bucket(w) for w in rare] and times == [sum(p == -1 - i for p in path) for i in range(len(rare))]
        texts.append(b" ".join([b"a", b"|"][p] if p >= 0 else rare[-1 - p] for p in path))
        assert (r.n_tokens, r.n_held) == (len(path), sum(p >= 0 for p in path)) and abs(r.logs - r.n_held * math.log10(3 + B.ADDED)) < 1e-9
    assert texts == [b"b a c a c d |", b"|", b"a c |"]


@pytest.mark.parametrize("key,value", [("maxRecordsPerBatch", "7"), ("useLargeVarTypes", "true")])
def test_what_tasks_sum_at_once_changes_nothing(spark, monkeypatch, key, value):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(B, "HELD", 300)
    want = {r.doc_id: tuple(r) for r in B.op7_brown_lm(spark, sf).collect()}
    monkeypatch.setattr(B, "AT_ONCE", 40)
    monkeypatch.setattr(B, "PAIRS_AT_ONCE", 100)
    spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    try:
        got = {r.doc_id: tuple(r) for r in B.op7_brown_lm(spark, sf).collect()}
    finally:
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    assert got.keys() == want.keys() and all(got[i][:5] == want[i][:5] and np.allclose(got[i][5:], want[i][5:], rtol=1e-9) for i in want)


def test_odd_rows(spark):
    docs = odd(spark)
    out = B.score(docs, docs).collect()
    assert len(out) == 10 and all(r.n_known == r.n_tokens for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3, 4)} == {1}
    none = B.score(docs, docs.limit(0)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and abs(r.base_score) < 1e-9 for r in none)
    assert B.score(documents(spark, []), docs).count() == 0
