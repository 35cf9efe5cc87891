import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd
from veilspark.llm import toxicity as X

BAD = ["idiot", "stupid", "loser", "scum", "worthless"]


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(5)
    clean = [f"{a}{b}" for a in "ba le mo ri tu no sa de".split() for b in "ra ti lo nu ke mi".split()]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(30)]
        if i % 5 == 0:
            words[rng.randrange(30)] = rng.choice(BAD)
            words[rng.randrange(30)] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0), None))
    docs = documents(spark, rows)
    labels = spark.createDataFrame(labels, "doc_id long, y int, source string")
    return docs, labels, X.learn(docs, labels)


def best_of_all(model, token):
    """By trying every reading: the likeliest logarithm, without the lexicon."""
    logs, best = model.trigrams, -np.inf
    options, last = [], ""
    for c in token:
        said, skip = model.channel.choices(c, last)
        options.append([*said, *([("", skip)] if skip is not None else [])])
        last = c
    for path in itertools.product(*options):
        s, a, b = 0.0, 0, 0
        for x, cost in path:
            s -= cost
            if x:
                s, a, b = s + logs[a * 4096 + b * 64 + X.char_code(x)], b, X.char_code(x)
        best = max(best, s + logs[a * 4096 + b * 64])
    return best


def test_the_search_is_exact(trained):
    learned, rng = trained[2], random.Random(11)
    model = X.Model(learned.trigrams, {}, {}, learned.channel)
    for _ in range(150):
        token = "".join(rng.choice("abeilnort0134$!*.") for _ in range(rng.randint(1, 6)))
        word = X.decode(model, token, [])
        states, last = {(0, 0): (0.0, None, None)}, ""
        for c in token:
            states, last = X._step_plain(model.trigrams, states, *model.channel.choices(c, last)), c
        got, path = max(((s + model.trigrams[a * 4096 + b * 64], p) for (a, b), (s, p, _) in states.items()), key=lambda x: x[0])
        assert abs(got - best_of_all(model, token)) < 1e-9 and X._spell(path) == word


@pytest.mark.parametrize("hidden", ["d*sg*st*ng", "*d**t", "1d10t", "$tup1d"])
def test_no_lexicon_reading_is_lost(hidden):
    model = X.Model(np.random.default_rng(1).normal(-4, 2, X._CODES**3), {w: 4.0 for w in ("disgusting", "idiot", "stupid")}, {})
    assert any(w in model.lexicon for _, w in X.readings(model, hidden))


@pytest.mark.parametrize("span", ["1 2 3 4 5 6 7 8 9 0 ", "a b ", "5 . 3 "])
def test_long_spans_take_linear_time(trained, span):
    restorer, took = X.Restorer(trained[2]), []
    for n in (2_000, 16_000):
        start = time.perf_counter()
        restorer.hits(span * (n // len(span)))
        took.append(time.perf_counter() - start)
    assert took[1] < 24 * max(took[0], 0.02)


def test_long_tokens_are_decoded(trained):
    assert "idiot" in X.Restorer(trained[2]).hits("1d1" + "0" * 100_000 + "t" * 9)


def test_alignment():
    channel = X.Channel()
    assert X.align(channel, "1d10t", "idiot") == [("1", "i"), ("d", "d"), ("1", "i"), ("0", "o"), ("t", "t")]
    assert X.align(channel, "s.cc*m", "scum") == [("s", "s"), ("", "left out"), ("c", "c"), ("", "repeated"), ("", "filled"), ("m", "m")]
    assert X.align(channel, "xyz", "idiot") == []


def test_the_channel_is_learned(spark, trained):
    """Signs that hide letters often become cheap, the others stay as they began."""
    docs, labels, plain = trained
    assert plain.channel.cost("1", "i") == pytest.approx(X.AS_LETTER)
    rows = [(r.doc_id, " ".join(w.replace("i", "!", 1) if w in BAD and r.doc_id % 2 else w for w in r.text.split())) for r in docs.collect()]
    model = X.learn(documents(spark, rows), labels)
    assert model.channel.cost("!", "i") < X.AS_LETTER < model.channel.cost("1", "i")
    assert model.channel.cost("", "filled") > X.FILLED > 0


def hide(word, rng):
    kind = rng.randrange(4)
    if kind == 0:
        leet = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7"}
        return "".join(leet.get(c, c) for c in word)
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return "".join(c * rng.randint(2, 4) for c in word)
    return ".".join(word)


def hidden_in(spark, sf):
    """The table's held-out labelled documents, with the words that tell toxic ones hidden in each."""
    words = ("trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron")
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    rng = random.Random(7)
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter(X.C.id_remainder(F.col("doc_id"), 3) == 1).orderBy("doc_id").collect()
    made = [(r.doc_id + 10**9, re.sub(rf"\b({'|'.join(words)})\b", lambda m: hide(m[0].lower(), rng), r.text or "", flags=re.I), r.toxic) for r in rows]
    return docs.select("doc_id", "text"), X.training_labels(labels), spark.createDataFrame(made, "doc_id long, text string, toxic int")


def test_hidden_words_are_found_through_the_lattice_alone(spark):
    docs, labels, made = hidden_in(spark, "/root/testdata/sf0.1")
    caught = {}
    for lattice in (True, False):
        scored = X.score_toxicity(docs.unionByName(made.select("doc_id", "text")), labels, lattice=lattice).join(made.select("doc_id", "toxic"), "doc_id").collect()
        caught[lattice] = [sum(r.predicted for r in scored if r.toxic == y) for y in (1, 0)] + [sum(r.toxic for r in scored)]
    print("caught, wrong, toxic with and without the lattice:", caught)
    n = caught[True][2]
    assert caught[True][0] > 0.8 * n and caught[False][0] < 0.5 * n and caught[True][1] < 15


def test_scores(spark, trained):
    docs, labels, _ = trained
    held = labels.filter("doc_id % 3 <> 1")
    for r in X.score_toxicity(docs, held).collect():
        assert r.predicted == int(r.doc_id % 5 == 0) and 0 <= r.score <= 1


@pytest.mark.parametrize("hidden", ["1d10t", "i d i o t", "stuuuupid", "$tup1d", "l0s3r!!", "s.c.u.m", "w0rthle55", "m e, you S T U P I D one", "IDIOT", "s-c-u-m", "id​iot"])
def test_hidden_words(trained, hidden):
    found = X.Restorer(trained[2]).hits(f"bara leti {hidden} moke")
    assert any(w in found for w in (*BAD, "worthles")), found


@pytest.mark.parametrize(("hidden", "word"), [("10$3r", "loser"), ("5(um", "scum"), ("$tuup1d", "stupid"), ("1d107", "idiot"), ("1053r", "loser"), ("5tuup1d", "stupid"), ("stuupid", "stupid"), ("iddiot", "idiot"), ("idiioott", "idiot"), ("s" * 40 + "c" * 40 + "um", "scum")])
def test_words_of_few_letters_doubled_letters_or_great_length(trained, hidden, word):
    found = X.Restorer(trained[2]).hits(f"bara leti {hidden} moke")
    assert word in found, found


def test_words_of_signs_only():
    model = X.Model(np.full(X._CODES**3, -3.0), {"ass": 4.0}, {})
    for hidden in ("@$$", "a$$", "@55", "(@$$)", "455!"):
        assert X.Restorer(model).hits(f"so {hidden} it") == {"ass": 4.0}, hidden
    assert X.Restorer(model).hits("192.168.0.1 2024-01-02 $$$ 10,000 55") == {}


@pytest.mark.parametrize(("hidden", "words"), [("s t u p ! d", ["stupid"]), ("$ t u p i d", ["stupid"]), ("you are a s t u p i d one", ["stupid"]), ("a l o s e r", ["loser"]), ("i d i o t s t u p i d", ["idiot", "stupid"]), ("1.d.1.0.t $.c.u.m", ["idiot", "scum"]), ("i d i o t", ["idiot"])])
def test_spaced_words_with_signs_and_neighbours(trained, hidden, words):
    assert set(X.Restorer(trained[2]).hits(f"bara leti {hidden} moke")) == set(words)


@pytest.mark.parametrize("clean", ["bara leti moke 192.168.0.1 2024-01-02", "a b c bara", "mail me@example.com, 3rd 10th b2b", "moke!!! *** $$$ leti%%% ###", ""])
def test_clean_texts(trained, clean):
    assert X.Restorer(trained[2]).hits(clean) == {}


def test_restored_text(trained):
    assert X.Restorer(trained[2]).restore("You 1d10t, i d i o t!") == "you idiot, idiot!"


def test_scores_are_those_of_the_restored_texts(spark, trained):
    """By the definition: plain words of the restored text, looked up in the lexicon, and the logistic function."""
    docs, labels, model = trained
    hidden = ["you 1d10t and st*pid ba lera", "l.o.s.e.r bara tuti", "so w0rthless tura scuuum", "idiot scum loser", "bara leti mora", ""]
    more = documents(spark, [(10_000 + i, t) for i, t in enumerate(hidden)])
    columns = ["doc_id", "text"]
    rows = X.score_toxicity(docs.select(columns).unionByName(more.select(columns)), labels, restored=True).collect()
    model = X.learn(docs.select(columns).unionByName(more.select(columns)), labels)
    assert len(rows) == 906
    for r in rows:
        found = {}
        for w in r.restored.split():
            if weight := X.word_weight(model, X.core(w)):
                found[X.core(w)] = weight
        top = sorted(found.values(), reverse=True) + [0.0, 0.0]
        z = float(np.dot(model.weights, [top[0], top[1], np.log1p(len(found)), 1.0]))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9), r.restored
        assert r.predicted == int(r.score >= X.THRESHOLD)
    said = {r.doc_id: r.restored for r in rows}
    assert all(w in said[10_000] for w in ("idiot", "stupid")) and "loser" in said[10_001] and "worthless" in said[10_002]


def test_every_entry_that_passes_is_in_the_lexicon(spark):
    """Against a count by Python, with more entries than a fixed number of the strongest would hold."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(7)) for _ in range(23_000)]
    common = words[:1000]
    rows = [(i, " ".join(rng.sample(words, len(words)))) for i in range(8)]
    rows += [(100 + i, " ".join(rng.choice(common) for _ in range(200))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, y int")
    model = X.learn(documents(spark, rows), labels, lattice=False)
    n0, n1 = 60, 8
    clean = Counter(w for i, t in rows if i >= 100 for w in set(t.split()))
    weight = {}
    for w in set(words):
        a, b = 8, clean[w]
        v = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        if v >= X.LEAST_WEIGHT and a > 2 * b:
            weight[w] = v
    assert len(weight) > 20_000 and set(model.lexicon) == set(weight)
    assert all(model.lexicon[w] == pytest.approx(v) for w, v in weight.items())


def test_odd_rows_and_missing_labels(spark, trained):
    out = X.score_toxicity(odd(spark), trained[1]).collect()
    assert len(out) == 10 and all(0 <= r.score < 0.7 and r.predicted == 0 for r in out)
    assert X.score_toxicity(documents(spark, []), trained[1]).count() == 0
    none = X.score_toxicity(odd(spark), spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, y int"))
    assert {r.predicted for r in none.collect()} == {0}


def test_only_near_copies_share_a_key(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    by_key: dict = {}
    for r in rows:
        by_key.setdefault(X._alike(r.text or ""), []).append({*zip(w := (r.text or "").lower().split(), w[1:], w[2:])})
    assert len(by_key) > 0.8 * len({r.text for r in rows})
    for first, *others in by_key.values():
        assert all(len(first & x) >= 0.3 * len(first | x) for x in others)
    assert X._alike("a b c d") == X._alike("A b  c d") != X._alike("a b d c")


def test_logistic_model_parts_two_classes():
    x = np.array([[0.0, 0, 0, 1]] * 50 + [[5.0, 3, 1, 1]] * 20)
    w = X.fit_logistic(x, np.array([0] * 50 + [1] * 20))
    assert (w[:3] >= 0).all() and x[0] @ w < 0 < x[-1] @ w


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = X.op3_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    caught = [r.predicted for r in got if r.toxic]
    assert right > 0.97 and sum(caught) / len(caught) > 0.85
