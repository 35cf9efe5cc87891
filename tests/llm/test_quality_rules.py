import re
from collections import Counter

import duckdb
import pytest

from tests.llm.helpers import documents, odd
from veilspark.llm.quality_rules import OP11_SQL, apply_rules, host_verdicts, op11_quality_rules

SPACE = "[\x20\x09-\x0d]"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def by_hand(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.sub(SPACE, "", line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, r, n < 50 or 100 * r > 50 * n


TEXTS = [
    "a b c a b c", "a a a a", "a a a", "one two three four\none two three five", "x\nx\n x\n\n\n \n \nx", "", None, "#*$%&|<>! ## é|", "word\x85two w x y z",
    " ".join(f"w{i % 7}" for i in range(60)), " ".join(f"w{i}" for i in range(60)), "a b c d a b c e b c d " + " ".join(f"u{i}" for i in range(70)), "p q r s t p q r s t q r s", "日本 語 文 日本 語 文",
]


def test_counts_by_hand(spark):
    out = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in apply_rules(documents(spark, list(enumerate(TEXTS)))).collect()}
    assert out == {i: by_hand(t) for i, t in enumerate(TEXTS)}


def test_odd_rows(spark):
    rows = odd(spark).collect()
    out = apply_rules(odd(spark)).collect()
    assert len(out) == len(rows) == 10
    assert sorted(tuple(r[c] for c in COLUMNS) for r in out) == sorted(by_hand(r.text) for r in rows)
    assert [r.kept for r in out if r.doc_id == 5] == [True] and max(r.n_words for r in out) == 80_000
    assert apply_rules(documents(spark, [])).count() == 0


def test_a_failing_host_takes_its_documents_along(spark):
    good, junk = " ".join(f"word{i}" for i in range(80)), " ".join(f"$${i}" for i in range(80))
    rows = [(1000 * h + i, good + f" {h} {i}", f"host{h}") for h in range(8) for i in range(30)]
    rows += [(9000 + i, junk if i % 10 else good, "junk") for i in range(60)] + [(9900, good, None), (9901, junk, "small")]
    out = {r.doc_id: r for r in apply_rules(documents(spark, rows)).collect()}
    assert all(out[i].host_failed and not out[i].kept and not out[i].base_failed for i in range(9000, 9060))
    assert all(r.kept for i, r in out.items() if i < 9000) and out[9900].kept
    assert out[9901].kept  # one bad document says little about its host


def test_rates_shrink_towards_the_prior(spark):
    rows = [(h, i < f) for h, n, f in (("a", 100, 50), ("b", 100, 10), ("c", 100, 0), ("d", 2, 2)) for i in range(n)]
    got = {r.host: r for r in host_verdicts(spark.createDataFrame(rows, "host string, bad boolean"), ["bad"]).collect()}
    n, f = [100, 100, 100, 2], [50, 10, 0, 2]
    docs, mean = sum(n), sum(f) / sum(n)
    spread = sum(k * (x / k - mean) ** 2 for k, x in zip(n, f, strict=True))
    alike = (spread - mean * (1 - mean) * 3) / (mean * (1 - mean) * (docs - sum(k * k for k in n) / docs - 3))
    weight = 1 / alike - 1
    for h, k, x in zip("abcd", n, f, strict=True):
        assert got[h].rate_bad == pytest.approx((x + mean * weight) / (k + weight)) and not got[h].host_failed
    alone = host_verdicts(spark.createDataFrame([("a", True)] * 3, "host string, bad boolean"), ["bad"]).first()
    assert alone.rate_bad == 1.0


def test_no_python_on_the_way(spark, capsys):
    apply_rules(odd(spark)).explain("formatted")
    assert "Python" not in capsys.readouterr().out


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    out = op11_quality_rules(spark, sf)
    want = {tuple(r) for r in db.execute(f"SELECT {', '.join(out.columns)} FROM ({OP11_SQL})").fetchall()}
    assert {tuple(r) for r in out.collect()} == want
