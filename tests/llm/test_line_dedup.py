import duckdb
from pyspark.sql import functions as F

from tests.llm.helpers import BIG, by_id, documents, odd
from veilspark.llm import common as C
from veilspark.llm.line_dedup import OP2_SQL, LineRuns, drop_common_lines, op2_line_dedup

LONG = "A line that is surely longer than forty characters"


def test_common_line_stays_in_the_largest_document(spark):
    rows = [(i, f"own {i}\n  {LONG.upper() if i % 2 else LONG}\t\nend") for i in range(5)] + [(9, f"{LONG}\n{LONG}")]
    got = by_id(drop_common_lines(documents(spark, rows)), "n_lines", "n_dropped", "kept_text")
    assert got[9] == (2, 0, f"{LONG}\n{LONG}")
    assert all(got[i] == (3, 1, f"own {i}\nend") for i in range(5))


def test_fewer_documents_or_short_lines_stay(spark):
    rows = [(i, LONG) for i in range(4)] + [(i, "short line") for i in range(10, 20)]
    assert drop_common_lines(documents(spark, rows)).filter("n_dropped > 0").count() == 0


def test_a_document_counts_once(spark):
    rows = [(1, "\n".join([LONG] * 50)), (2, LONG), (2, LONG), (3, LONG)]
    assert drop_common_lines(documents(spark, rows)).filter("n_dropped > 0").count() == 0


def test_text_that_loses_all(spark):
    got = by_id(drop_common_lines(documents(spark, [(i, LONG) for i in range(6)])), "n_dropped", "kept_text")
    assert got[5] == (0, LONG) and all(got[i] == (1, "") for i in range(5))


def test_null_ids_hold_no_line(spark):
    rows = [(None, LONG)] * 3 + [(BIG + i, LONG) for i in range(4)]
    out = drop_common_lines(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.n_dropped) for r in out) == [(False, 0)] + [(False, 1)] * 3 + [(True, 1)] * 3
    assert [r.doc_id for r in out if not r.n_dropped] == [BIG + 3]


def test_odd_rows_and_empty_table(spark):
    out = drop_common_lines(odd(spark)).collect()
    assert len(out) == 10 and all(r.n_dropped == 0 for r in out)
    assert {r.n_lines for r in out if r.text is None or r.text == ""} == {1}
    assert drop_common_lines(documents(spark, [])).count() == 0


def keys(spark, i):
    return spark.createDataFrame([(bytes([k]), 1, 9 - i, 2) for k in range(i, i + 3)], "h binary, n_docs long, max_doc long, n_lines long")


def test_runs_compact_and_tell_new_hashes(spark):
    runs = LineRuns(C.Scratch(spark, "test-runs"), fan_in=3)
    for i in range(4):
        runs.add(keys(spark, i))
    assert {k: len(v) for k, v in runs.levels.items() if v} == {1: 1, 0: 1}
    assert [r.h[0] for r in runs.new(keys(spark, 4)).collect()] == [6]
    rows = [(r.h[0], r.holder) for x in runs.names() for r in spark.table(x).collect()]
    assert sorted(x for x, holder in rows if holder is not None) == [0, 1, 2, 3, 4, 5]  # each once
    got = {r.h[0]: (r.n_docs, r.holder, r.n_lines) for r in runs.totals().collect()}
    assert got == {0: (1, 9, 2), 1: (2, 9, 4), 2: (3, 9, 6), 3: (3, 8, 6), 4: (2, 7, 4), 5: (1, 6, 2)}
    plan = runs.totals()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_a_plain_write_in_place_of_the_anti_join_is_wrong(spark, monkeypatch):
    rows = [(i, f"{LONG}\nand some other line of document {i}") for i in range(40)]
    good = by_id(drop_common_lines(documents(spark, rows)), "n_dropped")
    assert good[39] == (0,) and all(good[i] == (1,) for i in range(39))
    monkeypatch.setattr(LineRuns, "new", lambda self, keys: keys.filter("false") if self.names() == [] else keys)
    assert by_id(drop_common_lines(documents(spark, rows)), "n_dropped") != good


def test_clashing_names(spark):
    docs = documents(spark, [(i, LONG) for i in range(6)])
    for c in ("gone", "gone_key", "gone_id", "gone_t", "key", "row", "h", "t", "part", "a.b"):
        docs = docs.withColumn(c, F.lit("kept"))
    out = drop_common_lines(docs).collect()
    assert all(r[c] == "kept" for r in out for c in ("gone", "gone_key", "gone_id", "gone_t", "key", "row", "h", "t", "part", "a.b"))
    assert sum(r.n_dropped for r in out) == 5


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    names = "doc_id, n_lines, n_dropped, kept_sha256"
    want = {tuple(r) for r in db.execute(f"SELECT {names} FROM ({OP2_SQL})").fetchall()}
    assert {tuple(r) for r in op2_line_dedup(spark, sf).select(*names.split(", ")).collect()} == want
