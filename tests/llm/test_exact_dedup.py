import duckdb
from pyspark.sql import functions as F

from tests.llm.helpers import BIG, documents, odd
from veilspark.llm import common as C
from veilspark.llm.exact_dedup import DigestIndex, OP6_SQL, digest, exact_dedup, op6_exact_dedup


def test_groups_and_odd_rows(spark):
    out = exact_dedup(odd(spark)).collect()
    assert len(out) == 10
    same = [r for r in out if r.group_size == 4]  # two rows of 1, the null id, and the large one with other white space
    assert {r.doc_id for r in same} == {1, None, BIG} and {r.keep_id for r in same} == {1}
    assert [r.kept for r in same if r.doc_id == 1] == [True, True] and not any(r.kept for r in same if r.doc_id != 1)
    empty = {r.doc_id: r for r in out if r.text_sha256.startswith("e3b0c442")}
    assert set(empty) == {None, 2, 3} and empty[None].keep_id == 2 and empty[2].kept and not empty[None].kept


def test_only_null_ids_are_kept(spark):
    out = exact_dedup(documents(spark, [(None, "q"), (None, "q")])).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in out] == [(None, 2, True)] * 2


def test_empty_table(spark):
    assert exact_dedup(documents(spark, [])).count() == 0


def test_hot_group(spark):
    out = exact_dedup(documents(spark, [(i, "same" if i % 3 else f"own {i}") for i in range(3000)]), batches=3)
    assert out.filter("kept").count() == 1001 and out.filter("group_size = 2000").count() == 2000


def test_index_lasts_and_keeps_the_first(spark):
    scratch = C.Scratch(spark, "test-index")
    rows = lambda x: documents(spark, x).select("doc_id", digest(F.col("text")).alias("digest"))
    first = DigestIndex(spark, scratch.path("index"), 4)
    first.ingest(rows([(5, "a"), (4, "b")]), scratch)
    first.close()
    again = DigestIndex(spark, scratch.path("index"), 4)
    again.ingest(rows([(1, "a"), (2, "c")]), scratch)
    assert sorted(r.keep_id for r in again.rows().collect()) == [2, 4, 5]
    again.close()


def test_an_index_keeps_its_number_of_buckets(spark):
    scratch = C.Scratch(spark, "test-buckets")
    rows = documents(spark, [(i, f"text {i}") for i in range(200)]).select("doc_id", digest(F.col("text")).alias("digest"))
    for buckets in (4, 8):
        index = DigestIndex(spark, scratch.path("index"), buckets)
        index.ingest(rows, scratch)
        assert index.buckets == 4 and index.rows().count() == 200
        index.close()


def test_a_later_run_opens_the_index_again(spark):
    path = C.Scratch(spark, "test-reopened").path("index")
    first = {r.doc_id: r.kept for r in exact_dedup(documents(spark, [(10, "a"), (11, "b"), (12, "a")]), index=path, buckets=3).collect()}
    assert first == {10: True, 11: True, 12: False}
    for _ in range(2):  # a repeated run changes nothing
        later = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(documents(spark, [(1, "a"), (2, "c"), (3, " c"), (4, "c")]), index=path, buckets=5).collect()}
        assert later == {1: (10, False), 2: (2, True), 3: (3, True), 4: (2, False)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = {tuple(r) for r in db.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({OP6_SQL})").fetchall()}
    assert {tuple(r) for r in op6_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()} == want
