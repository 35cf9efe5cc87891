"""Every registered query against its SQL."""

import duckdb
import pytest

import veilspark.plans.file_queries  # noqa: F401
from veilspark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(map(str, (tuple(r) for r in got.select(*names).collect())))
    if name in ORACLES:
        want = db.execute("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({ORACLES[name]})").fetchall()
        assert rows == sorted(map(str, want))
    else:
        assert rows


def test_scrub_text_all_returns_every_row(spark, tmp_path):
    """Against Python's expressions, on rows with accents, on a null text, and on all of a small table."""
    import hashlib

    from veilspark.functions.text import scrub_text

    texts = ["Ünïcode é12 12é naïve.änne@exämple.org 3.14", "größe:12 ß99 45", "l'été 2024 d'août", None, "", "plain 77", "«42» — 17"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for sf, least in ((str(tmp_path), len(texts)), (SF, 200)):
        rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
        want = sorted((r.doc_id, None if r.text is None else hashlib.sha256(scrub_text(r.text).encode()).hexdigest()) for r in rows)
        assert sorted(tuple(r) for r in QUERIES["scrub_text_all"](spark, sf).collect()) == want and len(want) >= least


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
