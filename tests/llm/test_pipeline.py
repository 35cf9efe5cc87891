import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.llm.helpers import BIG, odd
from tests.llm.test_near_dedup import brute
from veilspark.llm import bpe, mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_all_but_the_last_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    assert all(a.columns == b.columns for a, b in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = stages[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    clean = [d for d, t in labels.items() if not t]
    toxic = [d for d, t in labels.items() if t]
    assert sum(d in kept for d in clean) / len(clean) > 0.98 and sum(d in kept for d in toxic) / len(toxic) < 0.5


def test_lines(stages):
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in stages[1])
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in before.items():
        for line in t.split("\n"):
            if len(k := key(line)) >= 40:
                held.setdefault(k, set()).add(d)
    for d, t in before.items():
        want = [x for x in t.split("\n") if not (len(k := key(x)) >= 40 and len(held[k]) >= 5 and d != max(held[k]))]
        assert after[d] == "\n".join(want)


def test_near_copies(stages):
    before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in brute(rows, 5, 80).items() if c == i}


def test_mix(stages):
    before, after = stages[3]
    plan = {r.doc_id: r.copies for r in mixing.allocate(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == plan


def test_encoding(stages):
    before, after = stages[4]
    tok = bpe.ChunkCoder(bpe.tokenizer_path()).tok
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows[::7]:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)


NAMES = ("score", "predicted", "n_lines", "n_dropped", "kept_text", "gone", "key", "keys", "row", "copies", "mix_key", "size", "component_id", "n_tokens", "ids", "decoded", "a.b")


@pytest.mark.parametrize("i", range(5))
def test_odd_tables(spark, i):
    """Null, empty, very long and repeated texts, null ids, clashing names, and no rows at all."""
    name, stage = corpus_pipeline.STAGES[i]
    docs = odd(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for c in NAMES:
        docs = docs.withColumn(c, F.lit("own"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    out = stage(spark, docs, SF).collect()
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0
    if name == "bpe":
        assert len(out) == 10 and [r.n_tokens for r in out if not (r.decoded or "")] == [0] * 4
        return
    assert none.columns == docs.columns and list(out[0].asDict()) == docs.columns
    assert all(r[c] == "own" for r in out for c in NAMES)
    ids = sorted((r.doc_id for r in out if r.doc_id is not None))
    assert {2, 3, 4} <= set(ids) and any(r.doc_id is None for r in out)
    if name == "line_dedup":
        assert len(out) == 10 and all(r.n_chars == len(r.text) for r in out)
    if name == "toxicity":
        assert len(out) == 10
    if name == "near_dedup":
        assert ids.count(1) == 2 and BIG not in ids


def test_toxic_documents_go_whatever_their_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("predicted", F.lit(1)).withColumn("Score", F.lit("x"))
    out = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert out.columns == docs.columns and {(r.predicted, r.Score) for r in out.select("predicted", "Score").distinct().collect()} == {(1, "x")}


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
