import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd
from veilspark.llm import common as C
from veilspark.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return out


def by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text). (doc_id, leaf, subroot, root, proof, folded, verified), sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels_of([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in names}
    over = levels_of([trees[k][-1][0] for k in names])
    root, out = over[-1][0], []
    for g, k in enumerate(names):
        for i, (_, _, digest, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            way = path(trees[k], i) + path(over, g)
            tampered = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0
            folded = leaf(*r[:4], lower(r[4])) if tampered else digest
            for left, right in way:
                folded = H(*left, folded, *right)
            out.append((str(r[0]), digest, trees[k][-1][0], root, H(*(x for left, right in way for x in left + right)), folded, folded == root))
    return sorted(out)


def made(spark, docs, height=M.HEIGHT):
    m = M.manifest(docs, changed=C.id_remainder(F.col("doc_id"), 3) == 0, height=height)
    return sorted((str(r.doc_id), r.leaf, r.subroot, m.root, r.proof_sha256, r.folded_root, r.folded_root == m.root) for r in m.proofs().collect())


def test_addresses_are_a_layout():
    for levels in range(1, 6):
        every = np.concatenate([M.address(levels, d, np.arange(8**d)) for d in range(levels)])
        assert sorted(every) == list(range(M.nodes_of(levels))) and every[0] == 0
    # a tree of four levels: its upper two, then each lower tree of two levels in a piece
    assert M.address(4, 2, np.arange(3)).tolist() == [9, 18, 27] and M.address(4, 3, np.arange(10)).tolist() == [*range(10, 18), 19, 20]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 600, 4096])
def test_blocks(n):
    leaves = [H(str(i)) for i in range(n)]
    levels, height = levels_of(leaves), M.height_of(n)
    block = M.Block(M.build_block(leaves, height), n, height)
    for i in {0, n // 2, n - 1}:
        way = block.siblings(i)
        assert [("".join(a), "".join(b)) for a, b in path(levels, i)] == way and M.fold(leaves[i], way) == levels[-1][0]


def test_trees_of_several_blocks(spark):
    """Blocks of 8 leaves: up to four levels of blocks, with lone last leaves."""
    sizes = {"en": 521, "de": 64, "fr": 65, "é": 1, None: 9, "x": 8, **{f"l{i:02}": 1 for i in range(70)}}
    rows = [(10_000 * g + i, "s", k, i, f"Text {i}") for g, (k, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert made(spark, docs, 1) == by_hand(rows)


def test_blocks_of_two_levels(spark):
    rows = [(i, None, "en", None, f"Ab {i}") for i in range(130)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert made(spark, docs, 2) == by_hand(rows)


def test_odd_rows(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd(spark).collect()]
    assert made(spark, odd(spark)) == by_hand(rows)
    nulls = [(None, None, None, None, None), (1, None, None, 0, ""), (2, "s", "en", 5, "ÄÖ AB\x00"), (2, "s", "en", 5, "ÄÖ AB\x00")]
    assert made(spark, spark.createDataFrame(nulls, "doc_id long, source string, lang string, n_chars long, text string")) == by_hand(nulls)
    empty = M.manifest(documents(spark, []))
    assert empty.root is None and empty.proofs().count() == 0


def test_whole_proofs_fold_to_the_root(spark):
    m = M.manifest(documents(spark, [(i, f"t{i}") for i in range(100)]))
    for r in m.proofs(whole=True).collect():
        assert M.fold(r.leaf, list(zip(r.left, r.right, strict=True))) == m.root == r.folded_root


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    out = M.op13_merkle_manifest(spark, sf)
    want = {tuple(r) for r in db.execute(f"SELECT {', '.join(out.columns)} FROM ({M.OP13_SQL})").fetchall()}
    assert {tuple(r) for r in out.collect()} == want
