"""A Merkle manifest of a dataset: hash trees of eight children a node, one over each group's documents and one over the
groups' roots.

A tree is cut into aligned subtrees of at most 4,096 leaves (blocks). A block's digests are stored in van Emde Boas
order: a tree is split at half its height, the upper half comes first, then the lower subtrees, each stored the same way.
Where a node lies is arithmetic alone (``address``), so building a block and fetching siblings follow no pointers. The
blocks' roots are the leaves of the next trees, which are cut into blocks likewise, until one block is left."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm import common as C

ARITY = 8
#: Steps from a block's leaves to its root.
HEIGHT = 4
_DIGEST = 64  # hexadecimal characters


def nodes_of(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` at ``depth`` (0: the root) lie in the van Emde Boas order of a complete tree of so many
    levels."""
    index = np.asarray(index, np.int64)
    at = np.zeros_like(index)
    while levels > 1:
        lower = levels // 2
        upper = levels - lower
        if depth < upper:
            levels = upper
            continue
        depth -= upper
        width = ARITY**depth
        at += nodes_of(upper) + index // width * nodes_of(lower)
        index, levels = index % width, lower
    return at


@lru_cache(64)
def _addresses(levels: int, depth: int) -> list[int]:
    return address(levels, depth, np.arange(ARITY**depth)).tolist()


def height_of(n: int) -> int:
    """Steps from n leaves to one node."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _counts(leaves: int, height: int) -> list[int]:
    """Nodes there are at each depth, the root first."""
    out = [leaves]
    for _ in range(height):
        out.append(-(-out[-1] // ARITY))
    return out[::-1]


def build_block(leaves: list[str], height: int) -> bytes:
    """The digests of a block of these leaves (hexadecimal), in van Emde Boas order; nodes that aren't there are zeros."""
    nodes = ["0" * _DIGEST] * nodes_of(height + 1)
    for at, leaf in zip(_addresses(height + 1, height), leaves, strict=False):
        nodes[at] = leaf
    counts = _counts(len(leaves), height)
    for depth in range(height - 1, -1, -1):
        own, below = _addresses(height + 1, depth), _addresses(height + 1, depth + 1)
        for i in range(counts[depth]):
            nodes[own[i]] = _hash("".join([nodes[at] for at in below[ARITY * i : min(ARITY * (i + 1), counts[depth + 1])]]))
    return bytes.fromhex("".join(nodes))


class Block:
    """A stored block: its runs of siblings, fetched by address."""

    def __init__(self, nodes: bytes, leaves: int, height: int) -> None:
        self.height, text = height, nodes.hex()
        counts = _counts(leaves, height)
        self.runs: list[list[str]] = []  # by step from the leaves up, the digests of each run in a row
        for depth in range(height, 0, -1):
            ats = _addresses(height + 1, depth)[: counts[depth]]
            self.runs.append(["".join([text[_DIGEST * at : _DIGEST * (at + 1)] for at in ats[i : i + ARITY]]) for i in range(0, len(ats), ARITY)])
        self.leaves = [text[_DIGEST * at : _DIGEST * (at + 1)] for at in _addresses(height + 1, height)[:leaves]]

    def siblings(self, i: int) -> list[tuple[str, str]]:
        """What stands left and right of leaf i and of each node above it, up to the root."""
        out = []
        for runs in self.runs:
            run, own = runs[i // ARITY], _DIGEST * (i % ARITY)
            out.append((run[:own], run[own + _DIGEST :]))
            i //= ARITY
        return out


def fold(leaf: str, siblings: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in siblings:
        leaf = _hash(left + leaf + right)
    return leaf


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """sha256 of the values in a row: `-` for null, else bytes in UTF-8, a colon and the value."""
    return F.unhex(F.sha2(F.concat(*map(_field, values)).cast("binary"), 256))


def _placed(scratch: C.Scratch, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place (pos, from 0) in their tree by ``order``, and the tree's number of rows (n). Rows are ranged
    over the cluster by tree and order, so no tree goes through one task."""
    by = ["tree", *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row", F.monotonically_increasing_id())
    ranged = scratch.put(ranged, f"{name}-ranged").withColumn("part", F.shiftright("row", 33))
    starts = ranged.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("here"))
    tree = Window.partitionBy("tree")  # one row for each part of the range a tree has
    before = F.coalesce(F.sum("here").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("here").over(tree).alias("n"))
    return ranged.join(starts.hint("merge"), ["tree", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift")


_BLOCK = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("height", pa.int32()), ("leaves", pa.int32()), ("nodes", pa.binary()), ("root", pa.binary()), ("ids", pa.list_(pa.int64())), ("changed", pa.list_(pa.binary()))])
_BLOCK_SQL = "tree string, block long, n long, height int, leaves int, nodes binary, root binary, ids array<long>, changed array<binary>"


def _forest(scratch: C.Scratch, rows: DataFrame, name: str, height: int) -> list[DataFrame]:
    """rows: tree, pos, n, digest, id, changed. The blocks of all trees, from the leaves up, one table a level."""
    span = ARITY**height

    def build(own: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        n = own.column("n")[0].as_py()
        steps = height_of(n) if n <= span else height
        nodes = build_block([x.hex() for x in own.column("digest").to_pylist()], steps)
        # the root comes first in the order
        one = [own.column("tree")[0].as_py(), own.column("block")[0].as_py(), n, steps, own.num_rows, nodes, nodes[:32], own.column("id").to_pylist(), own.column("changed").to_pylist()]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(one, _BLOCK, strict=True)], schema=_BLOCK)

    levels = []
    while True:
        rows = rows.withColumn("block", F.expr(f"pos div {span}"))
        blocks = rows.groupBy("tree", "block").applyInArrow(build, _BLOCK_SQL)
        levels.append(scratch.put(blocks, f"{name}-{len(levels)}"))
        above = levels[-1].filter(F.col("n") > span)
        if above.isEmpty():
            return levels
        rows = above.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("root").alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("changed"))


_UPPER = "tree string, block long, left array<string>, right array<string>"


def _down(blocks: DataFrame, upper: DataFrame, span: int) -> DataFrame:
    """Siblings of each leaf of upper blocks, up to the root of all: a leaf is a block of the level below."""

    def down(own: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        block = Block(row["nodes"], row["leaves"], row["height"])
        paths = [block.siblings(i) for i in range(row["leaves"])]
        return pa.table({
            "tree": pa.array([row["tree"]] * len(paths), pa.string()),
            "block": pa.array([row["block"] * span + i for i in range(len(paths))], pa.int64()),
            "left": pa.array([[x for x, _ in p] + row["left"] for p in paths], pa.list_(pa.string())),
            "right": pa.array([[x for _, x in p] + row["right"] for p in paths], pa.list_(pa.string())),
        })

    return blocks.join(upper, ["tree", "block"]).groupBy("tree", "block").applyInArrow(down, _UPPER)


@dataclass
class Manifest:
    """What is stored of a dataset: the blocks of the groups' trees and of the tree over them, by level, the groups'
    roots (tree, pos, subroot), and the root, None of an empty dataset."""

    scratch: C.Scratch
    groups: list[DataFrame]
    over: list[DataFrame]
    subroots: DataFrame
    root: str | None
    height: int

    def _paths(self) -> DataFrame:
        """Siblings above each block of documents: tree, block, left, right."""
        spark, span = self.scratch.spark, ARITY**self.height
        upper = spark.createDataFrame([("", 0, [], [])], _UPPER)
        for blocks in reversed(self.over):
            upper = _down(blocks, upper, span)
        upper = upper.select(F.col("block").alias("pos"), "left", "right").join(self.subroots, "pos").select("tree", F.lit(0).cast("long").alias("block"), "left", "right")
        upper = self.scratch.put(upper, "paths-over")
        # trees end at different levels: a level's blocks are reached from the one above, or are their tree's only one
        found = None
        for level in range(len(self.groups) - 1, -1, -1):
            blocks = self.groups[level]
            here = upper.join(blocks.filter(F.col("n") <= span).select("tree", "block"), ["tree", "block"], "left_semi")
            if found is not None:
                here = here.unionByName(found)
            if level == 0:
                return here
            found = self.scratch.put(_down(blocks, here, span), f"paths-{level}")
        raise AssertionError("a forest has a level")

    def proofs(self, whole: bool = False) -> DataFrame:
        """For each document: tree, doc_id, leaf, subroot, proof_sha256 (of all its siblings' digests), folded_root (from
        its changed leaf where it has one); with ``whole`` also left and right, the siblings by level."""
        kinds = {"tree": "string", "doc_id": "long", "leaf": "string", "proof_sha256": "string", "folded_root": "string"} | ({"left": "array<string>", "right": "array<string>"} if whole else {})

        def prove(own: pa.Table) -> pa.Table:
            row = own.to_pylist()[0]
            block = Block(row["nodes"], row["leaves"], row["height"])
            above = list(zip(row["left"], row["right"], strict=True))
            rest = "".join(x + y for x, y in above)
            out: dict[str, list] = {k: [] for k in kinds}
            for i, (doc_id, changed) in enumerate(zip(row["ids"], row["changed"], strict=True)):
                path = block.siblings(i)
                out["tree"].append(row["tree"])
                out["doc_id"].append(doc_id)
                out["leaf"].append(block.leaves[i])
                out["proof_sha256"].append(_hash("".join([x + y for x, y in path]) + rest))
                out["folded_root"].append(fold(block.leaves[i] if changed is None else changed.hex(), path + above))
                if whole:
                    out["left"].append([x for x, _ in path] + row["left"])
                    out["right"].append([x for _, x in path] + row["right"])
            types = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
            return pa.table({k: pa.array(v, types[kinds[k]]) for k, v in out.items()})

        blocks = self.groups[0].join(self._paths().hint("merge"), ["tree", "block"])
        found = blocks.groupBy("tree", "block").applyInArrow(prove, ", ".join(f"{k} {v}" for k, v in kinds.items()))
        found = self.scratch.put(found, "proofs")
        subroots = self.subroots.select("tree", F.lower(F.hex("subroot")).alias("subroot"), "n")
        return C.join_hot(found, subroots, "tree", F.col("n") >= C.HOT_SHARE * found.count(), "inner").drop("n")


def manifest(docs: DataFrame, group: str = "lang", changed: Column | None = None, height: int = HEIGHT) -> Manifest:
    """Builds the trees of docs. ``changed`` marks rows that a checker later finds with A-Z lower-cased in their text;
    ``height``: steps from a block's leaves to its root.

    A leaf is the digest of doc_id, source, lang, n_chars and text. A group's leaves ascend by doc_id; a null id comes
    first, and rows of one id by their digests, so repeated rows are leaves next to each other. Groups ascend by name,
    a null one first. Null and empty texts differ. Texts of any length are digested in Spark's own functions. An empty
    table has no root and gives no rows; other columns, whatever their names, are left out.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "merkle")
    c = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars")]
    other = leaf_digest(*c, C.lower_ascii(F.col("text"))) if changed is not None else None
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("tree"),
        F.col("doc_id").cast("long").alias("id"),
        leaf_digest(*c, F.col("text")).alias("digest"),
        (F.when(changed, other) if changed is not None else F.lit(None).cast("binary")).alias("changed"),
    )
    rows = scratch.put(rows, "leaves")
    groups = _forest(scratch, _placed(scratch, rows, ["id", "digest"], "leaves"), "groups", height)
    # a tree is done at the level where it is one block
    roots = C.union_all([blocks.filter(F.col("n") <= ARITY**height).select("tree", F.col("root").alias("subroot")) for blocks in groups])
    sizes = groups[0].groupBy("tree").agg(F.max("n").alias("n"))
    roots = scratch.put(roots.join(sizes, "tree").select(F.col("tree").alias("name"), F.lit("").alias("tree"), "subroot", F.col("n").alias("of_tree")), "roots")
    ordered = scratch.put(_placed(scratch, roots, ["name"], "roots"), "roots-placed")
    over = _forest(scratch, ordered.select("tree", "pos", "n", F.col("subroot").alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("changed")), "over", height)
    top = over[-1].select("root").head(1)
    scratch.drop("leaves", "leaves-ranged", "roots", "roots-ranged")
    subroots = ordered.select(F.col("name").alias("tree"), "pos", "subroot", F.col("of_tree").alias("n"))
    return Manifest(scratch, groups, over, subroots, bytes(top[0][0]).hex() if top else None, height)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    made = manifest(docs, changed=C.id_remainder(F.col("doc_id"), 3) == 0)
    root = F.lit(made.root).cast("string")
    return made.proofs().select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _sql(levels: int = 8) -> str:
    """One step up a tree a subquery; trees of up to 8 ** levels leaves."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    # crc32 of the decimal id: a byte is mixed in, then eight bits are shifted out, the polynomial mixed in for each set one
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce({bits}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295), 4294967295)"
    # a row of `seen` is a document: where its node stands in its tree, what it folds to so far, and the siblings so far
    steps = [f"""
docs AS (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf("lowered")} ELSE {leaf("text")} END AS changed
  FROM (SELECT *, translate(text, '{C.UPPER}', '{C.LOWER}') AS lowered FROM documents)),
placed AS (SELECT *, coalesce('1' || lang, '0') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
a0 AS (SELECT tree, pos, leaf AS h FROM placed),
seen0 AS (SELECT doc_id, leaf, tree, pos, changed AS folded, '' AS siblings FROM placed)"""]  # fmt: skip

    def climb(nodes: str, seen: str) -> None:
        for i in range(levels):
            steps.append(f"""
{nodes}r{i} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}{i}),
{nodes}{i + 1} AS (SELECT tree, CASE WHEN n = 1 THEN pos ELSE pos // 8 END AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM (SELECT tree, pos AS p, h, n, pos FROM {nodes}r{i}) GROUP BY tree, n, CASE WHEN n = 1 THEN pos ELSE pos // 8 END),
{nodes}s{i} AS (SELECT x.tree, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r, any_value(x.n) AS n
  FROM {nodes}r{i} x JOIN {nodes}r{i} y ON x.tree = y.tree AND x.pos // 8 = y.pos // 8 GROUP BY x.tree, x.pos),
{seen}{i + 1} AS (SELECT d.* REPLACE (CASE WHEN n = 1 THEN d.pos ELSE d.pos // 8 END AS pos, CASE WHEN n = 1 THEN folded ELSE sha256(l || folded || r) END AS folded, CASE WHEN n = 1 THEN siblings ELSE siblings || l || r END AS siblings)
  FROM {seen}{i} d JOIN {nodes}s{i} USING (tree, pos))""")

    climb("a", "seen")
    steps.append(f"""
b0 AS (SELECT 'all' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, tree AS name FROM a{levels}),
top0 AS (SELECT doc_id, leaf, 'all' AS tree, b0.pos, folded, siblings, b0.h AS subroot FROM seen{levels} d JOIN b0 ON d.tree = b0.name)""")
    climb("b", "top")
    return "WITH " + ",".join(steps).lstrip() + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM top{levels}, b{levels}"""  # fmt: skip


OP13_SQL = _sql()
