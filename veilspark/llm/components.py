"""Connected components of an edge table, by contraction: every node hooks on its smallest neighbour, chains of hooks
are shortened by pointer jumping, and what remains between the trees is the next round's edge table. All of it is
joins and aggregates on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veilspark.llm import common as C


def components(scratch: C.Scratch, edges: DataFrame, name: str) -> DataFrame:
    """edges: a, b (long, not null). One row for each node that has an edge to another: node, component (the smallest
    node it reaches)."""
    made = 0

    def put(df: DataFrame) -> tuple[DataFrame, int]:
        nonlocal made
        made += 1
        return scratch.put_counted(df, f"{name}-{made}")

    edges, n = put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = None
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up, _ = put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")))
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = up.join(above.hint("merge"), "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            seen = Observation()
            made += 1
            up = scratch.put(jumped.observe(seen, F.count_if("moved").alias("n")).drop("moved"), f"{name}-{made}")
            if not seen.get["n"]:
                break
        if known is None:
            known = up.withColumnRenamed("up", "component")
        else:  # the nodes of a later round are components of the earlier ones
            later = up.withColumnRenamed("node", "component").hint("merge")
            known, _ = put(known.join(later, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        left = edges.join(a.hint("merge"), "a").select("b", "ua").join(b.hint("merge"), "b").filter("ua <> ub")
        edges, n = put(left.select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b")).distinct())
    return known if known is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
