"""Mixing sources to target weights by entropy balancing: distributed Newton iterations solve the convex dual of the
token constraints; the exponentially tilted document rates are then rounded into copies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm import common as C

#: Weights of the sources in order of their names, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: Rows of one source and size that are ranked together.
RANKED_TOGETHER = 1000


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"{C.WORD_CLASS}+")).cast("long")


def _source_key(source: Column) -> Column:
    """Never null, in the order of the sources, null last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def _targets(scratch: C.Scratch, hist: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """One row a source: skey, source_size, mean, least (smallest size above 0), target."""
    sources = hist.groupBy("skey").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1).cast("int"))
    sources = scratch.put(sources.withColumn("weight", weight).withColumn("most", MOST_COPIES * F.col("source_size")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # every round caps more sources, or is the last
        over = F.col("weight") * level >= F.col("most")
        row = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("most")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (total - row[1]) / row[2]
    return scratch.put(sources.withColumn("target", F.least(F.col("weight") * level, F.col("most").cast("double"))), "targets")


def _solve(scratch: C.Scratch, hist: DataFrame, targets: DataFrame, steps: int, tolerance: float) -> DataFrame:
    """The dual variable of each source (tilt): words taken at rates min(3, exp(tilt * size / mean)) meet the target.
    All sources take a Newton step together, one aggregate over the histogram; a step that leaves the bracket is
    replaced by its middle. Sources whose target is all copies, or nothing, have an infinite tilt."""
    inf = math.inf
    state = targets.select(
        "skey", "target", "mean", "source_size",
        F.when(F.col("target") >= MOST_COPIES * F.col("source_size"), F.lit(inf)).when(F.col("target") <= 0, F.lit(-inf)).otherwise(F.lit(0.0)).alias("tilt"),
        F.lit(-1e7).alias("low"), (math.log(MOST_COPIES) * F.col("mean") / F.col("least")).alias("high"),
    )
    cap = math.log(MOST_COPIES)
    name = "tilt-0"
    state = scratch.put(state, name)
    for step in range(1, steps + 1):
        x = F.col("size") / F.col("mean")
        power = F.col("tilt") * x
        taken = F.col("n") * F.col("size") * F.exp(F.least(power, F.lit(cap)))
        sums = hist.join(state.filter(F.abs("tilt") < inf), "skey").groupBy("skey").agg(
            F.sum(taken).alias("taken"), F.sum(F.when(power < cap, taken * x).otherwise(0.0)).alias("slope"))
        off = F.col("taken") - F.col("target")
        low, high = F.when(off < 0, F.col("tilt")).otherwise(F.col("low")), F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - off / F.col("slope")
        new = F.when(F.col("taken").isNull() | (F.abs(off) <= tolerance * F.col("target")), F.col("tilt")).when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        moved = state.join(sums, "skey", "left").select("skey", "target", "mean", "source_size", new.alias("tilt"), F.coalesce(low, F.col("low")).alias("low"), F.coalesce(high, F.col("high")).alias("high"), F.coalesce(F.abs(off) / F.col("target"), F.lit(0.0)).alias("off"))
        old, name = name, f"tilt-{step}"
        moved = scratch.put(moved, name)
        scratch.drop(old)
        state = moved.drop("off")
        if (moved.agg(F.max("off")).first()[0] or 0) <= tolerance:
            break
    return state


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of all documents of each size of one source: from the largest size down, each takes what brings the
    words so far closest to the sum of the rates, so the last and smallest sizes make up for what is left."""
    pdf = pdf.sort_values("size", ascending=False)
    target, tilt = float(pdf["target"].iloc[0]), float(pdf["tilt"].iloc[0])
    size, n = pdf["size"].to_numpy(float), pdf["n"].to_numpy(float)
    if math.isinf(tilt):
        rate = np.full(len(size), MOST_COPIES if tilt > 0 else 0.0)
    else:
        rate = np.exp(np.minimum(tilt * size / pdf["mean"].to_numpy(float), math.log(MOST_COPIES)))
    want = np.cumsum(rate * n * size)
    want += (target - want[-1]) * np.arange(1, len(want) + 1) / len(want)
    out, had = [], 0.0
    for s, k, w in zip(size, n, want, strict=True):
        c = min(MOST_COPIES * k, max(0.0, round((w - had) / s))) if s else k
        had += c * s
        out.append(int(c))
    return pd.DataFrame({"skey": pdf["skey"].array, "size": pdf["size"].array, "n": pdf["n"].array, "all_copies": np.array(out, "int64")})


def allocate(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """For each row of docs: doc_id, t (md5 of the text), skey (the source), size, source_size, target, copies.

    Sources in order of their names, null last, have the weights over and over; their shares of all words are the
    targets, at most 3 times the source's words; what is above goes to the others by weight until none is above.
    A source's words taken come to within about half of its smallest document of the target.

    Null or empty text: size 0, and no word is taken whatever its copies. Null source: a source of its own. Null
    doc_id: a row like any other. Ties and repeated rows: which of the documents of a source and size have one copy
    more goes by a hash of id and text, so reruns agree; of rows alike in id, text and source any may be the one. A
    single source has its own size as target. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "mixing")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("t"), _source_key(F.col("source")).alias("skey"), count_words(text).alias("size"))
    rows = scratch.put(rows.withColumn("h", F.xxhash64("doc_id", "t")), "rows")
    hist = scratch.put(rows.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")), "hist")
    targets = _targets(scratch, hist, weights)
    tilts = _solve(scratch, hist, targets, steps, tolerance)
    plan = hist.join(tilts.select("skey", "target", "mean", "tilt"), "skey").groupBy("skey").applyInPandas(_round, "skey string, size long, n long, all_copies long")
    plan = plan.join(targets.select("skey", "source_size", "target"), "skey")
    key = F.concat_ws(":", "size", "skey")
    parts = F.ceil(F.col("n") / RANKED_TOGETHER)
    plan = scratch.put(plan.select(key.alias("k"), "source_size", "target", "n", F.expr("all_copies div n").alias("each"), F.expr("all_copies % n").alias("more"), parts.alias("parts")), "plan")
    scratch.keep("rows", "plan")
    n = rows.count()
    rows = C.join_hot(rows.withColumn("k", key), plan, "k", F.col("n") >= C.HOT_SHARE * n, "inner").withColumn("part", F.pmod("h", "parts"))
    before = rows.groupBy("k", "part").agg(F.count(F.lit(1)).alias("here"))
    window = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("k", F.col("part").alias("p"), F.coalesce(F.sum("here").over(window), F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k", "part").orderBy("h", "doc_id", "t")))
    ranked = ranked.withColumn("kp", F.concat_ws("#", "part", "k")).join(before.select(F.concat_ws("#", "p", "k").alias("kp"), "before").hint("merge"), "kp")
    return ranked.select("doc_id", "t", "skey", "size", "source_size", "target", (F.col("each") + F.when(F.col("rank") + F.col("before") <= F.col("more"), 1).otherwise(0)).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """docs with each row as often as its copies; columns may have any name. Rows alike in doc_id, text and source
    count together, and the one whose other columns have the least hash stands for them, so reruns agree.

    Null or empty text: no words, and as many copies as its rate says, which for size 0 is one. Null source: a source
    of its own. Null doc_id: a row like any other. An empty table gives no rows.
    """
    plan = allocate(docs, weights).groupBy("doc_id", "t", "skey").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    plan = plan.select(F.struct("doc_id", "t", "skey").alias("key"), F.col("copies").cast("int").alias("copies"))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("t"), _source_key(F.col("source")).alias("skey"))
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")]
    place = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    rows = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), place.alias("place"))
    rows = rows.groupBy("key").agg(F.min_by("row", "place").alias("row")).join(plan.hint("merge"), "key")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = allocate(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
