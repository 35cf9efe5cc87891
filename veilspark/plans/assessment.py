"""Whether a dictionary and its synthetic samples are safe and faithful: for each disclosed element, how many real
subjects are behind it, and how far synthetic times lie from the real ones."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.config import DEFAULTS, Thresholds
from veilspark.functions.timestamps import format_of, parse_mixed
from veilspark.operators import temporal
from veilspark.sources import files as S
from veilspark.sources.store import Store, join


def block_subjects(events: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """block (its label), real_subjects."""
    return temporal.diurnal_counts(events, thresholds).select(temporal.block_label(F.col("block"), thresholds.diurnal_block_hours).alias("block"), F.col("n_subjects").alias("real_subjects"))


def sole_contributors(members: DataFrame) -> DataFrame:
    """members: element, sid. sid, n_elements: subjects who alone fill elements."""
    alone = members.filter("sid IS NOT NULL").groupBy("element").agg(F.countDistinct("sid").alias("n"), F.min("sid").alias("sid")).filter("n = 1")
    return alone.groupBy("sid").agg(F.count(F.lit(1)).alias("n_elements"))


def diurnal_distance(real: DataFrame, made: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """diurnal_l1: the sum over blocks of the differences of two timelines' shares."""

    def shares(events: DataFrame, name: str) -> DataFrame:
        counts = temporal.diurnal_counts(events.withColumn("sid", F.coalesce(F.col("sid").cast("string"), F.lit("-"))), thresholds)
        total = counts.agg(F.sum("count").alias("t"))
        return counts.join(F.broadcast(total)).select("block", (F.col("count") / F.col("t")).alias(name))

    both = shares(real, "p").join(shares(made, "q"), "block", "full_outer")
    return both.agg(F.round(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))), 4).alias("diurnal_l1"))


def range_contained(real: DataFrame, made: DataFrame) -> DataFrame:
    """syn_in_real_range: whether made times lie between the real first day's start and the last one's end."""
    day = lambda c, f: f(F.col(c) / (temporal.DAY * temporal.MICROS))
    r, m = real.agg(F.min("us").alias("a"), F.max("us").alias("b")), made.agg(F.min("us").alias("c"), F.max("us").alias("d"))
    inside = (F.col("c") >= day("a", F.floor) * int(temporal.DAY * temporal.MICROS)) & (F.col("d") <= day("b", F.ceil) * int(temporal.DAY * temporal.MICROS))
    return r.join(F.broadcast(m)).select(inside.alias("syn_in_real_range"))


def assess(spark: SparkSession, data_dir: str, out_dir: str, report_path: str | None = None, thresholds: Thresholds = DEFAULTS) -> dict:
    """Recomputes what is behind each element of out_dir's dictionary from the files, and writes the report."""
    store = Store(spark)
    dictionary = json.loads(store.read(join(out_dir, "dictionary.json")))
    report: dict = {"k": thresholds.k, "diurnal_block_hours": thresholds.diurnal_block_hours, "files": {}, "reid_leaks": []}
    alone: DataFrame | None = None
    for found in S.discover(spark, data_dir):
        prof = dictionary["files"].get(found.relpath)
        subject = prof and prof.get("subject_key")
        if not subject or prof.get("role") == "codebook":
            continue
        raw = S.scan(spark, found.path)
        df, kinds = S.infer_types(raw)
        columns = {}
        for name, col in prof["columns"].items():
            shape = col.get("temporal_distribution")
            ts = S.timestamp_column(df, name, kinds[name]) if shape or "format" in col else None
            if ts is None:
                continue
            events = temporal.timeline(df, F.col(f"`{subject}`").cast("string"), ts).persist()
            try:
                own = columns[name] = {"real_contributors": temporal.contributors(events).first().n_contributors}
                leak = lambda element, n, c=name: report["reid_leaks"].append({"file": found.relpath, "column": c, "element": element, "real_subjects": n})
                for m in (col.get("format") or {}).get("minority", []):
                    n = raw.filter(format_of(F.col(f"`{name}`"))["template"] == m["template"]).agg(F.countDistinct(f"`{subject}`")).first()[0]
                    own.setdefault("minority_real_subjects", {})[m["template"]] = n
                    if n < thresholds.k:
                        leak(f"minority_format:{m['template']}", n)
                if not shape:
                    continue
                real = {r.block: r.real_subjects for r in block_subjects(events, thresholds).collect()}
                own["diurnal"] = [{"block": b, "disclosed_weight": w, "real_subjects": real.get(b, 0)} for b, w in shape["diurnal_blocks"].items()]
                for d in own["diurnal"]:
                    if d["disclosed_weight"] > 0 and d["real_subjects"] < thresholds.k:
                        leak(f"diurnal:{d['block']}", d["real_subjects"])
                bins = [(k, float(b["lo"]), float(b["hi"])) for k in ("session_minutes", "gap_hours", "coverage_days") for b in shape.get(k) or []]
                values = temporal.sessions(events)
                shown = [d["block"] for d in own["diurnal"] if d["disclosed_weight"] > 0]
                block = temporal.block_label(F.floor(F.pmod(F.floor(F.col("us") / (3600 * temporal.MICROS)), F.lit(24)) / thresholds.diurnal_block_hours).cast("int"), thresholds.diurnal_block_hours)
                members = events.select(block.alias("b"), "sid").filter(F.col("b").isin(*shown) if shown else F.lit(False)).select(F.concat(F.lit(f"{found.relpath}/{name}/"), "b").alias("element"), "sid")
                if bins:
                    table = spark.createDataFrame(bins, "metric string, lo double, hi double")
                    own["bins"] = [r.asDict() for r in temporal.tested_profile_bins(values, table).orderBy("metric", "lo").collect()]
                    for b in own["bins"]:
                        if b["real_subjects"] < thresholds.k:
                            leak(f"{b['metric']}[{b['lo']},{b['hi']})", b["real_subjects"])
                    v, t = values.alias("v"), F.broadcast(table).alias("t")
                    hit = v.join(t, (F.col("v.metric") == F.col("t.metric")) & (F.col("v.value") >= F.col("t.lo")) & (F.col("v.value") < F.col("t.hi")))
                    members = members.unionByName(hit.select(F.concat_ws("/", F.lit(found.relpath), F.lit(name), "t.metric", F.col("t.lo").cast("string")).alias("element"), F.col("v.sid").alias("sid")))
                # few rows: only of elements that one subject fills alone
                fresh = [(r.sid,) for r in sole_contributors(members).select("sid").collect()]
                if fresh:
                    fresh = spark.createDataFrame(fresh, "sid string")
                    alone = fresh if alone is None else alone.unionByName(fresh)
                sample = join(out_dir, "synthetic_samples", found.relpath)
                if store.exists(sample):
                    made = spark.read.csv(sample, header=True)
                    if name in made.columns:
                        c = F.col(f"`{name}`")
                        when = F.coalesce(F.when(c.rlike(r"^\d{12,}$"), F.timestamp_millis(c.try_cast("long"))), F.when(c.rlike(r"^\d+(\.\d+)?$"), F.timestamp_micros((c.try_cast("double") * 1e6).cast("long"))), parse_mixed(c))
                        made = made.select(F.lit("-").alias("sid"), F.unix_micros(when).alias("us")).filter("us IS NOT NULL")
                        if not made.isEmpty():
                            own["fidelity"] = diurnal_distance(events, made, thresholds).first().asDict() | range_contained(events, made).first().asDict()
            finally:
                events.unpersist()
        if columns:
            report["files"][found.relpath] = {"columns": columns}
    report["sole_contributor_subjects"] = alone.distinct().count() if alone is not None else 0
    report["reid_pass"] = not report["reid_leaks"] and not report["sole_contributor_subjects"]
    if report_path:
        store.write(report_path, json.dumps(report, indent=2, default=str))
    return report
