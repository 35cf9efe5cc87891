"""Line dedup: levelled sorted runs of line hashes, compacted periodically; each new batch merge-anti-joins the runs
and adds its own."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import common as C


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs: doc_id, text (not null). doc_id, t (md5 of the text), pos and h (md5 of the key) of the lines whose key
    has at least min_chars code points. A key is the line without white space at both ends, A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows, ts, places, keys = [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    t = md5(text.encode()).digest()
                    for pos, line in enumerate(text.split("\n")):
                        if len(line) >= min_chars and len(line := line.strip(C.SPACE_CHARS)) >= min_chars:
                            rows.append(row)
                            ts.append(t)
                            places.append(pos)
                            keys.append(md5(line.encode().lower()).digest())
                ids = part.column("doc_id").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(ts, pa.binary()), pa.array(places, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "t", "pos", "h"])

    return docs.mapInArrow(run, "doc_id long, t binary, pos int, h binary")


def md5(data: bytes):
    return hashlib.md5(data, usedforsecurity=False)


class LineRuns:
    """Runs of (h, holder, n_docs, n_lines), tables bucketed and sorted by h. Batches come in order of falling doc_id.
    A hash that the anti-join with all runs finds to be new enters with the largest document of its batch as holder,
    so over all runs one row of a hash has a holder, and it is the largest document of all; known hashes enter with
    their counts alone. A batch adds a run of level 0; as soon as ``fan_in`` runs share a level they are merged into
    one of the next, which brings counts to their holder, so few runs are open at a time and a hash is rewritten once
    a level. Only a batch's own keys are shuffled: runs meet each other and new keys bucket by bucket."""

    def __init__(self, scratch: C.Scratch, fan_in: int = 2) -> None:
        self.scratch, self.spark, self.fan_in, self.made = scratch, scratch.spark, fan_in, 0
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"line_run_{uuid.uuid4().hex}"
        self.levels: dict[int, list[str]] = {}

    def names(self) -> list[str]:
        return [x for level in self.levels.values() for x in level]

    def _store(self, df: DataFrame) -> str:
        """A bucketed table, whose rows come with a bucket a task."""
        name, self.made = f"{self.prefix}_{self.made}", self.made + 1
        df.write.format("parquet").option("compression", "zstd").option("path", self.scratch.path(name)).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        return name

    def _delete(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(*names)

    def new(self, keys: DataFrame) -> DataFrame:
        """Those of the keys that no run holds."""
        for name in self.names():
            keys = keys.join(self.spark.table(name).select("h").hint("merge"), "h", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """keys: h, n_docs, max_doc, n_lines; one row a hash."""
        own = self._store(keys.repartition(self.buckets, "h"))
        keys = self.spark.table(own)
        holders = self.new(keys.select("h", "max_doc")).select("h", F.col("max_doc").alias("holder"))
        self._put(keys.join(holders.hint("merge"), "h", "left").select("h", "holder", "n_docs", "n_lines"), 0)
        self._delete(own)

    def _put(self, run: DataFrame, level: int) -> None:
        names = self.levels.setdefault(level, [])
        names.append(self._store(run))
        if len(names) >= self.fan_in:
            merged = self._merged(names)
            self.levels[level] = []
            self._put(merged, level + 1)
            self._delete(*names)

    def _merged(self, names: list[str]) -> DataFrame:
        """One row a hash, its counts added and its holder kept."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select("h", *(F.col(c).alias(f"{c}_2") for c in ("holder", "n_docs", "n_lines")))
            count = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}_2", F.lit(0))).alias(c)
            out = out.join(other.hint("merge"), "h", "full_outer").select("h", F.coalesce("holder", "holder_2").alias("holder"), count("n_docs"), count("n_lines"))
        return out

    def totals(self) -> DataFrame:
        """One row a hash over all runs."""
        return self._merged(self.names())

    def close(self) -> None:
        self._delete(*self.names())


def drop_common_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text added (columns of docs that have these names are replaced; other
    columns may have any name).

    A text is split at \\n. Lines whose key (keyed_lines) has at least min_chars code points and is in at least min_docs
    documents stay in the largest doc_id that holds it and are dropped elsewhere.

    Null or empty text: one empty line, kept. Null doc_id: all such rows count as one document below every id, so
    they never hold the line that stays. Rows that repeat an id are one document. Repeated rows: each loses the same
    lines. A text that loses every line becomes empty. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "line-dedup")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    cuts = sorted(set(source.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    part = F.lit(0)
    for cut in cuts:  # null ids are in part 0, too
        part = part + F.coalesce((F.col("doc_id") > F.lit(int(cut))).cast("int"), F.lit(0))
    lines, n = scratch.put_counted(keyed_lines(source, min_chars).withColumn("part", part), "lines", ("part",))
    runs = LineRuns(scratch)
    for i in reversed(range(len(cuts) + 1)):
        by_doc = lines.filter(F.col("part") == i).groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        runs.add(by_doc.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"), F.sum("n").alias("n_lines")))
    common = scratch.put(runs.totals().filter(F.col("n_docs") >= min_docs).select("h", "holder", "n_lines"), "common")
    runs.close()
    scratch.keep("lines", "common")
    found = C.join_hot(lines.select("doc_id", "t", "pos", "h"), common, "h", F.col("n_lines") >= C.HOT_SHARE * n, "inner")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("holder"))).groupBy("doc_id", "t").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "t").alias("key"), "gone")
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.unhex(F.md5(text)).alias("t"))
    rows = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    split = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    out = rows.join(gone.hint("merge"), "key", "left").select(
        "row",
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")).alias("kept_text"),
    )
    return out.select("row.*", "n_lines", "n_dropped", "kept_text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.max_doc AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
