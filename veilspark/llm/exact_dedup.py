"""Exact dedup: a persistent digest index, bucketed and sorted by hash. New data is deduplicated by a sort-merge
anti-join against it and appended. DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import common as C


def normal_text(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{C.SPACE_CLASS}+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normal_text(text), 256))


class DigestIndex:
    """(digest, keep_id) for each distinct text seen, as a Parquet table bucketed and sorted by digest at ``path``.
    The files last from session to session; the catalogue entry through which they are read is this session's, until
    close(). The number of buckets is the one the index was made with, as its name beside the files says; ``buckets``
    counts only for a new one."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets, self.name = spark, path, C.stored_number(spark, path, "buckets", buckets), f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, batch: DataFrame, scratch: C.Scratch) -> None:
        """batch: doc_id, digest. Appends the digests that the index lacks, each with the smallest doc_id of the
        batch (null only if it has no other); one already there keeps its id."""
        first = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        # written, else Spark moves the anti-join below the aggregate, to all rows of a digest
        name = f"batch-{uuid.uuid4().hex}"
        first = scratch.put(first, name)
        fresh = first.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        scratch.drop(name)

    def close(self) -> None:
        """Drops the catalogue entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, batches: int = 2, buckets: int | None = None, index: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The rows arrive at the index in ``batches`` of ascending doc_id, so the first to bring a text has the smallest id.
    ``index``: a folder of an index that lasts; texts it knows keep the id it has, so none of docs' rows with another
    id stays, and new ones are appended. Without it docs are compared with each other alone. ``buckets`` of a new
    index are the session's number of shuffle partitions if not given.

    Null or empty text: the empty text, equal to each other. Null doc_id: after every id; keep_id is null only if the
    whole group's ids are, and then all its rows are kept. Repeated rows with the id that stays are all kept: the id
    is the document. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "exact-dedup")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, n = scratch.put_counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "rows")
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    known = DigestIndex(spark, index or scratch.path("index"), buckets)
    last = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("inf")))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        known.ingest(rows.filter((last > low if low is not None else F.lit(True)) & (last <= high if high is not None else F.lit(True))), scratch)
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = scratch.put(sizes.hint("merge").join(known.rows(), "digest"), "groups")
    known.close()
    scratch.keep("rows", "groups")
    out = C.join_hot(rows, groups, "digest", F.col("group_size") >= C.HOT_SHARE * n, "inner")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(C.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
