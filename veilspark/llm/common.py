"""What the operators share: the folder all executors see, written tables in it, and small column expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: The ASCII white space of the contracts, as a set of characters and as a class.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with at least this share of all rows is hot; at most 1 / HOT_SHARE keys can be, so a table of them may be broadcast.
HOT_SHARE = 1 / 1000

_own: str | None = None
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode only; on a cluster it must be set."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="veilspark-")
    return f"file://{_own}"


def importable(spark: SparkSession) -> None:
    """Lets Python workers that start in another folder find this package; where they do anyway, it changes nothing."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes a query's shuffle files as soon as the query has run, not when its plan is forgotten. For
    steps whose results are written: nothing reads their shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables of one run in the shared folder. A written table cuts lineage and outlives any executor."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        importable(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        return self.get(name, df)

    def put_counted(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
        """Also the number of rows, which is counted as they are written."""
        seen = Observation()
        out = self.put(df.observe(seen, F.count(F.lit(1)).alias("n")), name, partition_by)
        return out, seen.get["n"]

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        path, fs = self._files()
        for name in names:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, name), True)

    def keep(self, *names: str) -> None:
        """Deletes all tables but those that the result is read from."""
        path, fs = self._files()
        if fs.exists(path):
            self.drop(*(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName() not in names))


def stored_number(spark: SparkSession, path: str, what: str, number: int) -> int:
    """The number that was stored beside the table at path as an empty file's name, or else this one, stored now. Spark
    leaves out files whose names begin like this one."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(folder)
    for s in fs.listStatus(folder):
        if (name := s.getPath().getName()).startswith(f"_{what}_"):
            return int(name.rsplit("_", 1)[1])
    fs.create(jvm.org.apache.hadoop.fs.Path(folder, f"_{what}_{number}"), False).close()
    return number


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def join_hot(left: DataFrame, right: DataFrame, on: str, hot: Column, how: str = "left") -> DataFrame:
    """Joins left to right's row of its key, where ``hot`` marks right's rows whose key holds at least HOT_SHARE of
    the left rows. There are at most 1 / HOT_SHARE of these, so they are broadcast and their rows stay where they
    are; the others go through a sort-merge join in which no key has many rows. ``on`` is never null in ``left``;
    ``how`` is left or inner."""
    few = F.broadcast(right.filter(hot))
    apart = left.join(few.select(on), on, "left_anti").join(right.filter(~hot).hint("merge"), on, how)
    return left.join(few, on, "inner").unionByName(apart)


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns of these names renamed, so that an operator may add its own, and what gives docs' columns back."""
    own = {c: f"{uuid.uuid4().hex}" for c in docs.columns if c.lower() in names}
    columns = list(docs.columns)
    return docs.withColumnsRenamed(own), lambda df: df.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in columns))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def map_text(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable[[list[str]], dict[str, list]]], keep: list[str] | None = None, rows_at_once: int = 256) -> DataFrame:
    """df's columns (or ``keep`` of them), unchanged, with ``fields`` computed from a text column, null as empty text.
    ``make`` is called once a task; what it returns gets up to ``rows_at_once`` texts and gives a list for each field."""
    importable(df.sparkSession)
    keep = df.columns if keep is None else keep
    names = [*keep, *(f.name for f in fields)]
    # under plain names, as mapInArrow looks columns up by name, and only those that are needed
    used = list(dict.fromkeys([column, *keep]))
    plain = {c: f"c{i}" for i, c in enumerate(used)}
    rows = df.select(*(F.col(f"`{c}`").alias(plain[c]) for c in used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, kinds = make(), [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for i in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(i, rows_at_once)
                got = work([x or "" for x in part.column(plain[column]).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(plain[k]) for k in keep), *(pa.array(got[f.name], k) for f, k in zip(fields, kinds, strict=True))], names)

    return rows.mapInArrow(run, T.StructType([*(df.schema[k] for k in keep), *fields]))
