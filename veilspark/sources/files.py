"""Discovery, annotated text tables, codebooks, derived layers and hashes.

A header is a few lines at the top of a file; they are read through Spark (a limit), so any file system that Spark
reads will do. Rows are never read on the driver."""

from __future__ import annotations

import csv
import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import timestamps as TS
from veilspark.sources import records
from veilspark.sources.records import ORDINAL

# fixed values: what is left out, stages, words of a codebook's name, texts that mean a missing value
CHECKPOINTS = ".ipynb_checkpoints"
STAGES = ("raw", "processed")
CODEBOOK_WORDS = ("questions", "response_options")
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Lines of a file that are looked at first for its header; as long as they are all comments, so many times more.
HEADER_LINES, MORE = 2_000, 8
#: Bytes up to which a file's hash is made from its content in one cell; larger files are read in blocks.
ONE_CELL, HASH_BLOCK = 256 << 20, 1 << 20


@dataclass(frozen=True)
class Found:
    path: str
    relpath: str
    source: str
    stage: str
    role: str
    size: int


def role_of(stage: str, name: str) -> str:
    return "codebook" if stage == "raw" and any(w in name.lower() for w in CODEBOOK_WORDS) else "data"


def discover(spark: SparkSession, data_dir: str) -> list[Found]:
    """All .csv and .tsv files below the directory, by relative path. Lists files; no content is read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(data_dir)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    top, out, todo = fs.makeQualified(root).toUri().getPath().rstrip("/"), [], [root]
    while todo:
        for s in fs.listStatus(todo.pop()):
            name, path = s.getPath().getName(), s.getPath().toUri().getPath()
            if s.isDirectory():
                if name != CHECKPOINTS:
                    todo.append(s.getPath())
            elif name.lower().endswith((".csv", ".tsv")):
                rel = path[len(top) + 1 :]
                parts = rel.split("/")
                stage = next((p for p in parts if p in STAGES), "")
                out.append(Found(s.getPath().toString(), rel, parts[0] if len(parts) > 1 else "", stage, role_of(stage, name), s.getLen()))
    return sorted(out, key=lambda f: f.relpath)


def catalog(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same as a table, for joins with dictionaries."""
    schema = "path string, relpath string, source string, stage string, role string, size long"
    return spark.createDataFrame([(f.path, f.relpath, f.source, f.stage, f.role, f.size) for f in discover(spark, data_dir)], schema)


@dataclass
class Header:
    delimiter: str = ","
    metadata: list[str] = field(default_factory=list)
    descriptions: dict[str, str] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    #: Lines above the first row.
    skip: int = 0


def parse_header(lines: Sequence[str], tsv: bool) -> Header:
    """Lines that begin with # are metadata, and descriptions if they read "name: text" and name a column; blank
    lines are skipped; the first other line has the columns' names. Tabs part them in a .tsv or if there are more tabs
    than commas."""
    out, said = Header("\t" if tsv else ","), {}
    for i, line in enumerate(lines):
        if line.startswith("#"):
            body = line[1:].strip()
            out.metadata.append(body)
            if m := re.fullmatch(r"([\w.]+)\s*:\s*(\S.*)", body, re.ASCII):
                said[m[1]] = m[2].strip()
        elif line.strip():
            if not tsv and line.count("\t") > line.count(","):
                out.delimiter = "\t"
            out.names, out.skip = next(csv.reader([line], delimiter=out.delimiter)), i + 1
            break
    out.descriptions = {k: v for k, v in said.items() if k in out.names}
    return out


def read_header(spark: SparkSession, path: str) -> Header:
    n = HEADER_LINES
    while True:
        lines = [r.value for r in spark.read.text(path).limit(n).collect()]
        header = parse_header(lines, path.lower().endswith(".tsv"))
        if header.names or len(lines) < n:
            return header
        n *= MORE


def scan(spark: SparkSession, path: str, header: Header | None = None) -> DataFrame:
    """The file's rows as text columns, missing values as null, with ORDINAL, which grows in the order of the lines; of
    a folder, the rows of all its files, which begin with the same head. Only the header's own lines are skipped: later
    lines that begin with # are rows, and so are columns named so. Rows with fewer cells are filled up with nulls; cells
    beyond the header's are left out. A file that ends inside quotes is refused."""
    header = header or read_header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType(), True, {"description": header.descriptions[n]} if n in header.descriptions else {}) for n in header.names])
    if not header.names:
        return spark.createDataFrame([], schema.add(ORDINAL, T.LongType()))
    cells = records.cells_of(spark, path, header.delimiter, header.skip)
    value = lambda i: F.when(~F.get("cells", i).isin(*MISSING), F.get("cells", i))
    return cells.select(*(value(i).alias(n, metadata=schema[n].metadata) for i, n in enumerate(header.names)), ORDINAL)


def infer_types(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The scanned columns as long, double or boolean where all their values are; and the names such types go by:
    int64, float64 (integers with gaps, too), bool (without gaps), object."""
    names = [c for c in df.columns if c != ORDINAL]
    checks = []
    for i, n in enumerate(names):
        c = F.trim(F.col(f"`{n}`"))
        whole, number, truth = c.rlike(r"^[+-]?\d{1,18}$"), c.try_cast("double").isNotNull() & ~c.rlike(r"[dDfF]$"), F.lower(c).isin("true", "false")
        checks += [F.count(c).alias(f"n{i}"), F.count(F.lit(1)).alias(f"a{i}"), F.count_if(whole).alias(f"w{i}"), F.count_if(number).alias(f"f{i}"), F.count_if(truth).alias(f"b{i}")]
    kinds, casts = {}, []
    for start in range(0, len(names), 200):  # wide tables in groups, as plans with thousands of sums don't compile
        row = df.agg(*checks[start * 5 : (start + 200) * 5]).first()
        for i, n in list(enumerate(names))[start : start + 200]:
            some, every, whole, number, truth = (row[f"{k}{i}"] for k in "nawfb")
            c = F.trim(F.col(f"`{n}`"))
            if some and whole == some:
                kinds[n], cast = ("int64" if some == every else "float64"), c.cast("long" if some == every else "double")
            elif some and number == some or not some and every:
                kinds[n], cast = "float64", c.cast("double")
            elif some and truth == some == every:
                kinds[n], cast = "bool", F.lower(c).cast("boolean")
            else:
                kinds[n], cast = "object", F.col(f"`{n}`")
            casts.append(cast.alias(n, metadata=df.schema[n].metadata))
    return df.select(*casts, *([ORDINAL] if ORDINAL in df.columns else [])), kinds


def codebook_text(df: DataFrame, cap: int = 1000) -> DataFrame:
    """column, values: each column's distinct texts in order, at most cap of them and then how many more there are."""
    names = [c for c in df.columns if c != ORDINAL]
    cells = F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in names))
    values = df.select(F.explode(cells).alias("c")).select("c.*").filter("value IS NOT NULL").distinct()
    sizes = values.groupBy("column").agg(F.count(F.lit(1)).alias("n"))  # one row a column
    first = values.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("value"))).filter(F.col("r") <= cap)
    kept = first.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("v"))
    more = F.when(F.col("n") > cap, F.array(F.format_string("…(%d more)", F.col("n") - cap))).otherwise(F.array().cast("array<string>"))
    return kept.join(F.broadcast(sizes), "column").select("column", F.concat("v", more).alias("values"))


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def bare_path(path: str) -> str:
    """Without the scheme and host, so that paths from listings and readers compare."""
    return "/" + re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", path).lstrip("/")


def file_hashes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path (bare), bytes, sha256 of whole files, or of all files in folders. A task reads a large file in blocks, so
    none is held whole."""
    found = spark.read.format("binaryFile").load(list(paths))
    bare = F.concat(F.lit("/"), F.ltrim(F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:(//[^/]*)?", ""), F.lit("/")))
    small = found.filter(F.col("length") <= ONE_CELL).select(bare.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = found.filter(F.col("length") > ONE_CELL).select("path", "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            out = []
            for path, n in zip(pdf["path"], pdf["length"], strict=True):
                system, at = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))
                digest = hashlib.sha256()
                with system.open_input_stream(at) as stream:
                    while block := stream.read(HASH_BLOCK):
                        digest.update(block)
                out.append((bare_path(path), n, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "bytes", "sha256"])

    return small.unionByName(large.mapInPandas(run, "path string, bytes long, sha256 string"))


def timestamp_column(df: DataFrame, name: str, kind: str):
    """The parsed timestamps of a column whose name says time, or None: numbers must be of an epoch's size, texts are
    parsed by themselves."""
    from veilspark.functions.names import is_birth_name, is_datetime_name
    from veilspark.operators.profile import is_numeric

    numeric = is_numeric(df.schema[name])
    real = isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType))
    if is_birth_name(name) or not (is_datetime_name(name) or real):
        return None
    c = F.col(f"`{name}`")
    if real:
        return c.cast("timestamp")
    if not numeric:
        return TS.parse_mixed(c)
    unit = df.agg(TS.epoch_unit(F.median(F.abs(c.cast("double")))).alias("u")).first().u
    return TS.from_epoch(c, unit) if unit else None
