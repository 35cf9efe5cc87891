"""Tables that a later step reads more than once, written where all executors see them: in spark.checkpoint.dir, or in
local mode, where that is unset, in a temporary folder. A written table outlives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def new_folder(spark: SparkSession) -> str:
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own = _own or tempfile.mkdtemp(prefix="veilspark-")
        base = f"file://{_own}"
    return f"{base.rstrip('/')}/core-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
