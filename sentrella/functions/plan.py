"""Helpers that keep plans in shape."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fence(df: DataFrame, *before: str) -> DataFrame:
    """The same rows, with every column but ``before`` computed exactly once.

    Catalyst moves filters below projections by writing their expressions out in full. For
    columns that rest on a hundred patterns each, such a filter would repeat the whole chain
    for every use. A one-row generator is a place that such filters don't cross."""
    made = [c for c in df.columns if c not in before]
    return df.select(*before, F.inline(F.array(F.struct(*made))))


_scratch: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach, named by ``spark.checkpoint.dir``.
    Where that is unset, a temporary folder where driver and executors are one machine, and an
    error on a cluster, whose default folders are each machine's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="sentrella-")
    return _scratch[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: a later plan that uses them
    several times holds a scan for each use instead of the whole chain."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sentrella-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
