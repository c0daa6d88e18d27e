"""Written intermediates for loops: a table in the shared folder cuts the plan and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: tempfile.TemporaryDirectory | None = None


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where none is named and the master is local, as in tests."""
    global _OWN
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        _OWN = _OWN or tempfile.TemporaryDirectory(prefix="gridloom-")
        root = _OWN.name
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_root(spark)}/grid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def workers_see_package(spark: SparkSession) -> None:
    """Python workers import this package by path, whatever the driver's folder is."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
