"""Grids and cubes as Parquet: tiles are partitions, so a bounding box prunes files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 256


def write_grid(grid: DataFrame, path: str, tile: int = TILE) -> None:
    """(r, c, ...) by tile row and column."""
    keyed = grid.withColumns({"tr": F.floor(F.col("r") / tile).cast("int"), "tc": F.floor(F.col("c") / tile).cast("int")})
    keyed.repartition("tr", "tc").sortWithinPartitions("r", "c").write.mode("overwrite").partitionBy("tr", "tc").parquet(path)


def read_window(spark: SparkSession, path: str, r0: int, r1: int, c0: int, c1: int, tile: int = TILE) -> DataFrame:
    """Rows r0..r1 and columns c0..c1: partitions are pruned by tile, row groups by r and c."""
    g = spark.read.parquet(path).filter(F.col("tr").between(r0 // tile, r1 // tile) & F.col("tc").between(c0 // tile, c1 // tile))
    return g.filter(F.col("r").between(r0, r1) & F.col("c").between(c0, c1)).drop("tr", "tc")


def write_cube(cube: DataFrame, path: str) -> None:
    """(t, r, c, v) by time."""
    cube.write.mode("overwrite").partitionBy("t").parquet(path)
