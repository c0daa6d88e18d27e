"""Grids derived from tables, as DataFrames and as the same SQL for other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.focal import dense

SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c, n: (F.col(c) % SIDE).cast("int").alias(n)
    return table(spark, sf_dir, "lineitem").select(key("l_partkey", "r"), key("l_orderkey", "c"), "l_quantity", "l_linenumber")


def g_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by part and order remainder: 32 x 32 cells, dense."""
    g = _keyed(spark, sf_dir).groupBy("r", "c").agg(F.sum("l_quantity").cast("double").alias("v"))
    return dense(g, SIDE, SIDE)


def g_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bands on the same cells."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    g = _keyed(spark, sf_dir).groupBy("r", "c").agg(
        F.sum(q).cast("double").alias("b1"), F.count("*").cast("double").alias("b2"),
        F.sum(n).cast("double").alias("b3"), F.sum(q * n).cast("double").alias("b4"),
    )
    return g


def zoned(grid: DataFrame) -> DataFrame:
    """Adds ``zone``: sixteen 8 x 8 blocks, block 0 being nodata."""
    return grid.withColumn("zone", (F.floor(F.col("r") / 8) * 4 + F.floor(F.col("c") / 8)).cast("int"))


def g_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g_qty(spark, sf_dir).select("r", "c", (F.col("v").cast("long") % 4).cast("double").alias("v"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, t, v): events by user cell and day; days without events are absent."""
    e = table(spark, sf_dir, "events")
    return (
        e.select(
            (F.col("user_id") % 8).cast("int").alias("r"), (F.floor(F.col("user_id") / 8).cast("int") % 8).alias("c"),
            F.dayofmonth("ts").cast("double").alias("t"),
        ).groupBy("r", "c", "t").agg(F.count("*").cast("double").alias("v"))
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, r, c, v, qa): one scene an event type."""
    e = table(spark, sf_dir, "events")
    return (
        e.select(
            F.col("event_type").alias("scene"), (F.col("user_id") % 8).cast("int").alias("r"),
            (F.floor(F.col("user_id") / 8).cast("int") % 8).alias("c"),
        ).groupBy("scene", "r", "c").agg(F.count("*").cast("double").alias("v"), (F.count("*") % 32).cast("int").alias("qa"))
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, value) from the first three components of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i, n: F.col("embedding")[i].cast("double").alias(n)
    return e.select(F.col("vec_id").alias("id"), at(0, "x"), at(1, "y"), at(2, "value"))


SQL = {
    "g": "g AS (SELECT a.r, a.c, b.v FROM (SELECT CAST(i // 32 AS INT) r, CAST(i % 32 AS INT) c FROM range(1024) t(i)) a LEFT JOIN (SELECT CAST(l_partkey%32 AS INT) r, CAST(l_orderkey%32 AS INT) c, CAST(SUM(l_quantity) AS DOUBLE) v FROM lineitem GROUP BY 1,2) b ON a.r = b.r AND a.c = b.c)",
    "bands": "bands AS (SELECT CAST(l_partkey%32 AS INT) r, CAST(l_orderkey%32 AS INT) c, CAST(SUM(l_quantity) AS DOUBLE) b1, CAST(COUNT(*) AS DOUBLE) b2, CAST(SUM(l_linenumber) AS DOUBLE) b3, CAST(SUM(l_quantity*l_linenumber) AS DOUBLE) b4 FROM lineitem GROUP BY 1,2)",
    "gz": "gz AS (SELECT *, CAST(floor(r/8.0)*4 + floor(c/8.0) AS INT) zone FROM g)",
    "gc": "gc AS (SELECT r, c, CAST(CAST(v AS BIGINT) % 4 AS DOUBLE) v FROM g)",
    "cube": "cube AS (SELECT CAST(user_id % 8 AS INT) r, CAST(CAST(floor(user_id/8.0) AS INT) % 8 AS INT) c, CAST(day(ts) AS DOUBLE) t, CAST(COUNT(*) AS DOUBLE) v FROM events GROUP BY 1,2,3)",
    "scenes": "scenes AS (SELECT event_type scene, CAST(user_id % 8 AS INT) r, CAST(CAST(floor(user_id/8.0) AS INT) % 8 AS INT) c, CAST(COUNT(*) AS DOUBLE) v, CAST(COUNT(*) % 32 AS INT) qa FROM events GROUP BY 1,2,3)",
    "pts": "pts AS (SELECT vec_id id, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) value FROM embeddings)",
}


def nine(source: str = "g", name: str = "z") -> str:
    """SQL of the nine neighbours z1..z9 of each cell of ``source``, by a self-join."""
    cols = ", ".join(
        f"max(CASE WHEN n.r = m.r + {dr} AND n.c = m.c + {dc} THEN n.v END) z{3 * (dr + 1) + dc + 2}" for dr in (-1, 0, 1) for dc in (-1, 0, 1)
    )
    return f"{name} AS (SELECT m.r, m.c, count(n.v) = 9 AS full9, {cols} FROM {source} m JOIN {source} n ON abs(n.r - m.r) <= 1 AND abs(n.c - m.c) <= 1 GROUP BY m.r, m.c)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(SQL.get(p, p) for p in parts) + " "
