"""Shared plumbing: worker paths, written intermediates, sorted group runs."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_see_package(spark: SparkSession) -> None:
    """Python workers import this package by path, whatever the driver's folder is."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow``, after which the worker gives its free memory back, as it may idle beside other tasks."""
    spark = df.sparkSession
    workers_see_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(fn(batches))
        give_back()

    return df.mapInArrow(run, schema)


#: Rows of an Arrow batch at most, so that batches of long texts stay small on both sides.
BATCH_ROWS = 2_000


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Joins many small batches into fewer."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not held and b.num_rows >= BATCH_ROWS:
            yield b
            continue
        held.append(b)
        n += b.num_rows
        if n >= BATCH_ROWS or len(held) >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of this process only where none is named and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    global _OWN
    if _OWN is None:
        _OWN = tempfile.TemporaryDirectory(prefix="gridloom-")
    return _OWN.name


_OWN: tempfile.TemporaryDirectory | None = None


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes a Parquet table in the shared folder and reads it back.

    Every executor can read the table again after any executor is lost. The
    table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or os.getpid() != _PID:
        return
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # the JVM may have ended before Python does
        del e


_PID = os.getpid()


def sorted_groups(df: DataFrame, key: list[str], order: list[str] = ()) -> DataFrame:
    """Rows of a key in one partition and side by side, for :func:`runs`; sorted outside memory."""
    return df.repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, *order)


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from sorted batches, one at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n - 1, bool)
        for k in key:
            col = batch.column(k).to_numpy(zero_copy_only=False)
            change |= col[1:] != col[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in key):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < n:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def multi_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of each run of two or more equal keys in sorted batches; single rows are passed over."""
    held: dict[str, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: _array(batch.column(c)) for c in batch.schema.names}
        k = cols[key]
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        first_end = int(cuts[0]) if len(cuts) else len(k)
        if held:
            if held[key][-1][-1] == k[0]:
                for c, a in cols.items():
                    held[c].append(a[:first_end])
                if not len(cuts):
                    continue
            if sum(map(len, held[key])) > 1:
                yield {c: np.concatenate(a) for c, a in held.items()}
            begin = first_end if held[key][-1][-1] == k[0] else 0
        else:
            begin = 0
        edges = np.concatenate([[begin], cuts[cuts > begin], [len(k)]])
        for i in np.flatnonzero(np.diff(edges[:-1]) > 1):
            yield {c: a[edges[i] : edges[i + 1]] for c, a in cols.items()}
        held = {c: [a[edges[-2] :]] for c, a in cols.items()}
    if held and sum(map(len, held[key])) > 1:
        yield {c: np.concatenate(a) for c, a in held.items()}


def _array(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' component, for edges within one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        new = new[new]
        if (new == root).all():
            return root
        root = new


def sized(df: DataFrame, row_bytes: int, array: str | None = None, item_bytes: int = 0, limit: int = 32 << 20) -> DataFrame:
    """A written table, marked for broadcast only where its counted rows, and the items of its column
    ``array``, fit in ``limit`` bytes; beyond it the planner shuffles both sides."""
    items = F.coalesce(F.sum(F.size(array)), F.lit(0)) if array else F.lit(0)
    n = df.agg(F.count("*").alias("rows"), items.alias("items")).first()
    return F.broadcast(df) if n["rows"] * row_bytes + n["items"] * item_bytes <= limit else df


def packed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns as one struct), doc_id and text: no name of the table's own can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` back from ``row``, with ``text`` as it is in ``df`` and n_chars, if there, after it."""
    out = []
    for f in docs.schema:
        col = F.col(f"row.`{f.name}`")
        if f.name == "text":
            col = F.col("text")
        elif f.name == "n_chars":
            col = F.length("text").cast(f.dataType)
        out.append(col.alias(f.name))
    return df.select(*out)
