"""Grids as PNG images, a block of the grid a file."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.colours import rgba
from gridloom.plans.lineage import workers_see_package
from gridloom.sources.tiff import write_files


def encode_png(pixels: np.ndarray) -> bytes:
    """(rows, columns, 4) bytes as an image."""
    n, m, _ = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((n, 1), np.uint8), np.ascontiguousarray(pixels, np.uint8).reshape(n, 4 * m)], 1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", m, n, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def coloured(grid: DataFrame, scheme: str = "terrain", low: float | None = None, high: float | None = None) -> DataFrame:
    """(r, c, red, green, blue, opacity); the range is that of the grid unless it is given."""
    if low is None or high is None:
        ends = grid.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()  # one row
        low, high = (ends["low"] if low is None else low), (ends["high"] if high is None else high)
    low, high = (0.0, 1.0) if low is None else (float(low), float(high))
    return grid.selectExpr("r", "c", *[f"{text} AS {name}" for name, text in rgba(scheme, "v", f"{low!r}D", f"{high!r}D").items()])


def images(pixels: DataFrame, side: int = 2048) -> DataFrame:
    """(name, content) of one image for each block of ``side`` cells of :func:`coloured`'s rows."""
    workers_see_package(pixels.sparkSession)

    def one(p: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(p["br"].iloc[0]), int(p["bc"].iloc[0])
        r, c = p["r"].to_numpy() - br * side, p["c"].to_numpy() - bc * side
        out = np.zeros((r.max() + 1, c.max() + 1, 4), np.uint8)
        out[r, c] = p[["red", "green", "blue", "opacity"]].to_numpy()
        return pd.DataFrame({"name": [f"{br}_{bc}.png"], "content": [encode_png(out)]})

    at = lambda n: F.floor(F.col(n) / side).cast("int")
    return pixels.withColumns({"br": at("r"), "bc": at("c")}).groupBy("br", "bc").applyInPandas(one, "name string, content binary")


def write_png(grid: DataFrame, folder: str, scheme: str = "terrain", side: int = 2048) -> None:
    write_files(images(coloured(grid, scheme), side), folder)
