"""Grids with a place on the ground: alignment, boxes, and resampling between UTM zones."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geo


@dataclass(frozen=True)
class Placement:
    """Size of a grid, its upper left corner, its cells (dy negative where north is up), and its system."""

    rows: int
    cols: int
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = -1.0
    epsg: int | None = None

    @property
    def bytes(self) -> int:
        """As doubles."""
        return 8 * self.rows * self.cols

    @property
    def box(self) -> tuple[float, float, float, float]:
        xs, ys = sorted((self.x0, self.x0 + self.cols * self.dx)), sorted((self.y0, self.y0 + self.rows * self.dy))
        return xs[0], ys[0], xs[1], ys[1]

    def strip(self, k: int, rows: int, pad: float = 0.0) -> tuple[int, int, tuple[float, float, float, float]]:
        """First row, end row and (padded) box of the k-th run of ``rows`` rows."""
        a, z = min(k * rows, self.rows), min((k + 1) * rows, self.rows)
        ys = sorted((self.y0 + a * self.dy, self.y0 + z * self.dy))
        x0, _, x1, _ = self.box
        return a, z, (x0 - pad, ys[0] - pad, x1 + pad, ys[1] + pad)


def check_same_shape(*grids: Placement) -> None:
    sizes = {(g.rows, g.cols) for g in grids}
    if len(sizes) > 1:
        raise ValueError(f"grids of different sizes: {sorted(sizes)}")


def check_same_crs(*grids: Placement) -> None:
    """Systems that are not known agree with any."""
    codes = {g.epsg for g in grids} - {None}
    if len(codes) > 1:
        raise ValueError(f"grids of different systems: {sorted(codes)}")


def check_aligned(*grids: Placement) -> None:
    """One size, one system, and the same corner and cells within a share of 1e-9."""
    check_same_shape(*grids)
    check_same_crs(*grids)
    for g in grids[1:]:
        for name in ("x0", "y0", "dx", "dy"):
            a, b = getattr(grids[0], name), getattr(g, name)
            if abs(a - b) > 1e-9 * max(abs(a), abs(b), 1.0):
                raise ValueError(f"grids of different {name}: {a} and {b}")


def parts_of_complex(grid: DataFrame, col: str = "v") -> tuple[DataFrame, DataFrame]:
    """The real and the imaginary grid of one whose cells are struct<re, im>."""
    return tuple(grid.select("r", "c", F.col(f"{col}.{part}").alias(col)) for part in ("re", "im"))


def best_dates(coverage: DataFrame, most: int) -> DataFrame:
    """The ``most`` days of the largest coverage (day, n); of equal ones the earlier."""
    return coverage.orderBy(F.col("n").desc(), F.col("day")).limit(most)


def search_limit(width: float, height: float, scenes: int) -> int:
    """Items to ask a catalogue for over a box of degrees: five for each scene and 60 km square, within 1,000 and 10,000."""
    across = [max(1, math.ceil(abs(x) * 111.0 / 60.0)) for x in (width, height)]
    return min(max(across[0] * across[1] * scenes * 5, 1000), 10_000)


def box_in(box: tuple[float, float, float, float], point) -> tuple[float, float, float, float]:
    """The box round the four corners of a box under ``point`` (x, y) -> (x, y)."""
    xs, ys = zip(*(point(x, y) for x in box[::2] for y in box[1::2]))
    return min(xs), min(ys), max(xs), max(ys)


def placed(grid: DataFrame, x0: float, y0: float, size: float) -> DataFrame:
    """(x, y, v): a grid's cells by the places of their middles."""
    return grid.select((F.lit(x0) + (F.col("c") + 0.5) * size).alias("x"), (F.lit(y0) - (F.col("r") + 0.5) * size).alias("y"), "v")


def between_utm(cells: DataFrame, source: int, target: int) -> DataFrame:
    """(r, c, v): a north-up grid of square cells (x, y, v) in one UTM zone, bilinear on a grid of the same cell size in another.

    The target covers the box of the corners; its cells are made by a range, not from data, and each asks
    the source for the four cells round it by an equi-join, so nothing but those four rows a cell is moved.
    A cell is null unless all four hold data.
    """
    zones = geo.utm_zone(source), geo.utm_zone(target)
    if None in zones:
        raise ValueError(f"no UTM zones: {source}, {target}")
    spark = cells.sparkSession
    ends = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.countDistinct("x").alias("n")).first()  # one row
    if ends["x0"] is None:
        return spark.createDataFrame([], "r int, c int, v double")
    size = (ends["x1"] - ends["x0"]) / max(ends["n"] - 1, 1) or 1.0

    def across(df: DataFrame, a, b) -> DataFrame:
        """``x`` and ``y`` from one zone in the other, by way of degrees as columns of their own."""
        lon, lat = geo.from_utm("x", "y", *a)
        rest = [c for c in df.columns if c not in ("x", "y")]
        e, n = geo.to_utm("_lon", "_lat", *b)
        return df.selectExpr(*rest, f"{lon} AS _lon", f"{lat} AS _lat").selectExpr(*rest, f"{e} AS x", f"{n} AS y")

    corners = spark.createDataFrame([(ends[f"x{i}"], ends[f"y{j}"]) for i in (0, 1) for j in (0, 1)], "x double, y double")
    far = across(corners, *zones).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()  # one row
    cols, rows = (math.ceil((far[f"{k}1"] - far[f"{k}0"]) / size) + 1 for k in "xy")
    target_cells = spark.range(rows * cols).selectExpr(f"CAST(floor(id / {cols}) AS INT) AS r", f"CAST(id % {cols} AS INT) AS c")
    target_cells = target_cells.selectExpr("r", "c", f"{far['x0']!r}D + c * {size!r}D AS x", f"{far['y1']!r}D - r * {size!r}D AS y")
    spot = across(target_cells, *zones[::-1]).selectExpr("r", "c", f"(x - {ends['x0']!r}D) / {size!r}D AS sx", f"({ends['y1']!r}D - y) / {size!r}D AS sy")
    near = F.array(*[F.struct((F.floor("sy") + a).alias("sr"), (F.floor("sx") + b).alias("sc")) for a in (0, 1) for b in (0, 1)])
    spot = spot.select("r", "c", "sx", "sy", F.explode(near).alias("k")).select("r", "c", "sx", "sy", "k.sr", "k.sc")
    source_cells = cells.select(F.round((ends["y1"] - F.col("y")) / size).cast("long").alias("sr"), F.round((F.col("x") - ends["x0"]) / size).cast("long").alias("sc"), "v")
    weight = (1 - F.abs(F.col("sx") - F.col("sc"))) * (1 - F.abs(F.col("sy") - F.col("sr")))
    got = spot.join(source_cells, ["sr", "sc"]).groupBy("r", "c").agg(F.count("v").alias("n"), F.sum(F.col("v") * weight).alias("v"))
    return got.select("r", "c", F.when(F.col("n") == 4, F.col("v")).alias("v"))
