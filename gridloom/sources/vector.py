"""Vector and table files: GeoJSON, GeoParquet, GeoPackage, shapefiles, CSV and JSON profiles."""

from __future__ import annotations

import contextlib
import io
import itertools
import json
import sqlite3
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.polygons import REGION, area, kinds_of, map_rows, rings_of, value_of, within
from gridloom.sources import tiff

_GEOJSON = (
    "type string, features array<struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, kind, coordinates (JSON text) and props of each feature of one or many files."""
    rows = spark.read.schema(_GEOJSON).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select("f.id", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("props"))


def points_of(features: DataFrame) -> DataFrame:
    """x and y of the Point features."""
    xy = F.from_json("coordinates", "array<double>")
    return features.filter("kind = 'Point'").select("id", xy[0].alias("x"), xy[1].alias("y"), "props")


FEATURES = f"path string, fid long, kind string, region {REGION}, props map<string,string>"


def regions_of(features: DataFrame) -> DataFrame:
    """(id, kind, region, props) of :func:`read_geojson`'s rows: polygons' rings in one list, a line or point as one ring."""
    xy = "struct<x: double, y: double>"
    depth = {"Point": "array<double>", "LineString": "array<array<double>>", "MultiPoint": "array<array<double>>", "Polygon": "array<array<array<double>>>",
             "MultiLineString": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}
    place = lambda p: F.struct(p[0].alias("x"), p[1].alias("y")).cast(xy)
    line = lambda ring: F.transform(ring, place)
    out = F.lit(None).cast(REGION)
    for kind, form in depth.items():
        g = F.from_json("coordinates", form)
        level = form.count("array")
        value = F.array(F.array(place(g))) if level == 1 else F.array(line(g)) if level == 2 else F.transform(g if level == 3 else F.flatten(g), line)
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return features.select("id", "kind", out.alias("region"), "props")


def point_wkb(x, y):
    """``01 01000000`` and two little-endian doubles; only built-in functions."""
    return F.call_function("unhex", F.concat(F.lit("0101000000"), _hex(x), _hex(y)))


def _hex(x):
    """A double's bytes, the least first, as hex: from sign, exponent and fraction."""
    size = F.abs(x)
    e = F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))).cast("int"), F.lit(-1022))
    power = F.pow(F.lit(2.0), e.cast("double"))
    e = F.when(size / power >= 2, e + 1).when(size / power < 1, e - 1).otherwise(e)  # the logarithm may round over a power of two
    whole = (size / F.pow(F.lit(2.0), e.cast("double")) * F.lit(float(1 << 52))).cast("long")  # 2^52 and the fraction
    low = whole.bitwiseAND(F.lit((1 << 52) - 1)).bitwiseOR(F.call_function("shiftleft", (e + 1023).cast("long"), F.lit(52)))
    bits = F.when(size == 0, F.lit(0).cast("long")).otherwise(low)
    text = F.lpad(F.hex(F.when(x < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)), 16, "0")
    return F.concat(*[F.substring(text, i, 2) for i in range(15, 0, -2)])


def encode_wkb(kind: str, rings: list[list[tuple[float, float]]]) -> bytes:
    """Point, LineString, Polygon (first ring outside, others holes) or MultiPolygon (rings as they wind) as WKB."""
    ring = lambda p: struct.pack("<I", len(p)) + b"".join(struct.pack("<dd", *q) for q in p)
    closed = lambda p: ring([*p, p[0]] if p[0] != p[-1] else p)
    if kind == "Point":
        return struct.pack("<BIdd", 1, 1, *rings[0][0])
    if kind == "LineString":
        return struct.pack("<BI", 1, 2) + ring(rings[0])
    if kind == "Polygon":
        return struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(closed, rings))
    if kind == "MultiPolygon":
        outer = [r for r in rings if area([r]) >= 0]
        holes = [r for r in rings if area([r]) < 0]
        owned = [[o, *[h for h in holes if within([o], np.array(h[0][0]), np.array(h[0][1]))]] for o in outer]
        return struct.pack("<BII", 1, 6, len(owned)) + b"".join(encode_wkb("Polygon", r) for r in owned)
    raise ValueError(f"{kind} is not supported")


KINDS = ("", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


def decode_wkb(data: bytes, at: int = 0) -> tuple[str, list[list[tuple[float, float]]], int]:
    """Kind, rings (lines, points) and end of a WKB or EWKB geometry; heights and measures are dropped."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 9 if code & 0x20000000 else 5  # with a reference system
    kind, form = (code & 0xFFFF) % 1000, (code & 0xFFFF) // 1000
    size = 2 + bool(code & 0x80000000 or form in (1, 3)) + bool(code & 0x40000000 or form in (2, 3))

    def points(n: int) -> list[tuple[float, float]]:
        nonlocal at
        flat = struct.unpack_from(f"{order}{n * size}d", data, at)
        at += 8 * n * size
        return list(zip(flat[::size], flat[1::size]))

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(f"{order}I", data, at - 4)[0]

    if kind == 1:
        return KINDS[1], [points(1)], at
    if kind == 2:
        return KINDS[2], [points(count())], at
    if kind == 3:
        return KINDS[3], [points(count()) for _ in range(count())], at
    rings = []
    for _ in range(count()):
        _, part, at = decode_wkb(data, at)
        rings += part
    return KINDS[kind], rings, at


def write_points(df: DataFrame, path: str) -> None:
    """Points (x, y, ...) as GeoParquet: WKB in ``geometry`` beside their columns, and the ``geo`` metadata."""
    tiff.write_files(geoparquet_files(df.withColumn("geometry", point_wkb(F.col("x"), F.col("y"))), ["Point"]), path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_geoparquet(df: DataFrame, path: str, kind: str = "Polygon", epsg: int | None = None) -> None:
    """Features (region, ...) as GeoParquet with WKB in ``geometry`` in place of ``region``."""
    tiff.write_files(geoparquet_files(with_wkb(df, kind), [kind], epsg), path)


def with_wkb(df: DataFrame, kind: str) -> DataFrame:

    def encode(rows: list[dict]) -> list[dict]:
        return [{k: v for k, v in r.items() if k != "region"} | {"geometry": encode_wkb(kind, rings_of(r["region"])) if r["region"] else None} for r in rows]

    return map_rows(df, encode, f"{kinds_of(df, 'region')}, geometry binary")


def geoparquet_files(df: DataFrame, kinds: list[str], epsg: int | None = None) -> DataFrame:
    """(name, content): one file a partition, encoded in its task, with the metadata that makes it GeoParquet 1.1."""
    column = {"encoding": "WKB", "geometry_types": kinds} | ({"crs": {"type": "GeographicCRS" if 4000 <= epsg < 5000 else "ProjectedCRS", "name": f"EPSG:{epsg}", "id": {"authority": "EPSG", "code": epsg}}} if epsg else {})
    geo = json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            t = t.replace_schema_metadata({"geo": geo})
            out = io.BytesIO()
            pq.write_table(t, out)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{uuid.uuid4().hex}.parquet"]), pa.array([out.getvalue()], pa.binary())], names=["name", "content"])

    return df.mapInArrow(run, "name string, content binary")


def _scan(found: DataFrame, parse) -> DataFrame:
    """Features of files (path, content, ...): ``parse`` yields (fid, kind, rings, props) of a row."""

    def rows(files: list[dict]) -> list[dict]:
        return [
            {"path": f["path"], "fid": fid, "kind": kind, "region": value_of(rings), "props": [(k, None if v is None else str(v)) for k, v in props.items()]}
            for f in files
            for fid, kind, rings, props in parse(f)
        ]

    return map_rows(found, rows, FEATURES)


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """Features of GeoParquet: the columns of the files with ``kind`` and ``region`` in place of the WKB."""
    df = spark.read.parquet(path)

    def decode(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            kind, rings, _ = decode_wkb(r[geometry]) if r[geometry] is not None else (None, None, 0)
            out.append({k: v for k, v in r.items() if k != geometry} | {"kind": kind, "region": None if rings is None else value_of(rings)})
        return out

    return map_rows(df, decode, f"{kinds_of(df, geometry)}, kind string, region {REGION}")


def gpkg_layers(content: bytes) -> list[tuple[str, str, int]]:
    """(table, geometry column, reference system) of a GeoPackage."""
    with contextlib.closing(sqlite3.connect(":memory:")) as c:
        c.deserialize(content)
        return c.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY table_name").fetchall()


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Features of one layer (the first, if not named) of GeoPackages, a file a task."""

    def parse(row):
        layers = {t: g for t, g, _ in gpkg_layers(row["content"])}
        name = layer or next(iter(layers), None)
        if name not in layers:
            raise ValueError(f"no layer {layer} in {row['path']}")
        with contextlib.closing(sqlite3.connect(":memory:")) as c:
            c.deserialize(row["content"])
            quoted = '"' + name.replace('"', '""') + '"'
            found = c.execute(f"SELECT rowid, * FROM {quoted}")
            names = [d[0] for d in found.description]
            for values in found:
                props = dict(zip(names[1:], values[1:]))
                blob = props.pop(layers[name])
                kind, rings = None, []
                if blob and not blob[3] & 16:  # not an empty geometry
                    kind, rings, _ = decode_wkb(blob, 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7])
                yield values[0], kind, rings, props

    return _scan(tiff.files(spark, path), parse)


def list_gpkg_layers(spark: SparkSession, path: str) -> DataFrame:
    def rows(files: list[dict]) -> list[dict]:
        return [{"path": f["path"], "layer": t, "geometry": g, "srs_id": n} for f in files for t, g, n in gpkg_layers(f["content"])]

    return map_rows(tiff.files(spark, path), rows, "path string, layer string, geometry string, srs_id int")


def shapes(content: bytes) -> Iterator[tuple[str | None, list]]:
    """Kind and rings of each record of a .shp file."""
    at = 100
    while at + 8 <= len(content):
        (words,) = struct.unpack_from(">i", content, at + 4)
        p = at + 8
        (code,) = struct.unpack_from("<i", content, p)
        if code % 10 == 1:
            yield "Point", [[struct.unpack_from("<dd", content, p + 4)]]
        elif code % 10 in (3, 5):
            parts, n = struct.unpack_from("<ii", content, p + 36)
            starts = [*struct.unpack_from(f"<{parts}i", content, p + 44), n]
            flat = struct.unpack_from(f"<{2 * n}d", content, p + 44 + 4 * parts)
            xy = list(zip(flat[::2], flat[1::2]))
            yield ("MultiLineString" if code % 10 == 3 else "Polygon"), [xy[a:z] for a, z in zip(starts, starts[1:])]
        elif code % 10 == 8:
            (n,) = struct.unpack_from("<i", content, p + 36)
            flat = struct.unpack_from(f"<{2 * n}d", content, p + 40)
            yield "MultiPoint", [[q] for q in zip(flat[::2], flat[1::2])]
        else:
            yield None, []
        at += 8 + 2 * words


def dbf_rows(content: bytes) -> Iterator[dict[str, str | None]]:
    n, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 13:
        fields.append((content[at : at + 11].split(b"\x00")[0].decode("latin-1"), content[at + 16]))
        at += 32
    for i in range(n):
        p, row = head + i * size + 1, {}
        for name, width in fields:
            row[name] = content[p : p + width].decode("utf-8", "replace").strip(" \x00") or None
            p += width
        yield row


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Features of a folder or pattern of .shp files, with the fields of the .dbf of the same name beside each."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    both = tiff.files(spark, path).withColumn("stem", stem).withColumn("end", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))
    shp = both.filter("end = 'shp'").drop("end")
    dbf = both.filter("end = 'dbf'").select("stem", F.col("content").alias("dbf"))

    def parse(row):
        table = dbf_rows(row["dbf"]) if row["dbf"] is not None else itertools.repeat({})
        for i, ((kind, rings), props) in enumerate(zip(shapes(row["content"]), table)):
            yield i, kind, rings, props

    return _scan(shp.join(dbf, "stem", "left").drop("stem"), parse)


def read_vector(spark: SparkSession, path: str, **options) -> DataFrame:
    """Features by the ending of the path: GeoJSON, GeoPackage, shapefile (its folder's pattern) or GeoParquet."""
    end = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    if end in ("json", "geojson"):
        return regions_of(read_geojson(spark, path))
    if end == "gpkg":
        return read_gpkg(spark, path, **options)
    if end == "shp":
        return read_shapefile(spark, path[: -len(end)] + "*")
    return read_geoparquet(spark, path, **options)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_grouped_json(df: DataFrame, key: str, path: str) -> None:
    """One object a key with its rows as an array."""
    rest = [c for c in df.columns if c != key]
    df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("nodes")).write.mode("overwrite").json(path)
