"""Every registered query with SQL against that SQL on DuckDB, on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each family; the driver compares all of them.
NAMES = [
    "zonal_statistics", "slope_degrees", "focal_median_circular", "tpi", "vrm", "morph_top_hat", "ndvi", "histogram_match", "mann_kendall",
    "global_morans_i", "class_metrics", "hand", "landform_classification", "idw", "wgs84_to_utm", "resample_bilinear", "zonal_join_region",
    "read_geotiff_window", "read_cog_overview", "read_geoparquet", "overlay_union", "overlay_difference", "dissolve", "convex_hull", "buffer_geometry",
    "rasterize_polygons", "clip_raster_by_polygon", "terrain_all", "wetness_from_surface", "pipeline_features", "raster_to_rgba_terrain", "detect_band_type",
]


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(want)
