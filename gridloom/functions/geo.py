"""Coordinates as SQL text: affine transforms, UTM, the spheroid, sun and vectors."""

from __future__ import annotations

import math

from gridloom.functions.surface import num

#: WGS84 (fixed values).
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
K0 = 0.9996


def pixel_of(x: str, y: str, x0: float, y0: float, w: float, h: float) -> tuple[str, str]:
    """Row and column of a point on a north-up grid (h < 0)."""
    return f"CAST(floor(({y} - {num(y0)}) / {num(h)}) AS INT)", f"CAST(floor(({x} - {num(x0)}) / {num(w)}) AS INT)"


def centre_of(r: str, c: str, x0: float, y0: float, w: float, h: float) -> tuple[str, str]:
    return f"({num(x0)} + ({c} + 0.5E0) * {num(w)})", f"({num(y0)} + ({r} + 0.5E0) * {num(h)})"


def cell_dimensions(lat: str, d_lon: float, d_lat: float) -> tuple[str, str]:
    """Width and height in metres of a cell of a geographic grid."""
    s = f"sin(radians({lat}))"
    w = f"(1 - {num(E2)} * {s} * {s})"
    return (
        f"({num(math.radians(d_lon) * A)} * cos(radians({lat})) / sqrt({w}))",
        f"({num(math.radians(d_lat) * A * (1 - E2))} / ({w} * sqrt({w})))",
    )


def to_utm(lon: str, lat: str, zone: int, north: bool = True) -> tuple[str, str]:
    """Easting and northing by Snyder's series."""
    ep = E2 / (1 - E2)
    phi = f"radians({lat})"
    n = f"({num(A)} / sqrt(1 - {num(E2)} * sin({phi}) * sin({phi})))"
    t, c = f"(tan({phi}) * tan({phi}))", f"({num(ep)} * cos({phi}) * cos({phi}))"
    a = f"(radians({lon} - ({zone * 6 - 183})) * cos({phi}))"
    m = (
        f"({num(A)} * ({num(1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256)} * {phi} - {num(3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024)} * sin(2 * {phi})"
        f" + {num(15 * E2**2 / 256 + 45 * E2**3 / 1024)} * sin(4 * {phi}) - {num(35 * E2**3 / 3072)} * sin(6 * {phi})))"
    )
    east = f"({num(K0)} * {n} * ({a} + (1 - {t} + {c}) * power({a}, 3) / 6 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - {num(58 * ep)}) * power({a}, 5) / 120) + 500000)"
    inner = f"{a} * {a} / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * power({a}, 4) / 24 + (61 - 58 * {t} + {t} * {t} + 600 * {c} - {num(330 * ep)}) * power({a}, 6) / 720"
    return east, f"({num(K0)} * ({m} + {n} * tan({phi}) * ({inner})) + {0 if north else 10000000})"


def from_utm(x: str, y: str, zone: int, north: bool = True) -> tuple[str, str]:
    """Longitude and latitude by Snyder's series."""
    ep, e1 = E2 / (1 - E2), (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    m = f"(({y} - {0 if north else 10000000}) / {num(K0)})"
    mu = f"({m} / {num(A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))})"
    p = f"({mu} + {num(3 * e1 / 2 - 27 * e1**3 / 32)} * sin(2 * {mu}) + {num(21 * e1**2 / 16 - 55 * e1**4 / 32)} * sin(4 * {mu}) + {num(151 * e1**3 / 96)} * sin(6 * {mu}))"
    s = f"(1 - {num(E2)} * sin({p}) * sin({p}))"
    n, r = f"({num(A)} / sqrt({s}))", f"({num(A * (1 - E2))} / ({s} * sqrt({s})))"
    t, c = f"(tan({p}) * tan({p}))", f"({num(ep)} * cos({p}) * cos({p}))"
    d = f"(({x} - 500000) / ({n} * {num(K0)}))"
    lat = f"degrees({p} - {n} * tan({p}) / {r} * ({d} * {d} / 2 - (5 + 3 * {t} + 10 * {c} - 4 * {c} * {c} - {num(9 * ep)}) * power({d}, 4) / 24 + (61 + 90 * {t} + 298 * {c} + 45 * {t} * {t} - {num(252 * ep)} - 3 * {c} * {c}) * power({d}, 6) / 720))"
    lon = f"({zone * 6 - 183} + degrees(({d} - (1 + 2 * {t} + {c}) * power({d}, 3) / 6 + (5 - 2 * {c} + 28 * {t} - 3 * {c} * {c} + {num(8 * ep)} + 24 * {t} * {t}) * power({d}, 5) / 120) / cos({p})))"
    return lon, lat


def utm_zone(epsg: int) -> tuple[int, bool] | None:
    """Zone and hemisphere of an EPSG code, None if it is no UTM zone."""
    base, zone = divmod(epsg, 100)
    return (zone, base == 326) if base in (326, 327) and 1 <= zone <= 60 else None


def solar_vector(day: str, hour: str, lat: float) -> tuple[str, str, str]:
    """East, north and up parts of the direction of the sun."""
    d = f"({num(math.radians(23.45))} * sin({num(2 * math.pi / 365)} * (284 + {day})))"
    h = f"radians(15 * ({hour} - 12))"
    s, c = num(math.sin(math.radians(lat))), num(math.cos(math.radians(lat)))
    return f"(-cos({d}) * sin({h}))", f"({c} * sin({d}) - {s} * cos({d}) * cos({h}))", f"({s} * sin({d}) + {c} * cos({d}) * cos({h}))"


def surface_normal(slope: str, aspect: str) -> tuple[str, str, str]:
    return f"(sin({slope}) * sin({aspect}))", f"(sin({slope}) * cos({aspect}))", f"cos({slope})"
