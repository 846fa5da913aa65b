"""Distances, bearings, frames and tiles as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii, WGS84, city window and service window.
EARTH_KM = 6371.0
EARTH_M = 6371000.0
WGS84_A = 6378137.0
WGS84_E2 = 0.00669437999014
MAP_RADIUS_M = 6371008.8
WEB_MERCATOR_C = 40075016.686
CITY_BOUNDS = (120.5, 16.3, 120.7, 16.5)
SERVICE_AREA = (120.4, 16.2, 120.8, 16.6)
CITY_CENTRE = (120.596, 16.4023)
CITY_LAT = 16.4
M_PER_DEG_LNG = 111_320.0
M_PER_DEG_LAT = 110_574.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def once(value: Column, use) -> Column:
    """use(value) with the value worked out once: a column named several times, or in a lambda, is worked out at each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# ------------------------------------------------------------------ rounding


def round_half_up(x, scale: float) -> Column:
    """floor(x * scale + 0.5) / scale: halves go up, also below zero."""
    return F.floor(col(x) * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def round2(x) -> Column:
    return round_half_up(x, 100.0)


def round5(x) -> Column:
    return round_half_up(x, 1e5)


def quarter(x) -> Column:
    """To the nearest 25 centavos."""
    return F.floor(col(x) / F.lit(0.25) + F.lit(0.5)) * F.lit(0.25)


# ---------------------------------------------------------------- great circle


def haversine_km(lng1, lat1, lng2, lat2, radius: float = EARTH_KM) -> Column:
    lng1, lat1, lng2, lat2 = (col(c) for c in (lng1, lat1, lng2, lat2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_m(lng1, lat1, lng2, lat2) -> Column:
    return haversine_km(lng1, lat1, lng2, lat2, EARTH_M)


def bearing_deg(lng1, lat1, lng2, lat2) -> Column:
    """Initial compass bearing, 0 <= b < 360."""
    lng1, lat1, lng2, lat2 = (F.radians(col(c)) for c in (lng1, lat1, lng2, lat2))
    y = F.sin(lng2 - lng1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lng2 - lng1)
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def bearing_diff(a, b) -> Column:
    """Smallest angle between two bearings, 0-180."""
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(360.0))
    return F.when(d > 180, 360 - d).otherwise(d)


def unit_sphere_m(lng, lat, radius: float = EARTH_M) -> list[Column]:
    """Earth-centred x, y, z in metres. Straight-line order equals great-circle order, so a search by
    cubic cells is exact everywhere, with no special case at the poles or the date line."""
    lam, phi = F.radians(col(lng)), F.radians(col(lat))
    return [F.lit(radius) * F.cos(phi) * F.cos(lam), F.lit(radius) * F.cos(phi) * F.sin(lam), F.lit(radius) * F.sin(phi)]


def chord_m(arc_m: float, radius: float = EARTH_M) -> float:
    """Straight-line length of a great-circle arc."""
    return 2 * radius * math.sin(min(arc_m / (2 * radius), math.pi / 2))


# -------------------------------------------------------------------- windows


def between_box(lng, lat, box) -> Column:
    west, south, east, north = box
    return col(lng).between(west, east) & col(lat).between(south, north)


def in_service_area(lng, lat) -> Column:
    return between_box(lng, lat, SERVICE_AREA)


# ------------------------------------------------------------------ slippy map


def asinh(x) -> Column:
    return F.asinh(col(x))


def tile_x(lng, z) -> Column:
    return F.floor((col(lng) + 180.0) / 360.0 * F.pow(F.lit(2.0), col(z))).cast("long")


def tile_y(lat, z) -> Column:
    return F.floor((F.lit(1.0) - F.asinh(F.tan(F.radians(col(lat)))) / F.lit(math.pi)) / 2.0 * F.pow(F.lit(2.0), col(z))).cast("long")


def tile_west(x, z) -> Column:
    return col(x) / F.pow(F.lit(2.0), col(z)) * 360.0 - 180.0


def tile_north(y, z) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * col(y) / F.pow(F.lit(2.0), col(z))))))


def pixel_xy(lng, lat, z: int) -> tuple[Column, Column]:
    """Position in 256-pixel tiles at zoom z, as real numbers."""
    n = float(2**z * 256)
    u = (col(lng) + 180.0) / 360.0 * F.lit(n)
    v = (F.lit(1.0) - F.asinh(F.tan(F.radians(col(lat)))) / F.lit(math.pi)) / 2.0 * F.lit(n)
    return u, v


# -------------------------------------------------------------- planar frames


def planar_scale(lat0: float = CITY_LAT) -> float:
    return WEB_MERCATOR_C * math.cos(math.radians(lat0))


def planar_xy(lng, lat, lat0: float = CITY_LAT) -> tuple[Column, Column]:
    """Web Mercator scaled to true metres at lat0, north up."""
    k = planar_scale(lat0)
    x = (col(lng) + 180.0) / 360.0 * F.lit(k)
    y = F.asinh(F.tan(F.radians(col(lat)))) / F.lit(2 * math.pi) * F.lit(k)
    return x, y


def planar_lnglat(x, y, lat0: float = CITY_LAT) -> tuple[Column, Column]:
    k = planar_scale(lat0)
    return col(x) / F.lit(k) * 360.0 - 180.0, F.degrees(F.atan(F.sinh(col(y) / F.lit(k) * F.lit(2 * math.pi))))


def frame_scale(lat_deg) -> tuple[Column, Column]:
    """East and north factors from WGS84 metres to mean-radius metres at a latitude."""
    w = 1 - F.lit(WGS84_E2) * F.pow(F.sin(F.radians(col(lat_deg))), F.lit(2.0))
    east = F.lit(MAP_RADIUS_M) / (F.lit(WGS84_A) / F.sqrt(w))
    north = F.lit(MAP_RADIUS_M) / (F.lit(WGS84_A * (1 - WGS84_E2)) / F.pow(w, F.lit(1.5)))
    return east, north


# ------------------------------------------- local transverse Mercator (WGS84)
# Krueger's series to the fourth power of the third flattening; below a micrometre
# over a city.

_F = 1 / 298.257223563
_N = _F / (2 - _F)
TM_RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
TM_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
TM_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
TM_DELTA = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]
TM_ECC = 2 * math.sqrt(_N) / (1 + _N)


def tm_northing_of_origin(lat0: float) -> float:
    """Northing of the frame's origin on its central meridian."""
    s = math.sin(math.radians(lat0))
    t = math.sinh(math.atanh(s) - TM_ECC * math.atanh(TM_ECC * s))
    xi = math.atan(t)
    return TM_RECTIFYING * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(TM_ALPHA)))


def tm_forward(lng, lat, centre=CITY_CENTRE) -> tuple[Column, Column]:
    """Local metres (east, north) of a transverse Mercator centred on `centre`."""
    lng0, lat0 = centre
    s = F.sin(F.radians(col(lat)))
    t = F.sinh(F.atanh(s) - F.lit(TM_ECC) * F.atanh(F.lit(TM_ECC) * s))
    dl = F.radians(col(lng) - F.lit(lng0))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, a in enumerate(TM_ALPHA, start=1):
        e = e + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        n = n + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    return F.lit(TM_RECTIFYING) * e, F.lit(TM_RECTIFYING) * n - F.lit(tm_northing_of_origin(lat0))


def tm_inverse(e, n, centre=CITY_CENTRE) -> tuple[Column, Column]:
    lng0, lat0 = centre
    xi = (col(n) + F.lit(tm_northing_of_origin(lat0))) / F.lit(TM_RECTIFYING)
    eta = col(e) / F.lit(TM_RECTIFYING)
    xi1, eta1 = xi, eta
    for j, b in enumerate(TM_BETA, start=1):
        xi1 = xi1 - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        eta1 = eta1 - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(TM_DELTA, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    return F.lit(lng0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


# ------------------------------------------------------------ segment geometry


def segment_param(px, py, ax, ay, bx, by) -> Column:
    """Where the foot of the perpendicular from p falls on a-b, clamped to 0-1."""
    px, py, ax, ay, bx, by = (col(c) for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / len2
    return F.when(len2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay, bx, by = (col(c) for c in (px, py, ax, ay, bx, by))
    t = segment_param(px, py, ax, ay, bx, by)
    ex, ey = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return F.sqrt(ex * ex + ey * ey)


def signed_offset(px, py, ax, ay, bx, by) -> Column:
    """Offset of p from the line a-b, left of its direction positive."""
    px, py, ax, ay, bx, by = (col(c) for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    return (dx * (py - ay) - dy * (px - ax)) / F.sqrt(dx * dx + dy * dy)


def quantise(geom, depth: int) -> Column:
    """Coordinates of nested [lng, lat] arrays to 5 decimals; depth 0 is one position."""
    g = col(geom)
    if depth == 0:
        return F.transform(g, lambda v: round5(v))
    return F.transform(g, lambda part: quantise(part, depth - 1))
