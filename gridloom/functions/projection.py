"""Geographic coordinates (WGS 84) to and from UTM, as column expressions or arrays, by Krueger's series to the third order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: the ellipsoid's half axis and flattening, the scale on the central meridian, false easting and northing
A, FLATTENING, SCALE, EASTING, NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_BACK = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
_LATITUDE = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)
_E = 2 * _N**0.5 / (1 + _N)


def utm_zone(lon: Column) -> Column:
    """The zone of a longitude, 1 to 60."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def to_utm(lon, lat, zone: int, south: bool = False, m=F):
    """x and y (metres) of degrees, in a given zone. m: Spark's functions (columns), or numpy (arrays)."""
    phi, away = m.radians(lat), m.radians(lon - (6 * zone - 183))
    t = m.sinh(m.atanh(m.sin(phi)) - _E * m.atanh(m.sin(phi) * _E))
    xi, eta = m.atan2(t, m.cos(away)), m.atanh(m.sin(away) / m.sqrt(1 + t * t))
    x = eta + sum(m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * a for j, a in enumerate(_FORWARD, 1))
    y = xi + sum(m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * a for j, a in enumerate(_FORWARD, 1))
    return x * (SCALE * _RADIUS) + EASTING, y * (SCALE * _RADIUS) + (NORTHING if south else 0.0)


def from_utm(x, y, zone: int, south: bool = False, m=F):
    """Longitude and latitude (degrees) of x and y in a zone."""
    xi, eta = (y - (NORTHING if south else 0.0)) / (SCALE * _RADIUS), (x - EASTING) / (SCALE * _RADIUS)
    up = xi - sum(m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b for j, b in enumerate(_BACK, 1))
    across = eta - sum(m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b for j, b in enumerate(_BACK, 1))
    chi = m.asin(m.sin(up) / m.cosh(across))
    phi = chi + sum(m.sin(chi * (2 * j)) * d for j, d in enumerate(_LATITUDE, 1))
    return m.degrees(m.atan2(m.sinh(across), m.cos(up))) + (6 * zone - 183), m.degrees(phi)


def utm_of(epsg: int) -> tuple[int, bool] | None:
    """Zone and whether south of the equator, of an EPSG code of UTM on WGS 84; None: geographic coordinates (4326)."""
    if epsg == 4326:
        return None
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"EPSG:{epsg} is neither WGS 84 nor one of its UTM zones")
    return epsg % 100, epsg // 100 == 327


def to_degrees(x, y, epsg: int, m=F):
    utm = utm_of(epsg)
    return from_utm(x, y, *utm, m) if utm else (x, y)


def from_degrees(lon, lat, epsg: int, m=F):
    utm = utm_of(epsg)
    return to_utm(lon, lat, *utm, m) if utm else (lon, lat)
