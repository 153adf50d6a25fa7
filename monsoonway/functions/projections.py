"""Metric space: projections to planes in metres and back, and distances on the ellipsoid WGS 84, as column expressions.

Transverse Mercator is the series in the third flattening to its fourth power, exact to well under a millimetre within a zone. The azimuthal
equidistant plane about a centre and the geodesic distance rest on Vincenty's iteration, which does not come to an end for points nearly opposite each other; these give
null. Angles are degrees, azimuths from north. Null in, null out.
"""

from __future__ import annotations

from math import radians, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Fixed values of the ellipsoid WGS 84 and of UTM.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0
SPHERE_LIMIT = 85.06
_SEMI_MINOR = SEMI_MAJOR * (1 - FLATTENING)
_E2 = FLATTENING * (2 - FLATTENING)
_N = FLATTENING / (2 - FLATTENING)
#: Radius of the rectifying sphere, and the series from and to its latitude in powers of the third flattening (fixed values, to the fourth power).
_RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
ROUNDS, CLOSE = 60, 1e-12
_PLANE = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
_EARTH = StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())])


def utm_zone(lon: Column) -> Column:
    """1 to 60, without the exceptions of Norway and Svalbard."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def utm_epsg(lon: float, lat: float) -> int:
    """The code of the zone that holds a point."""
    return (32700 if lat < 0 else 32600) + int((lon + 180) // 6) % 60 + 1


def utm(lon: Column, lat: Column, zone: Column, south: Column) -> Column:
    """(x, y) in metres in a UTM zone; ``south`` says whether its northings count from the pole's side."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = sqrt(_E2)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    across = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    along = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    return F.struct((FALSE_EASTING + UTM_SCALE * _RECTIFYING * across).alias("x"), (F.when(south, FALSE_NORTHING).otherwise(0.0) + UTM_SCALE * _RECTIFYING * along).alias("y"))


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> Column:
    """(lon, lat) of a place in a UTM zone."""
    xi, eta = (y - F.when(south, FALSE_NORTHING).otherwise(0.0)) / (UTM_SCALE * _RECTIFYING), (x - FALSE_EASTING) / (UTM_SCALE * _RECTIFYING)
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1)), F.lit(0.0))
    return F.struct((zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))).alias("lon"), F.degrees(phi).alias("lat"))


def web_mercator(lon: Column, lat: Column) -> Column:
    """(x, y) of EPSG:3857; latitudes beyond its square are null."""
    fits = F.abs(lat) <= SPHERE_LIMIT
    return F.struct(F.when(fits, F.radians(lon) * SEMI_MAJOR).alias("x"), F.when(fits, F.asinh(F.tan(F.radians(lat))) * SEMI_MAJOR).alias("y"))


def _vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and first azimuth (radians) of the geodesic between points in radians; NaN where the iteration does not settle."""
    u1, u2 = np.arctan((1 - FLATTENING) * np.tan(lat1)), np.arctan((1 - FLATTENING) * np.tan(lat2))
    apart = np.arctan2(np.sin(lon2 - lon1), np.cos(lon2 - lon1))
    lam = apart.copy()
    settled = np.zeros(len(lam), bool)
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(s, c)
            sin_a = np.where(s == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(s == 0, 1.0, s))
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 == 0, 0.0, c - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2 == 0, 1.0, cos2))
            k = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
            new = apart + (1 - k) * FLATTENING * sin_a * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
            settled = np.abs(new - lam) < CLOSE
            lam = new
            if settled.all():
                break
        u = cos2 * (SEMI_MAJOR**2 - _SEMI_MINOR**2) / _SEMI_MINOR**2
        a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        rest = b * s * (mid + b / 4 * (c * (2 * mid**2 - 1) - b / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
        far = np.where(settled & (np.abs(lam) <= np.pi), _SEMI_MINOR * a * (sigma - rest), np.nan)
        turn = np.arctan2(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
    return far, turn


def _walk(lon: float, lat: float, far: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points (radians) reached from one point (radians) along geodesics."""
    u1 = np.arctan((1 - FLATTENING) * np.tan(lat))
    start = np.arctan2(np.tan(u1), np.cos(turn))
    sin_a = np.cos(u1) * np.sin(turn)
    cos2 = 1 - sin_a**2
    u = cos2 * (SEMI_MAJOR**2 - _SEMI_MINOR**2) / _SEMI_MINOR**2
    a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    sigma = far / (_SEMI_MINOR * a)
    for _ in range(ROUNDS):
        mid = np.cos(2 * start + sigma)
        s, c = np.sin(sigma), np.cos(sigma)
        new = far / (_SEMI_MINOR * a) + b * s * (mid + b / 4 * (c * (2 * mid**2 - 1) - b / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
        close = np.abs(new - sigma) < CLOSE
        sigma = new
        if close.all():
            break
    mid, s, c = np.cos(2 * start + sigma), np.sin(sigma), np.cos(sigma)
    lat2 = np.arctan2(np.sin(u1) * c + np.cos(u1) * s * np.cos(turn), (1 - FLATTENING) * np.hypot(sin_a, np.sin(u1) * s - np.cos(u1) * c * np.cos(turn)))
    lam = np.arctan2(s * np.sin(turn), np.cos(u1) * c - np.sin(u1) * s * np.cos(turn))
    k = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
    apart = lam - (1 - k) * FLATTENING * sin_a * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
    return lon + apart, lat2


def geodesic_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points along the ellipsoid."""

    @F.pandas_udf(DoubleType())
    def between(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        far, _ = _vincenty(*(np.radians(x.to_numpy(float)) for x in (a, b, c, d)))
        return pd.Series(far)

    return between(*(x.cast("double") for x in (lon1, lat1, lon2, lat2)))


def equidistant(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """(x, y) in metres on the plane about (lon0, lat0) that keeps distances and directions from there."""

    @F.pandas_udf(_PLANE)
    def plane(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y = np.radians(a.to_numpy(float)), np.radians(b.to_numpy(float))
        far, turn = _vincenty(np.full(len(x), radians(lon0)), np.full(len(x), radians(lat0)), x, y)
        return pd.DataFrame({"x": far * np.sin(turn), "y": far * np.cos(turn)})

    return plane(lon.cast("double"), lat.cast("double"))


def from_equidistant(x: Column, y: Column, lon0: float, lat0: float) -> Column:
    """(lon, lat) of a place on that plane."""

    @F.pandas_udf(_EARTH)
    def earth(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y = a.to_numpy(float), b.to_numpy(float)
        lon, lat = _walk(radians(lon0), radians(lat0), np.hypot(x, y), np.arctan2(x, y))
        turned = (np.degrees(lon) + 180) % 360 - 180
        return pd.DataFrame({"lon": turned, "lat": np.degrees(lat)})

    return earth(x.cast("double"), y.cast("double"))


def centre(bounds: tuple[float, float, float, float]) -> tuple[float, float]:
    """The middle of a box (west, south, east, north): the centre of the local plane of what lies in it."""
    return (bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2
