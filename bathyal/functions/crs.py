"""Transverse Mercator by Krueger's series as column expressions: UTM zones and the like, both ways, to a fraction of a millimetre."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and inverse flattening of the ellipsoids.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101)}


class TransverseMercator:
    def __init__(self, lon0: float, k0: float = 0.9996, x0: float = 500_000.0, y0: float = 0.0, ellipsoid: str = "WGS84"):
        a, inverse = ELLIPSOIDS[ellipsoid]
        f = 1 / inverse
        n = f / (2 - f)
        self.lon0, self.x0, self.y0, self.e = math.radians(lon0), x0, y0, math.sqrt(f * (2 - f))
        self.scale = k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        self.beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Easting and northing of degrees."""
        s, d = F.sin(F.radians(lat)), F.radians(lon) - self.lon0
        t = F.sinh(F.atanh(s) - self.e * F.atanh(self.e * s))
        xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
        x, y = eta, xi
        for j, a in enumerate(self.alpha, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return self.x0 + self.scale * x, self.y0 + self.scale * y

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude in degrees."""
        xi0, eta0 = (y - self.y0) / self.scale, (x - self.x0) / self.scale
        xi, eta = xi0, eta0
        for j, b in enumerate(self.beta, 1):
            xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
            eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
        lon = self.lon0 + F.atan2(F.sinh(eta), F.cos(xi))
        target = F.asinh(F.sin(xi) / F.sqrt(F.sinh(eta) * F.sinh(eta) + F.cos(xi) * F.cos(xi)))
        s = F.tanh(target)
        for _ in range(6):
            s = F.tanh(target + self.e * F.atanh(self.e * s))
        return F.degrees(lon), F.degrees(F.asin(s))


def utm(epsg: int) -> TransverseMercator:
    """EPSG 326xx and 327xx."""
    zone, south = epsg % 100, 32701 <= epsg <= 32760
    if not (south or 32601 <= epsg <= 32660):
        raise ValueError(f"EPSG {epsg} isn't a UTM zone")
    return TransverseMercator(6 * zone - 183, y0=10_000_000.0 if south else 0.0)


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6) + 1))
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("int")


def product_epsg_allowed(epsg: Column) -> Column:
    return epsg.isin(4326, 5041, 5042) | epsg.between(32601, 32660) | epsg.between(32701, 32760)


def transform(x: Column, y: Column, src: int, dst: int) -> tuple[Column, Column]:
    """Between UTM zones and geographic degrees (EPSG 4326, x is longitude)."""
    lon, lat = (x, y) if src == 4326 else utm(src).inverse(x, y)
    return (lon, lat) if dst == 4326 else utm(dst).forward(lon, lat)
