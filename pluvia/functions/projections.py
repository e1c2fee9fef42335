"""Conic and polar projections in closed form: Lambert conformal (one or two parallels) and polar stereographic.

Both work on column expressions and know their way back. ``from_mapping`` reads the attributes of a CF grid mapping, ``of`` also
UTM zones and the cylindrical equal-area projection by EPSG code. Spheres are ellipsoids with ``f = 0``. Points that a projection
cannot show (the far pole of a cone) are NULL, and so are points with a NULL coordinate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvia.functions import scalars as S


def _isometric(lat: float, e: float) -> float:
    s = math.sin(math.radians(lat))
    return math.atanh(s) - e * math.atanh(e * s)


def _isometric_column(lat: Column, e: float) -> Column:
    s = F.sin(F.radians(F.when(F.abs(lat) < 90, lat)))
    return F.atanh(s) - e * F.atanh(e * s)


def _latitude(psi: Column, e: float, turns: int = 6) -> Column:
    """Degrees of an isometric latitude; the error shrinks by e^2 with every turn."""
    q = psi
    for _ in range(turns if e else 0):
        q = psi + e * F.atanh(e * F.tanh(q))
    return F.degrees(F.atan(F.sinh(q)))


def _width(lat: float, e: float) -> float:
    """Radius of a parallel for an equator of 1."""
    return math.cos(math.radians(lat)) / math.sqrt(1 - (e * math.sin(math.radians(lat))) ** 2)


def _turned(lon: Column) -> Column:
    """Degrees from -180 up to 180."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


#: EPSG codes of degrees that are taken as they are.
IN_DEGREES = (4326, 4258, 4269)


@dataclass(frozen=True)
class Lambert:
    """Conformal on a cone through the parallels ``lat1`` and ``lat2``; the origin is at (``lon0``, ``lat0``)."""

    lon0: float
    lat0: float
    lat1: float
    lat2: float
    east: float = 0.0
    north: float = 0.0
    a: float = S.WGS84_A
    f: float = S.WGS84_F

    def __post_init__(self) -> None:
        if abs(self.lat1 + self.lat2) < 1e-9 or max(abs(self.lat1), abs(self.lat2)) >= 90 or abs(self.lat0) >= 90:
            raise ValueError("the parallels of a cone lie off the poles and not opposite to each other")

    @property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    def _cone(self) -> tuple[float, float, float]:
        """(share of a turn, metres of the radius at the isometric latitude 0, radius of the origin)."""
        if abs(self.lat1 - self.lat2) < 1e-9:
            n = math.sin(math.radians(self.lat1))
        else:
            n = math.log(_width(self.lat1, self.e) / _width(self.lat2, self.e)) / (_isometric(self.lat2, self.e) - _isometric(self.lat1, self.e))
        k = self.a * _width(self.lat1, self.e) / n * math.exp(n * _isometric(self.lat1, self.e))
        return n, k, k * math.exp(-n * _isometric(self.lat0, self.e))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, k, origin = self._cone()
        radius, angle = k * F.exp(-n * _isometric_column(lat, self.e)), n * F.radians(_turned(lon - self.lon0))
        return self.east + radius * F.sin(angle), self.north + origin - radius * F.cos(angle)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, k, origin = self._cone()
        side = math.copysign(1.0, n)
        u, v = (x - self.east) * side, (origin - (y - self.north)) * side
        radius = F.sqrt(u * u + v * v)
        return _turned(F.degrees(F.atan2(u, v)) / n + self.lon0), _latitude(F.ln(abs(k) / radius) / n, self.e)


@dataclass(frozen=True)
class PolarStereographic:
    """Conformal from a pole, true to scale on ``lat1`` (whose sign names the pole) or, at +-90, by ``scale`` at the pole."""

    lon0: float
    lat1: float
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    a: float = S.WGS84_A
    f: float = S.WGS84_F

    def __post_init__(self) -> None:
        if self.lat1 == 0:
            raise ValueError("a polar projection has its true parallel on one side of the equator")

    @property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    def _metres(self) -> float:
        """Radius of the isometric latitude 0."""
        if abs(self.lat1) == 90:
            e = self.e
            return 2 * self.a * self.scale / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        return self.a * self.scale * _width(self.lat1, self.e) * math.exp(_isometric(abs(self.lat1), self.e))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        side = math.copysign(1.0, self.lat1)
        own = side * lat
        radius = F.when(own == 90, 0.0 * lon).otherwise(self._metres() * F.exp(-_isometric_column(own, self.e)))
        angle = F.radians(lon - self.lon0)
        return self.east + radius * F.sin(angle), self.north - side * radius * F.cos(angle)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        side = math.copysign(1.0, self.lat1)
        u, v = x - self.east, y - self.north
        radius = F.sqrt(u * u + v * v)
        lat = F.when(radius == 0, 90.0).otherwise(_latitude(F.ln(self._metres() / radius), self.e))
        return _turned(F.degrees(F.atan2(u, -side * v)) + self.lon0), side * lat


def from_mapping(attrs: dict) -> Lambert | PolarStereographic:
    """The projection of a CF grid mapping's attributes."""
    number = lambda name, default=None: float(attrs[name]) if name in attrs else default
    a = number("semi_major_axis", number("earth_radius", S.WGS84_A))
    if "inverse_flattening" in attrs:
        f = 1 / number("inverse_flattening") if number("inverse_flattening") else 0.0
    elif "semi_minor_axis" in attrs:
        f = 1 - number("semi_minor_axis") / a
    else:
        f = 0.0 if "earth_radius" in attrs else S.WGS84_F
    shape = {"a": a, "f": f, "east": number("false_easting", 0.0), "north": number("false_northing", 0.0)}
    name = attrs.get("grid_mapping_name")
    if name == "lambert_conformal_conic":
        parallels = attrs["standard_parallel"]
        lat1, lat2 = (float(parallels[0]), float(parallels[-1])) if isinstance(parallels, (list, tuple)) else (float(parallels),) * 2
        return Lambert(number("longitude_of_central_meridian"), number("latitude_of_projection_origin"), lat1, lat2, **shape)
    if name == "polar_stereographic":
        lon0 = number("straight_vertical_longitude_from_pole", number("longitude_of_projection_origin"))
        pole = number("latitude_of_projection_origin", 90.0)
        return PolarStereographic(lon0, number("standard_parallel", pole), number("scale_factor_at_projection_origin", 1.0), **shape)
    raise ValueError(f"no projection for the grid mapping {name}")


def of(crs: int | dict | None):
    """``forward`` of an EPSG code (degrees, 6933, UTM zones) or of a CF grid mapping; without one coordinates stay."""
    if isinstance(crs, dict):
        return from_mapping(crs).forward
    if crs is None or crs in IN_DEGREES:
        return lambda lon, lat: (lon, lat)
    if crs == 6933:
        return S.equal_area
    if 32600 < crs <= 32660 or 32700 < crs <= 32760:
        return lambda lon, lat: S.utm(lon, lat, F.lit(crs))
    raise ValueError(f"no projection for EPSG:{crs}; give the attributes of its grid mapping")
