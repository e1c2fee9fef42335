"""Scalar column functions of the runoff engine. NULL is the missing value; NaN and infinities become NULL at the boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere in m; seconds from 1900-01-01 to 1970-01-01; the eight ESRI codes with (row, column) steps,
#: in the order in which equal slopes are decided.
EARTH_M = 6371000.0
#: Fixed values of the WGS84 ellipsoid: semi-major axis, flattening; scale and false easting of UTM; standard parallel of EPSG:6933.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500000.0, 10000000.0
EQUAL_AREA_PARALLEL = 30.0
_E2 = WGS84_F * (2 - WGS84_F)
_E = _E2**0.5
EPOCH_1900_S = 2208988800
D8 = ((1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1))
#: The clockwise encoding: 0 is east, then clockwise.
CLOCKWISE = tuple((k, dr, dc) for k, (_, dr, dc) in enumerate(D8))
ENCODINGS = {"esri": D8, "cw0_7": CLOCKWISE, "clockwise0_7": CLOCKWISE, "0_7": CLOCKWISE}


def finite(x: Column) -> Column:
    """``x`` as double; NULL for NaN and infinities."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def rain_to_step_mm(x: Column, mode: str, dt_s: float) -> Column:
    """Rain of one step in mm. Missing and negative values are 0."""
    mm = F.greatest(F.coalesce(finite(x), F.lit(0.0)), F.lit(0.0))
    if mode == "intensity_mmph":
        return mm * dt_s / 3600.0
    if mode == "depth_mm_per_step":
        return mm
    raise ValueError(f"unknown rain mode {mode!r}")


def storage_mm(cn: Column) -> Column:
    """Potential retention S; NULL for curve numbers outside (0, 100]."""
    return F.when((cn > 0) & (cn <= 100), 25400.0 / cn - 254.0)


def scs_runoff_mm(p: Column, cn: Column, ia_ratio: float = 0.2, compat: str = "documented") -> Column:
    """Cumulative runoff of cumulative rain ``p``; 0 where the curve number is not valid.

    ``documented``: (P-Ia)^2/(P-Ia+S). ``as_coded``: that formula's result goes through Q^2/(Q+S) once more, and S=0 gives 0.
    """
    s = storage_mm(cn)
    over = p - ia_ratio * s
    q = F.when(over > 0, F.when(s == 0, p).otherwise(over * over / (over + s))).otherwise(0.0)
    if compat == "as_coded":
        q = F.when(s > 0, F.when(q > 0, q * q / (q + s)).otherwise(0.0)).otherwise(0.0)
    return F.coalesce(q, F.lit(0.0))


def sphere_cell_area(y: Column, dx_deg: float, dy_deg: float) -> Column:
    """Area of a cell from latitude ``y`` down to ``y - dy``, ``dx`` wide, on the sphere."""
    return F.abs(EARTH_M * EARTH_M * F.radians(F.lit(dx_deg)) * (F.sin(F.radians(y)) - F.sin(F.radians(y - dy_deg))))


def _authalic_q(lat: Column) -> Column:
    """Twice the area of a zone of the ellipsoid from the equator to ``lat``, for a radian of longitude and a = 1."""
    s = F.sin(F.radians(lat))
    return (1 - _E2) * (s / (1 - _E2 * s * s) - F.ln((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def ellipsoid_cell_area(y: Column, dx_deg: float, dy_deg: float) -> Column:
    """Area of a cell from latitude ``y`` down to ``y - dy``, ``dx`` wide, on the WGS84 ellipsoid."""
    return WGS84_A * WGS84_A / 2 * F.abs(F.radians(F.lit(dx_deg)) * (_authalic_q(y) - _authalic_q(y - dy_deg)))


def projected_cell_area(dx_m: float, dy_m: float) -> float:
    """Area of a cell of a grid in metres."""
    return abs(dx_m * dy_m)


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres of the cylindrical equal-area projection EPSG:6933."""
    import math

    s = math.sin(math.radians(EQUAL_AREA_PARALLEL))
    k = math.cos(math.radians(EQUAL_AREA_PARALLEL)) / math.sqrt(1 - _E2 * s * s)
    return WGS84_A * k * F.radians(lon), WGS84_A / (2 * k) * _authalic_q(lat)


def _kruger() -> tuple[float, list[float], list[float]]:
    """(rectifying radius, forward and inverse coefficients) of the transverse Mercator series to the fourth power of n."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, forward, inverse


def utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """(x, y) in metres of WGS84 coordinates in the UTM zone ``epsg`` (326zz north, 327zz south)."""
    radius, forward, _ = _kruger()
    zone = epsg % 100
    dl = F.radians(lon - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, c in enumerate(forward, 1):
        x = x + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return UTM_EAST + UTM_SCALE * radius * x, F.when(epsg < 32700, 0.0).otherwise(UTM_SOUTH) + UTM_SCALE * radius * y


def from_utm(x: Column, y: Column, epsg: Column, turns: int = 5) -> tuple[Column, Column]:
    """(lon, lat) in degrees of UTM coordinates; the latitude is iterated ``turns`` times."""
    radius, _, inverse = _kruger()
    xi = (y - F.when(epsg < 32700, 0.0).otherwise(UTM_SOUTH)) / (UTM_SCALE * radius)
    eta = (x - UTM_EAST) / (UTM_SCALE * radius)
    a, b = xi, eta
    for k, c in enumerate(inverse, 1):
        a = a - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        b = b - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    conformal = F.asinh(F.sin(a) / F.sqrt(F.sinh(b) * F.sinh(b) + F.cos(a) * F.cos(a)))
    q = conformal
    for _ in range(turns):
        q = conformal + _E * F.atanh(_E * F.tanh(q))
    return F.degrees(F.atan2(F.sinh(b), F.cos(a))) + (epsg % 100 * 6 - 183), F.degrees(F.atan(F.sinh(q)))


def hop_distance_m(area: Column, d8: Column) -> Column:
    """Way to the next cell: a side, or a diagonal for the diagonal codes; 0 for invalid codes."""
    return F.when(d8.isin(1, 4, 16, 64), F.sqrt(area)).when(d8.isin(2, 8, 32, 128), F.sqrt(area) * F.sqrt(F.lit(2.0))).otherwise(0.0)


def auto_travel_s(distance: Column, speed: float, least_s: float, most_s: float) -> Column:
    if speed <= 0:
        raise ValueError("speed must be positive")
    return F.least(F.greatest(distance / speed, F.lit(least_s)), F.lit(most_s))


def depth_from_volume(volume: Column, area: Column, active: Column) -> Column:
    """Metres of water; area 0 gives 0, inactive cells NULL."""
    return F.when(active, F.when(area > 0, F.coalesce(volume, F.lit(0.0)) / area).otherwise(0.0))


def inundated(depth: Column, active: Column, least_m: float = 0.01) -> Column:
    return F.when(active & (depth >= least_m), 1).otherwise(0).cast("byte")


def risk_blend(runoff: Column, upstream: Column, balance: float) -> Column:
    a = min(1.0, max(0.0, balance))
    return a * runoff + (1 - a) * runoff * upstream


def risk_class(v: Column, thresholds: tuple[float, float, float] | None = None, compat: str = "documented") -> Column:
    """R1 to R4, NULL for missing values.

    With thresholds: the first that is not exceeded. Without: quarters of 0..1, class numbers above. ``as_coded`` tests
    0.5..4.5 first, so that most values of 0..1 round to class 1; 0.5 rounds to even, 0, and falls back to quarters.
    """
    quarters = F.when(v <= 0.25, "R1").when(v <= 0.5, "R2").when(v <= 0.75, "R3").otherwise("R4")
    if thresholds:
        a, b, c = thresholds
        return F.when(v.isNotNull(), F.when(v <= a, "R1").when(v <= b, "R2").when(v <= c, "R3").otherwise("R4"))
    number = F.concat(F.lit("R"), F.rint(v).cast("int").cast("string"))
    if compat == "as_coded":
        return F.when((v >= 0.5) & (v <= 4.5) & F.rint(v).between(1, 4), number).when(v.between(0, 1), quarters)
    return F.when(v.between(0, 1), quarters).when((v > 1) & (v <= 4.5), number)


def dbz_to_rain(dbz: Column, a: float = 200.0, b: float = 1.6, least: float | None = None, most: float | None = None, nodata: float | None = None) -> Column:
    """Rain rate of a reflectivity by Z = a R^b; values outside ``least``..``most`` and no-data are NULL, not clipped."""
    x = finite(dbz)
    ok = x.isNotNull()
    for test in ((x != nodata) if nodata is not None else None, (x >= least) if least is not None else None, (x <= most) if most is not None else None):
        ok = ok if test is None else ok & test
    return F.when(ok, F.pow(F.pow(F.lit(10.0), x / 10.0) / a, F.lit(1.0 / b)))


def accumulation_rate(acc: Column, hours: float, fill: float | None = None) -> Column:
    x = finite(acc)
    return (F.when(x != fill, x) if fill is not None else x) / hours


def cf_hours(t: Column) -> Column:
    """Hours since 1900-01-01 UTC."""
    return (F.unix_micros(t.cast("timestamp")) / 1000000.0 + EPOCH_1900_S) / 3600.0


def from_cf_hours(h: Column) -> Column:
    return F.timestamp_micros(F.round((h * 3600.0 - EPOCH_1900_S) * 1000000.0).cast("long"))


def iso_timestamp(s: Column) -> Column:
    """ISO-8601 text; without a zone it is UTC, whatever the session's zone is. NULL where it is no time."""
    t = F.regexp_replace(F.trim(s), "[Zz]$", "+00:00")
    zoned = t.rlike(r"[0-9]{1,2}:[0-9]{2}(:[0-9.]+)?\s*[+-][0-9]{2}:?[0-9]{0,2}$")
    return F.try_to_timestamp(F.when(zoned, t).otherwise(F.concat(F.when(t.rlike("[0-9]:[0-9]"), t).otherwise(F.concat(t, F.lit(" 00:00:00"))), F.lit("+00:00"))))


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def cos_lat(y: Column) -> Column:
    return F.cos(F.radians(y))


def slug(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, "[^A-Za-z0-9]+", "-"), F.lit("-")))


def first_filled(properties: Column, names: list[str]) -> Column:
    """First of the named properties that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(properties, F.lit(n))), F.lit("")) for n in names))


def basic_auth(user: Column, password: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.concat_ws(":", user, password).cast("binary")))


def depth_from_runoff(q_mm: Column, active: Column) -> Column:
    """Metres of water of cumulative runoff in mm where nothing flows; inactive cells NULL."""
    return F.when(active, F.coalesce(q_mm, F.lit(0.0)) / 1000.0)


def cf_units(text: str) -> tuple[float, int]:
    """(seconds of a unit, Unix seconds of the origin) of CF time units such as ``hours since 1900-01-01 00:00:0.0``."""
    import re
    from datetime import datetime, timezone

    m = re.fullmatch(r"(second|minute|hour|day)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+)(?:\.(\d*))?)?)?\s*(?:Z|UTC)?", text.strip(), re.IGNORECASE)
    if not m:
        raise ValueError(f"time units {text!r} are not understood")
    unit = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}[m[1].lower()]
    return unit, int(datetime(*(int(m[k] or 0) for k in range(2, 8)), tzinfo=timezone.utc).timestamp())


def from_cf(t: Column, units: str) -> Column:
    unit, origin = cf_units(units)
    return F.timestamp_micros(F.round((t * unit + origin) * 1000000.0).cast("long"))


def headers(text: Column, user: Column, password: Column, token: Column, more: Column | None = None) -> Column:
    """Request headers as a map: JSON text, overridden by ``more``; a bearer token, then basic credentials, which win."""
    none = F.create_map().cast("map<string,string>")
    pair = lambda name, value: F.when(value.isNotNull(), F.create_map(F.lit(name), value)).otherwise(none)
    base = F.coalesce(F.from_json(text, "map<string,string>"), none)
    parts = [base, *([F.coalesce(more, none)] if more is not None else []), pair("Authorization", F.concat(F.lit("Bearer "), F.nullif(token, F.lit("")))), pair("Authorization", F.when((F.length(user) > 0) & (F.length(password) > 0), basic_auth(user, password)))]

    def over(a: Column, b: Column) -> Column:  # the later one wins
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    out = parts[0]
    for p in parts[1:]:
        out = over(out, p)
    return out


def feature_name(properties: Column, own_id: Column) -> Column:
    return F.coalesce(first_filled(properties, ["name", "feature_name", "id"]), F.nullif(F.trim(own_id), F.lit("")), F.lit("unknown-feature"))


def rotated_path(path: str, number: int) -> str:
    """``a/b.nc`` of rotation 3 is ``a/b_0003.nc``."""
    stem, dot, end = path.rpartition(".")
    return f"{stem}_{number:04d}.{end}" if dot and "/" not in end else f"{path}_{number:04d}"


def tagged_path(path: str, tag: str) -> str:
    """``a/b.nc`` of domain "Campi Flegrei" is ``a/b_campi-flegrei.nc``."""
    import re

    label = re.sub("[^A-Za-z0-9]+", "-", tag).strip("-").lower()
    stem, dot, end = path.rpartition(".")
    return (f"{stem}_{label}.{end}" if dot and "/" not in end else f"{path}_{label}") if label else path


def display_time(t: Column) -> Column:
    return F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def title(name: str, units: str | None, when: str | None = None) -> str:
    head = name.replace("_", " ").strip().capitalize() + (f" [{units}]" if units and units != "1" else "")
    return f"{head} - {when}" if when else head


#: Names and attributes of the axes and of the results, as CF has them.
CONVENTIONS = "CF-1.10"
TIME_UNITS = "hours since 1900-01-01 00:00:0.0"
RATE_UNITS = "mm h-1"
_AXES = {"lat": {"description": "Latitude", "long_name": "latitude", "units": "degrees_north"}, "lon": {"description": "Longitude", "long_name": "longitude", "units": "degrees_east"}}


def axis_attributes(name: str) -> dict[str, str]:
    return next((dict(a) for k, a in _AXES.items() if k in name.lower()), {})


def crs_attributes(attrs: dict | None) -> dict:
    """Attributes of a grid mapping with its name and EPSG code filled in."""
    return {"grid_mapping_name": "unknown", "epsg_code": "EPSG:0000"} | (attrs or {})


def fill_of(attrs: dict, default=None):
    return attrs.get("_FillValue", attrs.get("missing_value", default))


def history(what: str, when=None) -> str:
    from datetime import datetime, timezone

    return f"{(when or datetime.now(timezone.utc)).strftime('%Y-%m-%dT%H:%M:%SZ')}: {what}"
