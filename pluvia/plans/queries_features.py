"""Queries of features, maps, projections, times, texts and streams, with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions import projections
from pluvia.functions import scalars as S
from pluvia.operators import alerts as A
from pluvia.operators import geometry as Y
from pluvia.operators import grid as G
from pluvia.operators import products as P
from pluvia.plans import fixtures as X
from pluvia.plans import queries as Q
from pluvia.plans.queries import query, rnd
from pluvia.streaming import stations as W

# --- features ------------------------------------------------------------------------------------------------------------


def _text(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _ring(*points) -> list:
    out = []
    for k, (x, y) in enumerate([*points, points[0]]):
        out += ["," if k else "", "[", x, ",", y, "]"]
    return ["[", *out, "]"]


def _box(x, y, w, h) -> list:
    return _ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def _suppliers(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return X.read(spark, d, "supplier").select(k.alias("feature_id"), (k % 30 + 0.3).alias("fx"), ((k * 7) % 45 + 0.3).alias("fy"), (k % 6 + 1).cast("double").alias("w"), (k % 4 + 1).cast("double").alias("h"))


_S = "sup AS (SELECT s_suppkey AS feature_id, s_suppkey % 30 + 0.3::DOUBLE AS fx, (s_suppkey * 7) % 45 + 0.3::DOUBLE AS fy, CAST(s_suppkey % 6 + 1 AS DOUBLE) AS w, CAST(s_suppkey % 4 + 1 AS DOUBLE) AS h FROM supplier)"
_BASE = f"WITH {X.GRID}, {Q._VALUES}, {_S}"


def _holed(spark, d) -> DataFrame:
    """Two polygons to a feature, the first with a hole."""
    x, y = F.col("fx"), F.col("fy")
    g = _text('{"type":"MultiPolygon","coordinates":[[', *_box(x, y, 6, 5), ",", *_box(x + 1.5, y + 1.5, 2, 2), "],[", *_box(x + 8, y, 2, 2), "]]}")
    return Y.shapes(_suppliers(spark, d).select("feature_id", g.alias("geometry"), F.lit("MultiPolygon").alias("geom_type")))


@query(f"""{_BASE}, p AS (SELECT feature_id, depth_m, risk, cos(radians(y)) AS w FROM sup s JOIN vals v ON x BETWEEN fx AND fx + 10 AND y BETWEEN fy AND fy + 5
  WHERE (x < fx + 6 AND NOT (x BETWEEN fx + 1.5 AND fx + 3.5 AND y BETWEEN fy + 1.5 AND fy + 3.5)) OR (x > fx + 8 AND y < fy + 2)) SELECT feature_id, {Q._STATS} FROM p GROUP BY feature_id""")
def zonal_multipolygon(spark, d):
    return Q._rounded(Y.zonal(_holed(spark, d), Q._values(spark, d), 1.0, 1.0, 4.0, 0.5))


def _triangles(spark, d) -> DataFrame:
    x, y, w, h = (F.col(c) for c in ("fx", "fy", "w", "h"))
    g = _text('{"type":"Polygon","coordinates":[', *_ring((x, y), (x, y + h), (x + w, y)), "]}")
    return Y.shapes(_suppliers(spark, d).select("feature_id", g.alias("geometry"), F.lit("Polygon").alias("geom_type")))


#: Area of a right triangle in a cell: the integral of its height above two levels, in closed form.
_OVER = lambda x, m: f"greatest(fy + h * (1 - ({x} - fx) / w) - ({m}), 0)"
_LEFT, _RIGHT, _LOW, _TOP = "greatest(x - 0.5, fx)", "least(x + 0.5, fx + w)", "greatest(y - 0.5, fy)", "(y + 0.5)"
_PART = f"(w / (2 * h) * (pow({_OVER(_LEFT, _LOW)}, 2) - pow({_OVER(_RIGHT, _LOW)}, 2) - pow({_OVER(_LEFT, _TOP)}, 2) + pow({_OVER(_RIGHT, _TOP)}, 2)))"


@query(f"""{_BASE}, q AS (SELECT feature_id, depth_m, risk, {_PART} AS w FROM sup JOIN vals ON x + 0.5 > fx AND x - 0.5 < fx + w AND y + 0.5 > fy AND y - 0.5 < fy + h)
SELECT feature_id, {Q._STATS} FROM q WHERE w > 1e-9 GROUP BY feature_id""")
def zonal_exact_overlap(spark, d):
    p = Y.weighted_cells(_triangles(spark, d), Q._values(spark, d), 1.0, 1.0, 4.0, "exact").where("w > 1e-9")
    return Q._rounded(Q.Z.stats(p, "feature_id", F.col("w"), "depth_m", "risk", 0.5))


@query(f"""{_BASE}, q AS (SELECT feature_id, risk, {_PART} AS a, cos(radians(y)) AS c FROM sup JOIN vals ON x + 0.5 > fx AND x - 0.5 < fx + w AND y + 0.5 > fy AND y - 0.5 < fy + h WHERE risk IS NOT NULL)
SELECT feature_id, round(sum(c * risk) / sum(c), 6) AS risk_mean, round(max(risk), 6) AS risk_max FROM q WHERE a > 1e-9 GROUP BY feature_id""")
def zonal_single_touched(spark, d):
    s = Y.zonal_single(_triangles(spark, d), Q._values(spark, d), 1.0, 1.0, 4.0, "risk", "touched")
    return s.select("feature_id", rnd("risk_mean"), rnd("risk_max"))


_SEGMENT = lambda ax, ay, bx, by: f"sqrt(pow(x - ({ax}) - greatest(least(((x - ({ax})) * ({bx} - ({ax})) + (y - ({ay})) * ({by} - ({ay}))) / (pow({bx} - ({ax}), 2) + pow({by} - ({ay}), 2)), 1), 0) * ({bx} - ({ax})), 2) + pow(y - ({ay}) - greatest(least(((x - ({ax})) * ({bx} - ({ax})) + (y - ({ay})) * ({by} - ({ay}))) / (pow({bx} - ({ax}), 2) + pow({by} - ({ay}), 2)), 1), 0) * ({by} - ({ay})), 2))"


@query(f"""{_BASE}, q AS (SELECT feature_id, depth_m, risk, cos(radians(y)) AS w FROM sup JOIN vals ON least({_SEGMENT('fx', 'fy', 'fx + w', 'fy + h')}, {_SEGMENT('fx + w', 'fy + h', 'fx + w', 'fy + h + 2')}) <= 1.25)
SELECT feature_id, {Q._STATS} FROM q GROUP BY feature_id""")
def zonal_line_buffer(spark, d):
    x, y, w, h = (F.col(c) for c in ("fx", "fy", "w", "h"))
    g = _text('{"type":"LineString","coordinates":[[', x, ",", y, "],[", x + w, ",", y + h, "],[", x + w, ",", y + h + 2, "]]}")
    s = Y.shapes(_suppliers(spark, d).select("feature_id", g.alias("geometry"), F.lit("LineString").alias("geom_type")))
    return Q._rounded(Y.zonal(s, Q._values(spark, d), 1.0, 1.0, 4.0, 0.5, buffer=1.25))


_MIXED = "CASE feature_id % 5 WHEN 0 THEN 'area' WHEN 1 THEN 'line_centroid' WHEN 2 THEN 'point' WHEN 3 THEN 'centroid' END"


@query(f"""{_BASE}, m AS (SELECT feature_id, fx, fy, w, h, {_MIXED} AS mode, CASE feature_id % 5 WHEN 1 THEN fx + w / 2 WHEN 2 THEN fx WHEN 3 THEN fx + 1 END AS px, CASE feature_id % 5 WHEN 1 THEN fy + h / 2 WHEN 2 THEN fy WHEN 3 THEN fy + 1 END AS py FROM sup),
a AS (SELECT feature_id, count(*) FILTER (WHERE depth_m IS NOT NULL AND risk IS NOT NULL) AS n, max(depth_m) FILTER (WHERE risk IS NOT NULL) AS depth_max, max(risk) FILTER (WHERE depth_m IS NOT NULL) AS risk_max FROM m JOIN vals ON x BETWEEN fx AND fx + w AND y BETWEEN fy AND fy + h WHERE mode = 'area' GROUP BY feature_id),
s AS (SELECT feature_id, CASE WHEN depth_m IS NOT NULL AND risk IS NOT NULL THEN 1 ELSE 0 END AS n, depth_m AS depth_max, risk AS risk_max FROM m LEFT JOIN vals ON c = least(greatest(ceil(px - 0.5), 0), 39) AND r = least(greatest(ceil(py - 0.5), 0), (SELECT max(r) FROM grid)) WHERE mode <> 'area'),
u AS (SELECT * FROM a UNION ALL SELECT * FROM s)
SELECT m.feature_id, mode, n::BIGINT AS n, round(depth_max, 6) AS depth_max, round(risk_max, 6) AS risk_max, CASE WHEN risk_max <= 0.25 THEN 'R1' WHEN risk_max <= 0.5 THEN 'R2' WHEN risk_max <= 0.75 THEN 'R3' WHEN risk_max <= 1 THEN 'R4' WHEN risk_max <= 4.5 THEN 'R' || CAST(round_even(risk_max, 0) AS INTEGER) END AS risk_class FROM m LEFT JOIN u USING (feature_id)""")
def feature_dispatch(spark, d):
    x, y, w, h = (F.col(c) for c in ("fx", "fy", "w", "h"))
    point = lambda a, b: _text("[", a, ",", b, "]")
    kinds = {
        0: ("Polygon", _text('{"type":"Polygon","coordinates":[', *_box(x, y, w, h), "]}")),
        1: ("LineString", _text('{"type":"LineString","coordinates":[', point(x, y), ",", point(x + w, y + h), "]}")),
        2: ("Point", _text('{"type":"Point","coordinates":', point(x, y), "}")),
        3: ("MultiPoint", _text('{"type":"MultiPoint","coordinates":[', point(x, y), ",", point(x + 2, y + 2), "]}")),
    }
    geometry, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, text) in kinds.items():
        at = F.col("feature_id") % 5 == k
        geometry, kind = F.when(at, text).otherwise(geometry), F.when(at, F.lit(name)).otherwise(kind)
    f = _suppliers(spark, d).select("feature_id", geometry.alias("geometry"), kind.alias("geom_type"))
    e = Y.enriched(f, Q._values(spark, d), (0.0, 1.0, X.NCOL, 0.0, 1.0, X.rows(spark, d)), 4.0, 0.5, class_by="max")
    return e.select("feature_id", "mode", "n", rnd("depth_max"), rnd("risk_max"), "risk_class")


@query("SELECT count(*) AS features, count(*) FILTER (WHERE s_suppkey % 5 <> 4) AS updated, count(*) FILTER (WHERE s_suppkey % 5 = 4) AS skipped FROM supplier")
def feature_counts(spark, d):
    e = _suppliers(spark, d).select("feature_id", F.when(F.col("feature_id") % 5 != 4, "area").alias("mode"))
    return Y.update_counts(e)


@query(f"WITH {X.GRID} SELECT cell_id, round(x - 0.005, 6) AS west, round(y - 0.005, 6) AS south, round(x + 0.005, 6) AS east, round(y + 0.005, 6) AS north FROM grid WHERE active")
def cell_polygons(spark, d):
    g = Y.cell_boxes(X.grid(spark, d).where("active"), X.DX, X.DY)
    return g.select("cell_id", *(rnd(c) for c in ("west", "south", "east", "north")))


# --- projections ---------------------------------------------------------------------------------------------------------

_LL = "ll AS (SELECT c_custkey AS id, (c_custkey * 11 % 720) / 2.0::DOUBLE - 180 + 0.13::DOUBLE AS lon, (c_custkey * 7 % 320) / 2.0::DOUBLE - 80 + 0.07::DOUBLE AS lat FROM customer)"


def _lonlat(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return X.read(spark, d, "customer").select(k.alias("id"), (k * 11 % 720 / 2.0 - 180 + 0.13).alias("lon"), (k * 7 % 320 / 2.0 - 80 + 0.07).alias("lat"))


def _utm_sql() -> str:
    radius, forward, _ = S._kruger()
    x = " + ".join(["eta", *(f"{c!r}::DOUBLE * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, c in enumerate(forward, 1))])
    y = " + ".join(["xi", *(f"{c!r}::DOUBLE * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, c in enumerate(forward, 1))])
    return f"""WITH {_LL}, z AS (SELECT *, least(greatest(CAST(floor((lon + 180) / 6) AS INTEGER) + 1, 1), 60) AS zone FROM ll),
t AS (SELECT *, radians(lon - (zone * 6 - 183)) AS dl, sinh(atanh(sin(radians(lat))) - {S._E!r}::DOUBLE * atanh({S._E!r}::DOUBLE * sin(radians(lat)))) AS t FROM z),
u AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t)
SELECT id, round(500000 + 0.9996::DOUBLE * {radius!r}::DOUBLE * ({x}), 3) AS x, round(CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END + 0.9996::DOUBLE * {radius!r}::DOUBLE * ({y}), 3) AS y FROM u"""


@query(_utm_sql())
def utm_projection(spark, d):
    x, y = S.utm(F.col("lon"), F.col("lat"), S.utm_epsg(F.col("lon"), F.col("lat")))
    return _lonlat(spark, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"WITH {_LL} SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ll")
def utm_round_trip(spark, d):
    g = _lonlat(spark, d).withColumn("epsg", S.utm_epsg(F.col("lon"), F.col("lat")))
    x, y = S.utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    lon, lat = S.from_utm(F.col("x"), F.col("y"), F.col("epsg"))
    return g.select("id", "epsg", x.alias("x"), y.alias("y")).select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


_Q = lambda lat: f"({1 - S._E2!r}::DOUBLE * (sin(radians({lat})) / (1 - {S._E2!r}::DOUBLE * pow(sin(radians({lat})), 2)) - ln((1 - {S._E!r}::DOUBLE * sin(radians({lat}))) / (1 + {S._E!r}::DOUBLE * sin(radians({lat})))) / {2 * S._E!r}::DOUBLE))"
_K0 = math.cos(math.radians(30)) / math.sqrt(1 - S._E2 * math.sin(math.radians(30)) ** 2)


@query(f"WITH {_LL} SELECT id, round({S.WGS84_A * _K0!r}::DOUBLE * radians(lon), 3) AS x, round({S.WGS84_A / (2 * _K0)!r}::DOUBLE * {_Q('lat')}, 3) AS y FROM ll")
def equal_area_projection(spark, d):
    x, y = S.equal_area(F.col("lon"), F.col("lat"))
    return _lonlat(spark, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_CONE = projections.Lambert(lon0=3.0, lat0=46.5, lat1=44.0, lat2=49.0, east=700000.0, north=6600000.0)
_POLE = projections.PolarStereographic(lon0=-45.0, lat1=70.0)
_SOUTH = projections.PolarStereographic(lon0=0.0, lat1=-71.0)
_SPHERE = projections.Lambert(lon0=12.0, lat0=42.0, lat1=38.0, lat2=46.0, a=6370000.0, f=0.0)


def _t(lat: str, e: float) -> str:
    """exp(-isometric latitude) in SQL, written as the tangent of half the polar distance."""
    return f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {e!r}::DOUBLE * sin(radians({lat}))) / (1 + {e!r}::DOUBLE * sin(radians({lat}))), {e / 2!r}::DOUBLE))"


def _m(lat: float, e: float) -> str:
    return f"(cos(radians({lat!r})) / sqrt(1 - pow({e!r}::DOUBLE * sin(radians({lat!r})), 2)))"


def _cone_sql(p: projections.Lambert) -> str:
    t1, t2, m1, m2 = _t(repr(p.lat1), p.e), _t(repr(p.lat2), p.e), _m(p.lat1, p.e), _m(p.lat2, p.e)
    return f"""WITH {_LL}, n AS (SELECT (ln({m1}) - ln({m2})) / (ln({t1}) - ln({t2})) AS n), c AS (SELECT n, {p.a!r}::DOUBLE * {m1} / (n * pow({t1}, n)) AS k FROM n),
o AS (SELECT n, k, k * pow({_t(repr(p.lat0), p.e)}, n) AS r0 FROM c),
q AS (SELECT id, k * pow({_t('lat', p.e)}, n) AS r, n * radians(lon - {p.lon0!r} - 360 * floor((lon - {p.lon0!r} + 180) / 360)) AS turn, r0 FROM ll CROSS JOIN o)
SELECT id, round({p.east!r}::DOUBLE + r * sin(turn), 2) AS x, round({p.north!r}::DOUBLE + r0 - r * cos(turn), 2) AS y FROM q"""


def _lambert(spark, d, p: projections.Lambert) -> DataFrame:
    x, y = p.forward(F.col("lon"), F.col("lat"))
    return _lonlat(spark, d).select("id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query(_cone_sql(_CONE))
def lambert_projection(spark, d):
    return _lambert(spark, d, _CONE)


@query(_cone_sql(_SPHERE))
def lambert_of_sphere(spark, d):
    return _lambert(spark, d, _SPHERE)


def _polar_sql(p: projections.PolarStereographic, where: str) -> str:
    side = 1 if p.lat1 > 0 else -1
    k = f"({p.a!r}::DOUBLE * {_m(abs(p.lat1), p.e)} / {_t(repr(abs(p.lat1)), p.e)} * {_t(f'({side} * lat)', p.e)})"
    return f"SELECT id, round({k} * sin(radians(lon - {p.lon0!r})), 2) AS x, round({-side} * {k} * cos(radians(lon - {p.lon0!r})), 2) AS y FROM ll WHERE {where}"


@query(f"WITH {_LL} {_polar_sql(_POLE, 'lat >= 0')} UNION ALL {_polar_sql(_SOUTH, 'lat < 0')}")
def polar_projection(spark, d):
    (a, b), (e, f) = (p.forward(F.col("lon"), F.col("lat")) for p in (_POLE, _SOUTH))
    north = F.col("lat") >= 0
    return _lonlat(spark, d).select("id", F.round(F.when(north, a).otherwise(e), 2).alias("x"), F.round(F.when(north, b).otherwise(f), 2).alias("y"))


@query(f"WITH {_LL} SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat, round(lon, 7) AS polar_lon, round(lat, 7) AS polar_lat FROM ll")
def projections_round_trip(spark, d):
    g = _lonlat(spark, d)
    x, y = _CONE.forward(F.col("lon"), F.col("lat"))
    (a, b), (e, f) = (p.forward(F.col("lon"), F.col("lat")) for p in (_POLE, _SOUTH))
    north = F.col("lat") >= 0
    g = g.select("id", north.alias("north"), x.alias("x"), y.alias("y"), F.when(north, a).otherwise(e).alias("u"), F.when(north, b).otherwise(f).alias("v"))
    lon, lat = _CONE.inverse(F.col("x"), F.col("y"))
    (a, b), (e, f) = (p.inverse(F.col("u"), F.col("v")) for p in (_POLE, _SOUTH))
    p, q = F.when(F.col("north"), a).otherwise(e), F.when(F.col("north"), b).otherwise(f)
    return g.select("id", *(F.round(c, 7).alias(n) for c, n in ((lon, "lon"), (lat, "lat"), (p, "polar_lon"), (q, "polar_lat"))))


@query(f"WITH {X.GRID} SELECT r, round({S.WGS84_A**2 / 2!r}::DOUBLE * radians(0.01) * abs({_Q('max(y)')} - {_Q('(max(y) - 0.01)')}), 1) AS area_m2 FROM grid GROUP BY r")
def cell_area_ellipsoid(spark, d):
    y = X.grid(spark, d).groupBy("r").agg(F.max("y").alias("y"))
    return y.select("r", F.round(S.ellipsoid_cell_area(F.col("y"), X.DX, X.DY), 1).alias("area_m2"))


# --- maps and axes -------------------------------------------------------------------------------------------------------


@query(f"""WITH {X.GRID}, n AS (SELECT g.cell_id, g.dem AS o, e.dem AS e, w.dem AS w, s.dem AS s, n.dem AS n FROM grid g LEFT JOIN grid e ON e.r = g.r AND e.c = g.c + 1 LEFT JOIN grid w ON w.r = g.r AND w.c = g.c - 1
  LEFT JOIN grid s ON s.c = g.c AND s.r = g.r + 1 LEFT JOIN grid n ON n.c = g.c AND n.r = g.r - 1),
k AS (SELECT *, coalesce((coalesce(e, o) - coalesce(w, o)) / nullif(((e IS NOT NULL)::INT + (w IS NOT NULL)::INT) * 100.0::DOUBLE, 0), 0) AS gx, coalesce((coalesce(s, o) - coalesce(n, o)) / nullif(((s IS NOT NULL)::INT + (n IS NOT NULL)::INT) * -100.0::DOUBLE, 0), 0) AS gy FROM n)
SELECT cell_id, CASE WHEN o IS NOT NULL THEN round(greatest(least((sin(radians(45)) - cos(radians(-225)) * cos(radians(45)) * gx - sin(radians(-225)) * cos(radians(45)) * gy) / sqrt(1 + gx * gx + gy * gy), 1), 0), 6) END AS shade FROM k""")
def hillshade(spark, d):
    return G.hillshade(X.grid(spark, d), 100.0, -100.0).select("cell_id", rnd("shade"))


@query(f"WITH {X.GRID}, {Q._VALUES} SELECT cell_id, CASE WHEN depth_m > 0.2 THEN round(depth_m, 6) END AS shown FROM vals")
def map_mask(spark, d):
    return Q._values(spark, d).select("cell_id", F.round(P.shown(F.col("depth_m"), 0.2), 6).alias("shown"))


@query(f"WITH {X.GRID}, {Q._VALUES} SELECT round(quantile_cont(depth_m, 0.995), 6) AS top FROM vals WHERE depth_m IS NOT NULL")
def colour_scale(spark, d):
    return P.colour_top(Q._values(spark, d), "depth_m").select(rnd("top"))


@query(f"WITH {X.GRID}, {Q._VALUES} SELECT CAST(floor(r * 20 / (SELECT max(r) + 1 FROM grid)) AS INTEGER) AS py, CAST(floor(c * 10 / 40) AS INTEGER) AS px, round(avg(depth_m), 6) AS value FROM vals GROUP BY ALL")
def map_pixels(spark, d):
    from pluvia import maps

    v, n = Q._values(spark, d).withColumn("shade", F.lit(1.0)), X.rows(spark, d)
    return maps.pixels(v, 10, 20, n, X.NCOL, "depth_m").select("py", "px", rnd("value")) if n >= 20 else maps.pixels(v.withColumn("r", F.floor(F.col("r") * 20 / n)), 10, 20, 20, X.NCOL, "depth_m").select("py", "px", rnd("value"))


_AXIS = "axis AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, 50 - n_nationkey * 0.5::DOUBLE - (n_nationkey % 3) * 0.1::DOUBLE AS v FROM nation)"


def _axis(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return X.read(spark, d, "nation").select(k.alias("i"), (50 - k * 0.5 - (k % 3) * 0.1).alias("v"))


@query(f"WITH {_AXIS}, a AS (SELECT i, v, (lag(v) OVER w + v) / 2 AS lo, (lead(v) OVER w + v) / 2 AS hi FROM axis WINDOW w AS (ORDER BY i)) SELECT i::BIGINT AS i, round(v, 6) AS v, round(coalesce(lo, 2 * v - hi), 6) AS lo, round(coalesce(hi, 2 * v - lo), 6) AS hi FROM a")
def axis_edges(spark, d):
    return G.axis_edges(_axis(spark, d)).select(F.col("i").cast("long").alias("i"), rnd("v"), rnd("lo"), rnd("hi"))


@query(f"WITH {_AXIS}, a AS (SELECT abs(v - lag(v) OVER (ORDER BY i)) AS d FROM axis) SELECT round(median(d), 6) AS step FROM a WHERE d IS NOT NULL")
def axis_step(spark, d):
    return G.median_step(_axis(spark, d)).select(rnd("step"))


@query(f"WITH {_AXIS} SELECT i::BIGINT AS i, row_number() OVER (ORDER BY v) - 1 AS k FROM axis")
def axis_upward(spark, d):
    return G.upward(_axis(spark, d)).select(F.col("i").cast("long").alias("i"), F.col("k").cast("long").alias("k"))


@query(f"WITH {X.GRID}, {X.D8.replace('flow AS', 'flow_ AS')} SELECT cell_id, CASE WHEN active THEN round(dem / 1000, 6) END AS depth_m FROM grid")
def depth_without_routing(spark, d):
    g = X.grid(spark, d)
    return g.select("cell_id", F.round(S.depth_from_runoff(F.col("dem"), F.col("active")), 6).alias("depth_m"))


# --- times and texts -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, TIMESTAMP '1900-01-01 00:00:00' + INTERVAL 15 MINUTE * (event_id * 37) AS hours, TIMESTAMP '2000-01-01 06:00:00' + INTERVAL 1 SECOND * event_id AS seconds FROM events")
def cf_times(spark, d):
    k = F.col("event_id")
    return X.read(spark, d, "events").select("event_id", S.from_cf(k * 37 / 4.0, "hours since 1900-01-01 00:00:0.0").cast("timestamp_ntz").alias("hours"), S.from_cf(k.cast("double"), "seconds since 2000-01-01T06:00:00Z").cast("timestamp_ntz").alias("seconds"))


@query("SELECT c_custkey, TIMESTAMP '2024-03-01 00:00:00' + INTERVAL 1 MINUTE * (c_custkey % 60) + INTERVAL 1 HOUR * (CASE WHEN c_custkey % 3 = 0 THEN -2 ELSE 0 END) AS t FROM customer")
def iso_times(spark, d):
    k = F.col("c_custkey")
    minute = F.lpad((k % 60).cast("string"), 2, "0")
    text = F.concat(F.lit("2024-03-01T00:"), minute, F.lit(":00"), F.when(k % 3 == 0, "+02:00").when(k % 3 == 1, "Z").otherwise(""))
    return X.read(spark, d, "customer").select("c_custkey", S.iso_timestamp(text).cast("timestamp_ntz").alias("t"))


@query("SELECT c_custkey, trim(lower(regexp_replace(c_name || ' / ' || c_mktsegment || '!', '[^A-Za-z0-9]+', '-', 'g')), '-') AS slug, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN c_name ELSE 'unknown-feature' END AS name FROM customer")
def names_and_slugs(spark, d):
    c = X.read(spark, d, "customer")
    k = F.col("c_custkey")
    props = F.create_map(F.lit("name"), F.when(k % 2 == 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).otherwise(F.lit(" ")), F.lit("feature_name"), F.when(k % 3 == 0, F.col("c_name")).otherwise(F.lit("")))
    return c.select("c_custkey", S.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("!"))).alias("slug"), S.feature_name(props, F.lit(None).cast("string")).alias("name"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Basic ' || to_base64(encode('u' || c_custkey || ':p')) WHEN c_custkey % 3 = 0 THEN 'Bearer t' || c_custkey END AS authorization_, CASE WHEN c_custkey % 5 = 0 THEN 'own' ELSE 'all' END AS x_source FROM customer""")
def request_headers(spark, d):
    k = F.col("c_custkey")
    h = S.headers(F.lit('{"X-Source":"all"}'), F.when(k % 2 == 0, F.concat(F.lit("u"), k.cast("string"))), F.lit("p"), F.when(k % 3 == 0, F.concat(F.lit("t"), k.cast("string"))), F.when(k % 5 == 0, F.create_map(F.lit("X-Source"), F.lit("own"))))
    return X.read(spark, d, "customer").select("c_custkey", F.try_element_at(h, F.lit("Authorization")).alias("authorization_"), F.try_element_at(h, F.lit("X-Source")).alias("x_source"))


@query(f"WITH {Q._RULES}, {Q._FEATURES} SELECT feature_id, rule, severity || ': ' || property || ' of ' || feature_id || ' is ' || actual AS message, '{{\"rule\":\"' || rule || '\",\"feature_id\":\"' || feature_id || '\"}}' AS payload FROM hits")
def alert_messages(spark, d):
    h = Q._hits(spark, d)
    text = A.rendered("{severity}: {property} of {feature} is {actual}", F.col("rule"), F.col("feature_id"), F.col("property"), F.col("actual"), F.col("severity"))
    return h.select("feature_id", "rule", text.alias("message"), A.payload(["rule", "feature_id"]).alias("payload"))


@query(f"""WITH {Q._RULES}, {Q._FEATURES}, r AS (SELECT *, len(list_filter(channels, lambda c: c = 'rest' OR (c = 'email' AND CAST(feature_id AS INTEGER) % 3 = 0))) AS routes, CAST(feature_id AS INTEGER) % 4 = 0 AS old FROM ids)
SELECT count(*) AS matched, count(*) FILTER (WHERE old) AS deduplicated, count(*) FILTER (WHERE NOT old AND routes = 0) AS missing_route, count(*) FILTER (WHERE NOT old AND routes > 0) AS deliverable, sum(CASE WHEN old THEN 0 ELSE routes END)::BIGINT AS deliveries FROM r""")
def alert_counters(spark, d):
    h = Q._hits(spark, d)
    sent = h.where(F.col("feature_id").cast("int") % 4 == 0).select("alert_id")
    r = A.routed(h, ["rest", "email"], {"rest": ["url"], "email": ["email"], "sms": ["phone"]})
    return A.run_summary(r, sent)


# --- windows -------------------------------------------------------------------------------------------------------------

_REC = "rec AS (SELECT ts, user_id AS station, CASE WHEN event_id % 17 <> 0 THEN value END AS rate FROM events)"


@query(f"""WITH {_REC}, g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 3 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM rec WHERE rate > 0 WINDOW w AS (PARTITION BY station ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY ts) AS k FROM g) SELECT station, min(ts) AS start, max(ts) AS last, round(avg(rate), 6) AS rate, count(*) AS n FROM s GROUP BY station, k""")
def rain_spells(spark, d):
    s = W.spells(X.stations(spark, d), 3 * 86400)
    return s.select("station", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), rnd("rate"), "n")


@query(f"""WITH {_REC}, w AS (SELECT station, rate, to_timestamp(floor(epoch(ts) / 21600) * 21600 - k * 21600) AS start FROM rec, range(0, 4) t(k) WHERE rate IS NOT NULL)
SELECT station, CAST(start AT TIME ZONE 'UTC' AS TIMESTAMP) AS start, round(avg(rate), 6) AS rate, count(*) AS n FROM w GROUP BY ALL""")
def sliding_rates(spark, d):
    return W.sliding(X.stations(spark, d), 86400, 21600).select("station", F.col("start").cast("timestamp_ntz").alias("start"), rnd("rate"), "n")


@query("""WITH s AS (SELECT user_id AS station, CASE WHEN event_id % 17 <> 0 THEN value END AS rate, CAST(floor(epoch(ts)) AS BIGINT) + 2208988800 AS s FROM events)
SELECT station, CAST(floor(s / 1000.0) * 1000 - 2208988800 AS BIGINT) AS start_s, round(avg(rate), 6) AS rate, count(*) AS n FROM s WHERE rate IS NOT NULL GROUP BY ALL""")
def stream_bins(spark, d):
    """The stream's bins, over a table: 1000 seconds do not divide a day, so that the origin of 1900 shows."""
    b = W.binned_stream(X.stations(spark, d).withColumn("ts", F.date_trunc("second", "ts")), 1000)
    return b.select("station", F.unix_seconds("start").alias("start_s"), rnd("rate"), "n")
