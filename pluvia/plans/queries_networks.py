"""Queries of station networks, uneven axes and repeated features, with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators import geometry as Y
from pluvia.operators import variogram as V
from pluvia.plans import fixtures as X
from pluvia.plans import queries as Q
from pluvia.plans import queries_features as K
from pluvia.plans.queries import query, rnd
from pluvia.plans.storage import dealt

_NET = "net AS (SELECT CAST((day(ts) - 1) // 10 AS BIGINT) AS bin, user_id AS station, (user_id % 40)::DOUBLE AS x, (user_id % 37)::DOUBLE AS y, avg(value) AS value FROM events WHERE event_id % 17 <> 0 GROUP BY ALL)"


def _net(spark, d) -> DataFrame:
    s = X.stations(spark, d).where("rate is not null")
    u = F.col("station")
    return s.groupBy(F.floor((F.day("ts") - 1) / 10).alias("bin"), "station").agg(F.avg("rate").alias("value")).withColumns({"x_m": (u % 40).cast("double"), "y_m": (u % 37).cast("double")})


@query(f"""WITH {_NET}, p AS (SELECT a.bin, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS h, pow(a.value - b.value, 2) / 2 AS g FROM net a JOIN net b ON a.bin = b.bin AND a.station < b.station)
SELECT bin, CAST(floor(h / 2) AS INTEGER) AS lag, count(*) AS pairs, round(avg(h), 6) AS distance_m, round(avg(g), 4) AS semivariance FROM p WHERE h < 16 GROUP BY ALL""")
def variogram_lags(spark, d):
    t = V.lag_table(_net(spark, d), 2.0, 8)
    return t.select("bin", "lag", "pairs", rnd("distance_m"), rnd("semivariance", 4))


# --- uneven axes ---------------------------------------------------------------------------------------------------------

_UNEVEN = f"""WITH {X.GRID}, {Q._VALUES}, {K._S}, ax AS (SELECT DISTINCT c, c * 0.7::DOUBLE + (c % 3) * 0.1::DOUBLE AS v FROM grid), ay AS (SELECT DISTINCT r, r * 0.5::DOUBLE + (r % 2) * 0.2::DOUBLE AS v FROM grid),
bx AS (SELECT c, v, (lag(v) OVER (ORDER BY c) + v) / 2 AS lo, (lead(v) OVER (ORDER BY c) + v) / 2 AS hi FROM ax), bxx AS (SELECT c, v, coalesce(lo, 2 * v - hi) AS west, coalesce(hi, 2 * v - lo) AS east FROM bx),
b_y AS (SELECT r, v, (lag(v) OVER (ORDER BY r) + v) / 2 AS lo, (lead(v) OVER (ORDER BY r) + v) / 2 AS hi FROM ay), byy AS (SELECT r, v, coalesce(lo, 2 * v - hi) AS south, coalesce(hi, 2 * v - lo) AS north FROM b_y)"""


def _axes(spark, d) -> tuple[DataFrame, DataFrame]:
    g = X.grid(spark, d)
    x = g.select(F.col("c").alias("i")).distinct().withColumn("v", F.col("i") * 0.7 + (F.col("i") % 3) * 0.1)
    return x, g.select(F.col("r").alias("i")).distinct().withColumn("v", F.col("i") * 0.5 + (F.col("i") % 2) * 0.2)


def _boxes(spark, d) -> DataFrame:
    x, y, w, h = (F.col(c) for c in ("fx", "fy", "w", "h"))
    g = K._text('{"type":"Polygon","coordinates":[', *K._box(x, y, w, h), "]}")
    return Y.shapes(dealt(K._suppliers(spark, d), "feature_id").select("feature_id", g.alias("geometry"), F.lit("Polygon").alias("geom_type")))


@query(f"""{_UNEVEN}, q AS (SELECT feature_id, depth_m, risk, greatest(least(east, fx + w) - greatest(west, fx), 0) * greatest(least(north, fy + h) - greatest(south, fy), 0) AS w_, (east - west) * (north - south) AS whole
  FROM sup JOIN bxx ON east > fx AND west < fx + w JOIN byy ON north > fy AND south < fy + h JOIN vals USING (r, c)), p AS (SELECT feature_id, depth_m, risk, w_ AS w FROM q WHERE w_ > 1e-6 * whole) SELECT feature_id, {Q._STATS} FROM p GROUP BY feature_id""")
def zonal_uneven_axes(spark, d):
    cells = Y.uneven_boxes(Q._values(spark, d), *_axes(spark, d))
    p = Y.weighted_cells(_boxes(spark, d), cells, 1.0, 1.0, 4.0, "exact").where("w > 1e-6 * (east - west) * (north - south)")
    return Q._rounded(Q.Z.stats(p, "feature_id", F.col("w"), "depth_m", "risk", 0.5))


def _long_outlines(spark, d) -> DataFrame:
    """Boxes of suppliers whose sides are cut into 16 edges each: 64 edges, which go by scan lines."""
    x, y, w, h = (F.col(c) for c in ("fx", "fy", "w", "h"))
    n = 16
    corners = [(x, y, w, 0), (x + w, y, 0, h), (x + w, y + h, -w, 0), (x, y + h, 0, -h)]
    points = [(a + u * (k / n), b + v * (k / n)) for a, b, u, v in corners for k in range(n)]
    g = K._text('{"type":"Polygon","coordinates":[', *K._ring(*points), "]}")
    return Y.shapes(dealt(K._suppliers(spark, d), "feature_id").select("feature_id", g.alias("geometry"), F.lit("Polygon").alias("geom_type")))


@query(f"""WITH {X.GRID}, {Q._VALUES}, {K._S}, q AS (SELECT feature_id, depth_m, risk, greatest(least(x + 0.5, fx + w) - greatest(x - 0.5, fx), 0) * greatest(least(y + 0.5, fy + h) - greatest(y - 0.5, fy), 0) AS a
  FROM sup JOIN vals ON x + 0.5 > fx AND x - 0.5 < fx + w AND y + 0.5 > fy AND y - 0.5 < fy + h), p AS (SELECT feature_id, depth_m, risk, a AS w FROM q WHERE a > 1e-6) SELECT feature_id, {Q._STATS} FROM p GROUP BY feature_id""")
def zonal_long_outline(spark, d):
    p = Y.weighted_cells(_long_outlines(spark, d), Q._values(spark, d), 1.0, 1.0, 4.0, "exact").where("w > 1e-6")
    return Q._rounded(Q.Z.stats(p, "feature_id", F.col("w"), "depth_m", "risk", 0.5))


@query(f"""{_UNEVEN}, x_ AS (SELECT feature_id, c FROM sup, ax QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY abs(fx + 0.013 - v), c) = 1),
y_ AS (SELECT feature_id, r FROM sup, ay QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY abs(fy + 0.017 - v), r) = 1)
SELECT feature_id, cell_id, round(depth_m, 6) AS depth_m, round(risk, 6) AS risk FROM x_ JOIN y_ USING (feature_id) LEFT JOIN vals USING (r, c)""")
def sample_uneven_axes(spark, d):
    points = K._suppliers(spark, d).select("feature_id", (F.col("fx") + 0.013).alias("px"), (F.col("fy") + 0.017).alias("py"))
    return Y.sample_uneven(points, *_axes(spark, d), Q._values(spark, d)).select("feature_id", "cell_id", rnd("depth_m"), rnd("risk"))


@query(f"""WITH {X.GRID}, {Q._VALUES}, {K._S} SELECT feature_id AS own, feature_id % 7 AS feature_id, 'point' AS mode, round(depth_m, 6) AS depth_mean FROM sup LEFT JOIN vals ON c = least(greatest(ceil(fx - 0.5), 0), 39) AND r = least(greatest(ceil(fy - 0.5), 0), (SELECT max(r) FROM grid))""")
def feature_repeats(spark, d):
    """Ids that many features share: each row keeps its own statistics."""
    point = K._text('{"type":"Point","coordinates":[', F.col("fx"), ",", F.col("fy"), "]}")
    f = K._suppliers(spark, d).select(F.col("feature_id").alias("own"), (F.col("feature_id") % 7).alias("feature_id"), point.alias("geometry"), F.lit("Point").alias("geom_type"))
    e = Y.enriched(f, Q._values(spark, d), (0.0, 1.0, X.NCOL, 0.0, 1.0, X.rows(spark, d)), 4.0, 0.5)
    return e.select("own", "feature_id", "mode", rnd("depth_mean"))

