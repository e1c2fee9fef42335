"""Zonal statistics: boxes against cells by a bucketed range join, polygons by scan lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions import scalars as S
from pluvia.operators import scanline as N


def candidates(features: DataFrame, cells: DataFrame, tile: float) -> DataFrame:
    """Features (x0, y0, x1, y1, ...) joined to cells (x, y, ...) whose centre is in their box: equi-join on tiles of ``tile``."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile))
    f = features.withColumn("tx", F.explode(span("x0", "x1"))).withColumn("ty", F.explode(span("y0", "y1")))
    c = cells.withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))
    return f.join(c, ["tx", "ty"]).where("x >= x0 and x <= x1 and y >= y0 and y <= y1").drop("tx", "ty")


def stats(pairs: DataFrame, key: str, weight: Column, depth: str, risk: str, threshold: float) -> DataFrame:
    """(key, n, depth_mean, depth_max, risk_mean, risk_max, flooded_pct): weighted; means and maxima need both values valid."""
    d, r = S.finite(F.col(depth)), S.finite(F.col(risk))
    both = d.isNotNull() & r.isNotNull()
    mean = lambda v: F.try_divide(F.sum(F.when(both, weight * v)), F.sum(F.when(both, weight)))
    pct = 100.0 * F.try_divide(F.sum(F.when(d.isNotNull(), F.when(d > threshold, weight).otherwise(0.0))), F.sum(F.when(d.isNotNull(), weight)))
    return pairs.groupBy(key).agg(F.count(F.when(both, 1)).alias("n"), mean(d).alias("depth_mean"), F.max(F.when(both, d)).alias("depth_max"), mean(r).alias("risk_mean"), F.max(F.when(both, r)).alias("risk_max"), pct.alias("flooded_pct"))


def zonal_by_centre(features: DataFrame, cells: DataFrame, tile: float, threshold: float, polygon: bool = False) -> DataFrame:
    """Statistics over cells whose centre is in the feature's box or, with ``polygon``, its ``ring``; weight cos(latitude)."""
    if polygon:
        n = F.floor(F.size("ring") / 2).cast("int")
        point = lambda k, names: [F.element_at("ring", (F.pmod(k, n) * 2 + j).cast("int")).alias(c) for j, c in enumerate(names, 1)]
        edges = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(*point(k, ("ax", "ay")), *point(k + 1, ("bx", "by")), F.lit(1.0).alias("s")))
        p = N.centres(features.select("feature_id", edges.alias("edges")), cells.withColumns({"west": F.col("x"), "east": F.col("x"), "south": F.col("y"), "north": F.col("y")}), tile)
    else:
        p = candidates(features, cells, tile)
    return stats(p, "feature_id", S.cos_lat(F.col("y")), "depth_m", "risk", threshold)


def zonal_by_area(features: DataFrame, cells: DataFrame, dx: float, dy: float, tile: float, threshold: float) -> DataFrame:
    """Statistics of rectangles weighted by the area they share with each cell (centres x, y; sides dx, dy), equal-area."""
    wide = features.select("feature_id", *((F.col(c) + s * h / 2).alias(c) for c, s, h in (("x0", -1, dx), ("x1", 1, dx), ("y0", -1, dy), ("y1", 1, dy))))
    p = candidates(wide, cells, tile).join(features.select("feature_id", *(F.col(c).alias(f"f_{c}") for c in ("x0", "x1", "y0", "y1"))), "feature_id")
    lap = lambda c, h, a, b: F.greatest(F.least(F.col(c) + h / 2, F.col(b)) - F.greatest(F.col(c) - h / 2, F.col(a)), F.lit(0.0))
    lat = lambda y: F.sin(F.radians(y))
    top, low = F.least(F.col("y") + dy / 2, F.col("f_y1")), F.greatest(F.col("y") - dy / 2, F.col("f_y0"))
    w = lap("x", dx, "f_x0", "f_x1") * F.greatest(lat(top) - lat(low), F.lit(0.0))
    return stats(p.withColumn("w", w).where("w > 0"), "feature_id", F.col("w"), "depth_m", "risk", threshold)


def sample_points(points: DataFrame, x0: float, dx: float, nx: int, y0: float, dy: float, ny: int, cells: DataFrame) -> DataFrame:
    """(feature_id, cell_id, depth_m, risk) at the nearest cell of a regular grid (c, r); ties go to the lower index."""
    near = lambda v, o, d, n: F.least(F.greatest(F.ceil((v - o) / d - 0.5), F.lit(0)), F.lit(n - 1)).cast("int")
    p = points.select("feature_id", near(F.col("px"), x0, dx, nx).alias("c"), near(F.col("py"), y0, dy, ny).alias("r"))
    return p.join(cells, ["r", "c"], "left").select("feature_id", "cell_id", "depth_m", "risk")
