"""Raster operators on a cell table (cell_id, r, c, x, y, dem, ...): directions, downstream cells, travel times, axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions import projections
from pluvia.functions import scalars as S


def in_projection(target: DataFrame, crs: int | dict | None) -> DataFrame:
    """``target`` (cell_id, x, y in degrees) with x and y of an EPSG code or of a grid mapping; what that cannot show is left out."""
    x, y = projections.of(crs)(F.col("x"), F.col("y"))
    return target.select("cell_id", x.alias("x"), y.alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def nearest_on_grid(target: DataFrame, x0: float, dx: float, nx: int, y0: float, dy: float, ny: int) -> DataFrame:
    """``target`` (..., x, y) with the indices i, j of the nearest node of an even grid, by arithmetic; ties go to the lower index."""
    index = lambda v, v0, dv, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((F.col(v) - v0) / dv - 0.5))).cast("int")
    return target.withColumn("i", index("x", x0, dx, nx)).withColumn("j", index("y", y0, dy, ny))


def reprojected(target: DataFrame, crs: int | dict | None, x0: float, dx: float, nx: int, y0: float, dy: float, ny: int, source: DataFrame) -> DataFrame:
    """``target`` (cell_id, x, y in degrees) with the columns of the nearest node of ``source`` (i, j, ...), an even grid in a projection.

    Projected coordinates of cells are all different, so nodes are found by arithmetic and not by a list of an axis.
    """
    near = nearest_on_grid(in_projection(target, crs), x0, dx, nx, y0, dy, ny)
    return near.drop("x", "y").join(source, ["i", "j"]).drop("i", "j")


def clean_domain(raw: DataFrame, dem_fill: float | None = None) -> DataFrame:
    """Domain contract: missing elevation is inactive; direction and curve number of inactive cells are 0; channel is a flag."""
    dem = S.finite(F.col("dem"))
    dem = F.when(dem != dem_fill, dem) if dem_fill is not None else dem
    d = raw.withColumn("dem", dem).withColumn("active", F.col("dem").isNotNull())
    for name in ("d8", "cn"):
        if name in d.columns:
            d = d.withColumn(name, F.when(F.col("active"), F.coalesce(S.finite(F.col(name)), F.lit(0.0))).otherwise(0.0).cast("int" if name == "d8" else "double"))
    if "channel" in d.columns:
        d = d.withColumn("channel", F.coalesce(F.col("channel").cast("int") > 0, F.lit(False)) & F.col("active"))
    return d


def d8_from_dem(grid: DataFrame, dx: float, dy: float) -> DataFrame:
    """(cell_id, d8): the steepest descent among eight neighbours, the first direction on ties, 0 where none falls.

    Every cell sends its elevation to its neighbours and one aggregation by target compares: one shuffle, no self-join.
    """
    near, far = (abs(dx) + abs(dy)) / 2, (dx * dx + dy * dy) ** 0.5
    sent = F.array(F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc"), F.lit(-1).alias("k")), *(F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(k).alias("k")) for k, (_, dr, dc) in enumerate(S.D8)))
    s = grid.where(F.col("dem").isNotNull()).select("r", "c", "cell_id", "dem", F.explode(sent).alias("s"))
    s = s.groupBy((F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c")).agg(
        F.max(F.when(F.col("s.k") == -1, F.col("cell_id"))).alias("cell_id"), F.max(F.when(F.col("s.k") == -1, F.col("dem"))).alias("own"), *(F.max(F.when(F.col("s.k") == k, F.col("dem"))).alias(f"n{k}") for k in range(8))
    )
    best, code = F.lit(0.0), F.lit(0)
    for k, (c, dr, dc) in enumerate(S.D8):
        slope = (F.col("own") - F.col(f"n{k}")) / (far if dr and dc else near)
        s = s.withColumn(f"s{k}", slope)
    for k, (c, _, _) in enumerate(S.D8):
        code = F.when(F.col(f"s{k}") > best, F.lit(c)).otherwise(code)
        best = F.greatest(best, F.coalesce(F.col(f"s{k}"), F.lit(0.0)))
    return s.where("cell_id is not null").select("cell_id", code.alias("d8"))


def downstream(grid: DataFrame, encoding: str = "esri") -> DataFrame:
    """(cell_id, ds_id): the cell that d8 points at; NULL for unknown codes and cells outside the grid. It may be inactive."""
    steps = S.ENCODINGS[encoding]
    dr, dc = F.lit(None).cast("int"), F.lit(None).cast("int")
    for code, a, b in steps:
        dr, dc = F.when(F.col("d8") == code, a).otherwise(dr), F.when(F.col("d8") == code, b).otherwise(dc)
    g = grid.select("cell_id", (F.col("r") + dr).alias("tr"), (F.col("c") + dc).alias("tc"))
    t = grid.select(F.col("cell_id").alias("ds_id"), F.col("r").alias("tr"), F.col("c").alias("tc"))
    return g.join(t, ["tr", "tc"], "left").select("cell_id", "ds_id")


def axis_edges(axis: DataFrame) -> DataFrame:
    """(i, v, lo, hi): edges of an axis (i, v) half-way between centres, carried on at both ends. Axes are one-dimensional and small."""
    w = Window.orderBy("i")
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    a = axis.select("i", "v", ((before + F.col("v")) / 2).alias("lo0"), ((after + F.col("v")) / 2).alias("hi0"))
    lo = F.coalesce("lo0", 2 * F.col("v") - F.col("hi0"))
    hi = F.coalesce("hi0", 2 * F.col("v") - F.col("lo0"))
    return a.select("i", "v", lo.alias("lo"), hi.alias("hi"))


def is_monotonic(axis: DataFrame) -> bool:
    """Whether the axis (i, v) rises strictly or falls strictly."""
    step = F.signum(F.col("v") - F.lag("v").over(Window.orderBy("i")))
    found = axis.select(step.alias("s")).where("s is not null").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    return found["lo"] is None or (found["lo"] == found["hi"] and found["lo"] != 0)


def median_step(axis: DataFrame) -> DataFrame:
    """(step): median absolute difference of neighbours on an axis (i, v)."""
    return axis.select(F.abs(F.col("v") - F.lag("v").over(Window.orderBy("i"))).alias("d")).agg(F.median("d").alias("step"))


def within(grid: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells whose centres are in the box, borders included; the predicate reaches the scan."""
    return grid.where(F.col("x").between(west, east) & F.col("y").between(south, north))


def nearest_nodes(target: DataFrame, axis_x: DataFrame, axis_y: DataFrame) -> DataFrame:
    """``target`` (..., x, y) with the indices i, j of the nearest node on each axis (i, v); ties go to the lower index.

    The nearest index is found on each axis by itself: distinct target coordinates against a small one-dimensional axis.
    """
    def nearest(coord: str, axis: DataFrame, out: str) -> DataFrame:
        t = target.select(F.col(coord).alias("t")).distinct()
        a = axis.agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("axis"))  # one row: an axis, not a grid
        t = t.join(F.broadcast(a), F.lit(True), "left")
        best = F.array_min(F.transform("axis", lambda e: F.struct(F.abs(e["v"] - F.col("t")).alias("d"), e["i"].alias("i"))))
        return t.select(F.col("t").alias(coord), best["i"].alias(out))

    return target.join(nearest("x", axis_x, "i"), "x").join(nearest("y", axis_y, "j"), "y")


def regrid_nearest(target: DataFrame, source_axis_x: DataFrame, source_axis_y: DataFrame, source: DataFrame, value: str) -> DataFrame:
    """``target`` (cell_id, x, y) with the value of the nearest source cell (i, j)."""
    t = nearest_nodes(target, source_axis_x, source_axis_y)
    return t.join(source.select("i", "j", F.col(value).alias("value")), ["i", "j"], "left").select("cell_id", "value")


def regrid_bilinear(target: DataFrame, x0: float, dx: float, nx: int, y0: float, dy: float, ny: int, source: DataFrame, value: str) -> DataFrame:
    """``target`` (cell_id, x, y) with values of a regular source grid (i, j), linear on both axes; NULL outside it."""
    fx, fy = (F.col("x") - x0) / dx, (F.col("y") - y0) / dy
    t = target.withColumn("fx", fx).withColumn("fy", fy).where(F.col("fx").between(0, nx - 1) & F.col("fy").between(0, ny - 1))
    t = t.withColumn("i0", F.least(F.floor("fx"), F.lit(nx - 2)).cast("int")).withColumn("j0", F.least(F.floor("fy"), F.lit(ny - 2)).cast("int"))
    u, v = F.col("fx") - F.col("i0"), F.col("fy") - F.col("j0")
    corner = lambda a, b: F.struct((F.col("i0") + a).alias("i"), (F.col("j0") + b).alias("j"), ((u if a else 1 - u) * (v if b else 1 - v)).alias("w"))
    t = t.select("cell_id", F.explode(F.array(*(corner(a, b) for a in (0, 1) for b in (0, 1)))).alias("k")).select("cell_id", "k.*")
    s = source.select("i", "j", F.col(value).alias("value"))
    done = t.join(s, ["i", "j"], "left").groupBy("cell_id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return target.select("cell_id").join(done, "cell_id", "left")


def hillshade(grid: DataFrame, dx: float, dy: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """(cell_id, shade): light of 0 to 1 from the elevation's gradient, one-sided at borders; NULL without elevation.

    ``dy`` is the step from a row to the next, negative for rows that go south. One shuffle, as in :func:`d8_from_dem`.
    """
    import math

    sides = {"e": (0, 1), "w": (0, -1), "s": (1, 0), "n": (-1, 0)}
    sent = F.array(F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc"), F.lit("o").alias("k")), *(F.struct(F.lit(-a).alias("dr"), F.lit(-b).alias("dc"), F.lit(k).alias("k")) for k, (a, b) in sides.items()))
    s = grid.where(F.col("dem").isNotNull()).select("r", "c", "cell_id", "dem", F.explode(sent).alias("s"))
    pick = lambda k, v: F.max(F.when(F.col("s.k") == k, F.col(v)))
    s = s.groupBy((F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c")).agg(pick("o", "cell_id").alias("cell_id"), pick("o", "dem").alias("o"), *(pick(k, "dem").alias(k) for k in sides))

    def slope(a: str, b: str, d: float):
        have = F.col(a).isNotNull().cast("int") + F.col(b).isNotNull().cast("int")
        return F.coalesce(F.try_divide(F.coalesce(a, "o") - F.coalesce(b, "o"), have * d), F.lit(0.0))

    gx, gy = slope("e", "w", dx), slope("s", "n", dy)
    az, alt = math.radians(90 - azimuth), math.radians(altitude)
    lx, ly, lz = math.cos(az) * math.cos(alt), math.sin(az) * math.cos(alt), math.sin(alt)
    light = (lz - lx * gx - ly * gy) / F.sqrt(1 + gx * gx + gy * gy)
    return grid.select("cell_id").join(s.where("cell_id is not null").select("cell_id", F.least(F.greatest(light, F.lit(0.0)), F.lit(1.0)).alias("shade")), "cell_id", "left")


def upward(axis: DataFrame) -> DataFrame:
    """(i, v, k) of an axis (i, v): ``k`` counts from the lowest value, so that rows can be read from south to north."""
    return axis.select("i", "v", (F.row_number().over(Window.orderBy("v", "i")) - 1).alias("k"))  # one axis


def axis_values(low: float, high: float, step: float, rising: bool = True) -> list[float]:
    """Values of an axis from one end to the other, both included where the step fits; ``step`` > 0."""
    import math

    if step <= 0:
        raise ValueError("the resolution must be positive")
    n = max(1, math.ceil((high - low) / step + 0.5 - 1e-9))
    return [low + k * step if rising else high - k * step for k in range(n)]


def slabs(grid: DataFrame, parts: int) -> DataFrame:
    """(r, active_rows, slab): rows in ``parts`` slabs of about equal numbers of active cells.

    A row goes where the middle of its share of the running total falls. The rows are one axis: a small table.
    """
    rows = grid.groupBy("r").agg(F.sum(F.col("active").cast("long")).alias("cells"))
    w = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = rows.withColumn("upto", F.sum("cells").over(w)).withColumn("total", F.sum("cells").over(Window.partitionBy()))
    middle = (F.col("upto") - F.col("cells") / 2.0) / F.col("total") * parts
    return total.select("r", "cells", F.least(F.floor(middle), F.lit(parts - 1)).cast("int").alias("slab"))


def snapped_box(west: float, south: float, east: float, north: float, x0: float, y0: float, dx: float, dy: float, refinement: int) -> dict[str, float]:
    """A nested domain's box on the lines of its parent grid: lower corner up, upper corner down; the child's steps."""
    import math

    if refinement <= 1:
        raise ValueError("refinement must be above 1")
    up = lambda v, o, d: o + math.ceil((v - o) / d - 1e-9) * d
    down = lambda v, o, d: o + math.floor((v - o) / d + 1e-9) * d
    box = {"west": up(west, x0, dx), "south": up(south, y0, dy), "east": down(east, x0, dx), "north": down(north, y0, dy)}
    if box["east"] <= box["west"] or box["north"] <= box["south"]:
        raise ValueError("the box has no cell of the parent grid")
    return box | {"dx": dx / refinement, "dy": dy / refinement}
