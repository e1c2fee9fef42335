"""Features against cells line by line: edges meet the rows of the grid that they cross, and sorted crossings make spans of cells.

An edge is a row of its own from the first step on; no list of edges meets a cell. The grid is rectilinear: cells (x, y: centres;
west, south, east, north) of one row have the same y, and rows and columns may be of any heights and widths.

* Centres: the crossings of a feature with the line through a row's centres, sorted; between the first and the second, the third
  and the fourth and so on, centres are inside.
* Areas: a piece of an edge within a row adds (with its sign) its height to all that lies to the right of it: a running sum
  along the row gives the height that is covered from one piece to the next, and only cells that a piece passes through take a
  part of it, in closed form.

A row's share of a feature is what a window sorts; spans are cut at tiles before they meet cells, so that a task gets the part of a row
within a tile. Sums of signed heights round: an area below ``LEAST`` of the cell's own is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 1e-9
#: Rows of a grid (24 bytes each) that are broadcast at most.
MOST_ROWS = 1_000_000


def edges(shapes_: DataFrame) -> DataFrame:
    """(feature_id, ax, ay, bx, by, s): a row for each edge."""
    return shapes_.select("feature_id", F.explode("edges").alias("e")).select("feature_id", "e.*")


def rows(cells: DataFrame) -> DataFrame:
    """(y, south, north) of the grid's rows, marked for broadcast where they are few enough."""
    r = cells.select("y", "south", "north").distinct()
    return F.broadcast(r) if r.count() <= MOST_ROWS else r


def _met(edges_: DataFrame, rows_: DataFrame, tile: float, low: str, high: str, reach: float = 0.0) -> DataFrame:
    """Edges joined to the rows whose interval (``low``, ``high``) they come to within ``reach``: equi-join on tiles of y."""
    at = lambda c: F.floor(c / tile)
    e = edges_.withColumns({"e0": F.least("ay", "by") - reach, "e1": F.greatest("ay", "by") + reach})
    e = e.withColumn("ty", F.explode(F.sequence(at(F.col("e0")), at(F.col("e1")))))
    r = rows_.withColumn("ty", F.explode(F.sequence(at(F.col(low)), at(F.col(high)))))
    once = F.col("ty") == F.greatest(at(F.col("e0")), at(F.col(low)))  # both may reach over several tiles: the first counts
    return e.join(r, "ty").where((F.col("e1") >= F.col(low)) & (F.col("e0") <= F.col(high)) & once).drop("ty", "e0", "e1")


def _spread(spans: DataFrame, cells: DataFrame, tile: float) -> DataFrame:
    """Spans (y, lo, hi, ...) joined to the cells of their row and tile; ``first``: is it the first tile of both? ``own``: of the cell?"""
    at = lambda c: F.floor(F.col(c) / tile)
    s = spans.withColumn("tx", F.explode(F.sequence(at("lo"), at("hi"))))
    c = cells.withColumn("tx", F.explode(F.sequence(at("west"), at("east"))))
    p = s.join(c, ["y", "tx"])
    return p.withColumn("own", F.col("tx") == at("west")).withColumn("first", F.col("tx") == F.greatest(at("lo"), at("west"))).drop("tx")


def centres(shapes_: DataFrame, cells: DataFrame, tile: float) -> DataFrame:
    """(feature_id, cell columns): cells whose centre is in the polygon: an odd number of edges lies to its right."""
    crossing = _met(edges(shapes_), rows(cells), tile, "y", "y").where((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y")))
    x = F.col("ax") + (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay"))
    along = Window.partitionBy("feature_id", "y").orderBy("lo")
    spans = crossing.select("feature_id", "y", x.alias("lo")).select("feature_id", "y", "lo", F.lead("lo").over(along).alias("hi"), F.row_number().over(along).alias("k"))
    spans = spans.where("k % 2 = 1 and hi > lo").drop("k")
    # a centre lies in one span of its row at most; it is looked up in the tile of its own
    here = (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))
    return _spread(spans, cells, tile).where(here & F.col("first")).select("feature_id", *cells.columns)


def areas(shapes_: DataFrame, cells: DataFrame, tile: float) -> DataFrame:
    """(feature_id, cell columns, w): the area that each polygon shares with each cell."""
    met = _met(edges(shapes_).where("ay <> by"), rows(cells), tile, "south", "north")
    low, high = F.greatest(F.least("ay", "by"), "south"), F.least(F.greatest("ay", "by"), "north")
    slope = (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    place = lambda y: F.col("ax") + slope * (y - F.col("ay"))
    height = F.col("s") * F.signum(F.col("by") - F.col("ay")) * (high - low)
    piece = met.where(high > low).select("feature_id", "y", F.least(place(low), place(high)).alias("lo"), F.greatest(place(low), place(high)).alias("hi"), height.alias("h"), (F.col("north") - F.col("south")).alias("tall"))
    along = Window.partitionBy("feature_id", "y").orderBy("hi")
    covered = piece.select("feature_id", "y", F.col("hi").alias("lo"), F.lead("hi").over(along).alias("hi"), F.sum("h").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("h"), "tall")
    covered = covered.where((F.col("hi") > F.col("lo")) & (F.abs("h") > LEAST * F.col("tall")))
    both = piece.withColumn("whole", F.lit(False)).unionByName(covered.withColumn("whole", F.lit(True))).drop("tall")
    p = _spread(both, cells, tile)
    lo, hi, west, east = (F.col(c) for c in ("lo", "hi", "west", "east"))
    beyond = (west >= lo) & (west < hi) & F.col("own")
    through = (hi > west) & (lo < east) & F.col("first")
    p = p.where(F.when(F.col("whole"), beyond).otherwise(through))
    # of a piece, what lies between it and the cell's east side, in the mean over the piece
    within = lambda c: F.least(F.greatest(c, west), east)
    a, b = within(lo), within(hi)
    mean = F.when(hi > lo, ((east - west) * (F.least(hi, west) - F.least(lo, west)) + (b - a) * (east - (a + b) / 2)) / (hi - lo)).otherwise(east - a)
    part = -F.col("h") * F.when(F.col("whole"), east - west).otherwise(mean)
    return p.groupBy("feature_id", *cells.columns).agg(F.sum(part).alias("w")).where((F.col("w") > LEAST * (east - west) * (F.col("north") - F.col("south"))))


def near(shapes_: DataFrame, cells: DataFrame, tile: float, reach: float) -> DataFrame:
    """(feature_id, cell columns): cells whose centre is within ``reach`` of an edge."""
    met = _met(edges(shapes_), rows(cells), tile, "y", "y", reach)
    x, y = F.col("x"), F.col("y")
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    # the part of the edge within reach of the row bounds its cells
    share = lambda v: F.least(F.greatest(F.coalesce(F.try_divide(v - F.col("ay"), ey), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    ends = [F.col("ax") + F.when(ey == 0, F.lit(t)).otherwise(share(y + d)) * ex for t, d in ((0.0, -reach), (1.0, reach))]
    spans = met.withColumns({"lo": F.least(*ends) - reach, "hi": F.greatest(*ends) + reach})
    t = F.least(F.greatest(F.coalesce(F.try_divide((x - F.col("ax")) * ex + (y - F.col("ay")) * ey, ex * ex + ey * ey), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    away = F.hypot(x - F.col("ax") - t * ex, y - F.col("ay") - t * ey)
    p = _spread(spans.drop("south", "north"), cells, tile).where((x >= F.col("lo")) & (x <= F.col("hi")) & F.col("first") & (away <= reach))
    return p.select("feature_id", *cells.columns).dropDuplicates()
