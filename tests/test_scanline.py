"""Scan lines against plain loops: holes, parts, uneven rows and columns, buffers, very long outlines, repeated ids."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.operators import geometry as Y
from pluvia.operators import scanline as N

X_EDGES = [0.0, 1.0, 1.5, 3.0, 3.25, 5.0, 6.0, 8.0, 8.5, 10.0]
Y_EDGES = [-1.0, 0.0, 0.75, 2.0, 2.5, 4.0, 5.0, 7.0]


@pytest.fixture(scope="module")
def cells(spark):
    out = []
    for r, (south, north) in enumerate(zip(Y_EDGES, Y_EDGES[1:])):
        for c, (west, east) in enumerate(zip(X_EDGES, X_EDGES[1:])):
            out.append((r * 100 + c, (west + east) / 2, (south + north) / 2, west, south, east, north))
    return spark.createDataFrame(out, "cell_id long, x double, y double, west double, south double, east double, north double")


def _shapes(spark, geometries):
    rows = [(k, json.dumps(g), g["type"]) for k, g in enumerate(geometries)]
    return Y.shapes(spark.createDataFrame(rows, "feature_id long, geometry string, geom_type string")).where("kind is not null")


def _star(rng, n, cx, cy, size):
    turn = np.sort(rng.random(n)) * 2 * math.pi
    far = size * (0.4 + 0.6 * rng.random(n))
    ring = [[float(cx + f * math.cos(t)), float(cy + f * math.sin(t))] for t, f in zip(turn, far)]
    return [*ring, ring[0]]


def _geometries():
    rng = np.random.default_rng(6)
    box = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    stars = [{"type": "Polygon", "coordinates": [_star(rng, int(rng.integers(3, 40)), rng.uniform(1, 9), rng.uniform(0, 6), rng.uniform(0.3, 5))]} for _ in range(12)]
    return [
        *stars,
        {"type": "Polygon", "coordinates": [box(0.5, 0.5, 8, 5), box(2, 1, 3, 2)[::-1]]},  # a hole
        {"type": "MultiPolygon", "coordinates": [[box(0, 0, 1, 1)], [box(5, 2, 4, 4), box(6, 3, 1, 1)]]},  # parts, a hole of the same turn
        {"type": "Polygon", "coordinates": [box(1.0, 0.0, 2.0, 2.0)[::-1]]},  # on borders, turned
        {"type": "Polygon", "coordinates": [box(-50, -50, 200, 200)]},  # all of the grid
        {"type": "Polygon", "coordinates": [box(40, 40, 2, 2)]},  # none of it
    ]


def test_areas_and_centres_equal_one_cell_at_a_time(spark, cells):
    s = _shapes(spark, _geometries())
    pairs = s.select("feature_id", "edges").join(F.broadcast(cells), F.lit(True))
    box = [F.col(c) for c in ("west", "south", "east", "north")]
    want = {(r["feature_id"], r["cell_id"]): (r["w"], r["inside"], r["full"]) for r in pairs.select("feature_id", "cell_id", Y.overlap(F.col("edges"), *box).alias("w"), Y.inside(F.col("x"), F.col("y"), F.col("edges")).alias("inside"), ((box[2] - box[0]) * (box[3] - box[1])).alias("full")).collect()}
    got = {(r["feature_id"], r["cell_id"]): r["w"] for r in N.areas(s, cells, 2.0).collect()}
    for key, (w, _, full) in want.items():
        assert abs(got.get(key, 0.0) - w) < 1e-8 * max(1, full), key
        assert (key in got) == (w > 1e-8 * full), key
    centres = [(r["feature_id"], r["cell_id"]) for r in N.centres(s, cells, 2.0).collect()]
    assert sorted(centres) == sorted(k for k, v in want.items() if v[1])
    assert {k[0] for k in got} == set(range(16))


@pytest.mark.parametrize("tile", [0.3, 100.0])
def test_tiles_change_nothing(spark, cells, tile):
    s = _shapes(spark, _geometries()[::3])
    rounded = lambda t: sorted((r["feature_id"], r["cell_id"], round(r["w"], 9)) for r in N.areas(s, cells, t).collect())
    assert rounded(tile) == rounded(2.0)
    assert sorted(map(tuple, N.centres(s, cells, tile).collect())) == sorted(map(tuple, N.centres(s, cells, 2.0).collect()))


@pytest.mark.parametrize("reach", [0.1, 1.3])
def test_near_equals_distances(spark, cells, reach):
    line = lambda *p: {"type": "LineString", "coordinates": [list(map(float, x)) for x in p]}
    s = _shapes(spark, [line((0, 0), (9, 6)), line((2, 3), (8, 3), (8, -1)), line((5, 5), (5, 5)), {"type": "Point", "coordinates": [3.1, 2.2]}, {"type": "MultiPoint", "coordinates": [[1.0, 1.0], [9.0, 6.0]]}])
    want = s.select("feature_id", "edges").join(F.broadcast(cells), F.lit(True)).where(Y.distance(F.col("x"), F.col("y"), F.col("edges")) <= reach)
    assert sorted((r["feature_id"], r["cell_id"]) for r in N.near(s, cells, 1.0, reach).collect()) == sorted((r["feature_id"], r["cell_id"]) for r in want.collect())


@pytest.mark.parametrize(("mode", "buffer"), [("centre", 0.0), ("touched", 0.0), ("exact", 0.0), ("centre", 0.8)])
def test_short_and_long_outlines_go_together(spark, cells, monkeypatch, mode, buffer):
    s = _shapes(spark, _geometries())
    rows = lambda: sorted((r["feature_id"], r["cell_id"], round(r["w"], 8)) for r in Y.weighted_cells(s, cells, 1.0, 1.0, 2.0, mode, buffer).collect())
    mixed = rows()
    monkeypatch.setattr(Y, "FEW_EDGES", 0)
    lines = rows()
    monkeypatch.setattr(Y, "FEW_EDGES", 10_000)
    assert mixed == lines == rows() and len(mixed) > 50


def test_outline_of_a_hundred_thousand_vertices(spark):
    n = 100_000
    t = np.arange(n) * 2 * math.pi / n
    far = 40 + np.sin(t * 500)
    ring = [[float(50 + f * math.cos(a)), float(50 + f * math.sin(a))] for a, f in zip(t, far)]
    s = _shapes(spark, [{"type": "Polygon", "coordinates": [[*ring, ring[0]]]}])
    side = spark.range(100 * 100).select(F.col("id").alias("cell_id"), (F.col("id") % 100 + 0.5).alias("x"), (F.floor(F.col("id") / 100) + 0.5).alias("y"))
    out = N.areas(s, Y.cell_boxes(side, 1.0, 1.0), 16.0)
    x, y = np.array(ring).T
    area = abs(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2
    assert out.agg(F.sum("w")).first()[0] == pytest.approx(area, rel=1e-9)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and plan.count("Generate explode") >= 4


def test_repeated_ids_are_features_of_their_own(spark):
    point = lambda x, y: json.dumps({"type": "Point", "coordinates": [x, y]})
    f = spark.createDataFrame([("a", point(0, 0), "Point"), ("a", point(3, 2), "Point"), ("a", point(0, 0), "Point"), (None, point(1, 1), "Point"), ("b", None, None)], "feature_id string, geometry string, geom_type string")
    cells = spark.range(20).select(F.col("id").alias("cell_id"), (F.col("id") % 5).cast("int").alias("c"), F.floor(F.col("id") / 5).cast("int").alias("r"), (F.col("id") % 5).cast("double").alias("x"), F.floor(F.col("id") / 5).cast("double").alias("y"), F.col("id").cast("double").alias("depth_m"), F.lit(0.5).alias("risk"))
    got = Y.enriched(f, cells, (0.0, 1.0, 5, 0.0, 1.0, 4), 4.0, 0.5)
    assert sorted((r["feature_id"] or "", r["depth_mean"] if r["depth_mean"] is not None else -1.0, r["mode"]) for r in got.collect() if r["mode"]) == [("", 6.0, "point"), ("a", 0.0, "point"), ("a", 0.0, "point"), ("a", 13.0, "point")]
    assert got.count() == 5


@pytest.mark.parametrize("axis", [[1.0, 2.0, 4.0, 8.0, 9.0], [5.0, 3.0, 2.5, -1.0], [7.0], [1.0, 2.0]])
def test_nearest_of_an_uneven_axis(spark, axis):
    values = [-100.0, 0.9, 1.5, 1.51, 3.0, 2.75, 0.75, 6.0, 8.4, 8.5, 100.0, None]
    points = spark.createDataFrame([(v,) for v in values], "px double")
    got = {r["px"]: r["c"] for r in Y.nearest_index(points, "px", spark.createDataFrame(list(enumerate(axis)), "i int, v double"), "c").collect()}
    for v in values:
        away = [abs(v - a) for a in axis] if v is not None else None
        assert got[v] == (away.index(min(away)) if away else None)
