"""What grows with the tables: work that is shared by steps, inputs that are read once, places instead of stations."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pluvia.operators import geometry as Y
from pluvia.operators import products as P
from pluvia.operators import rain as R
from pluvia.operators import stations as T
from pluvia.operators import variogram as V
from pluvia.plans import queries as Q

DATA = "/root/testdata/sf0.001"


def test_percentiles_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    values = spark.range(500).select((F.col("id") * 37 % 500).cast("double").alias("q"))
    norm = P.normalized(values.mapInArrow(count, values.schema), ["q"], exact_rows=0)
    assert sorted(r["q_norm"] for r in norm.collect())[250] == pytest.approx((250 - 24.95) / (474.05 - 24.95))
    assert seen.value <= 1000  # once, or twice where a checkpoint runs its job again


def test_runoff_total_is_the_last_of_the_steps(spark):
    rng = random.Random(4)
    grid = spark.createDataFrame([(k, 40.0 + 7 * k, k != 5) for k in range(9)], "cell_id long, cn double, active boolean")
    rain = spark.createDataFrame([(s, k, rng.uniform(0, 30)) for s in range(12) for k in range(9)], "step int, cell_id long, rain_mm double")
    want = {r["cell_id"]: (r["p_cum_mm"], r["q_cum_mm"]) for r in R.runoff_steps(rain, grid).where("step = 11").collect()}
    got = {r["cell_id"]: (r["p_cum_mm"], r["q_cum_mm"]) for r in R.runoff_total(rain, grid).collect()}
    assert got.keys() == want.keys() and 5 not in got
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_blend_sums_equal_slices_once(spark):
    rng = random.Random(5)
    picked = [(s, step, rng.choice((0, 0, 1, None))) for s in "abc" for step in range(20)]
    rates = [(s, k, cell, rng.uniform(-1, 9)) for s in "abc" for k in range(2) for cell in range(6) if (s, k, cell) not in {("a", 0, 3), ("b", 0, 3), ("c", 0, 3)}]
    weights = {"a": 0.5, "b": -0.25, "c": 0.0}
    want: dict = defaultdict(float)
    for s, step, k in picked:
        for s2, k2, cell, rate in rates:
            if (s, k) == (s2, k2) and weights[s]:
                want[step, cell] += max(rate, 0) * 2 * weights[s]
    out = R.blend(spark.createDataFrame(picked, "source string, step int, k int"), spark.createDataFrame(rates, "source string, k int, cell_id long, rate double"), weights, "intensity_mmph", 7200.0)
    got = {(r["step"], r["cell_id"]): r["rain_mm"] for r in out.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def _shuffles(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "cell_id" in line]


def test_rain_stays_where_its_cells_are(spark):
    """One shuffle with a cell in it: the grid's own, before slices meet it."""
    rain = _shuffles(Q.rain_blend(spark, DATA))
    assert len(rain) == 1 and "REPARTITION_BY_NUM" in rain[0]


def test_runoff_sorts_rain_once(spark):
    """Only the grid is shuffled, and only the window sorts the rain of all steps."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.runoff_increment(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sorts = [line for line in plan.splitlines() if "Sort [cell_id" in line]
    assert sum("step#" in line for line in sorts) == 1
    assert "ShuffledHashJoin" in plan


def test_lags_pair_places(spark):
    """Stations of one place are not paired one by one, and the table is that of all pairs."""
    rng = random.Random(6)
    rows = [(b, k, float(rng.randrange(6)), float(rng.randrange(5)), rng.uniform(0, 50)) for b in range(2) for k in range(90)]
    want: dict = defaultdict(list)
    for i, (b, _, x, y, v) in enumerate(rows):
        for b2, _, x2, y2, v2 in rows[:i]:
            if b == b2 and (h := math.hypot(x - x2, y - y2)) < 4:
                want[b, int(h // 1.0)].append((h, (v - v2) ** 2 / 2))
    table = V.lag_table(spark.createDataFrame(rows, "bin long, station int, x_m double, y_m double, value double"), 1.0, 4)
    got = {(r["bin"], r["lag"]): r for r in table.collect()}
    assert got.keys() == want.keys()
    for key, pairs in want.items():
        assert got[key]["pairs"] == len(pairs)
        assert got[key]["distance_m"] == pytest.approx(sum(p[0] for p in pairs) / len(pairs))
        assert got[key]["semivariance"] == pytest.approx(sum(p[1] for p in pairs) / len(pairs))
    crowd = spark.range(40_000).selectExpr("0L bin", "id station", "cast(id % 3 as double) x_m", "0.0D y_m", "cast(id % 7 as double) value")
    assert sum(r["pairs"] for r in V.lag_table(crowd, 1.0, 4).collect()) == 40_000 * 39_999 // 2


@pytest.mark.parametrize("most", [200_000, 3])
def test_idw_of_more_stations_than_go_out_at_once(spark, most):
    rng = random.Random(7)
    net = [(k, float(rng.randrange(5)), float(rng.randrange(4)), rng.uniform(-3, 9)) for k in range(40)]
    at = [(k, k % 7 * 0.75, k % 5 * 1.0) for k in range(35)]
    got = {r[0]: r[1] for r in T.idw(spark.createDataFrame(at, "cell_id long, x_m double, y_m double"), spark.createDataFrame(net, "station int, x_m double, y_m double, rate double"), 2.0, 0.5, most).collect()}
    for cell, x, y in at:
        d = [(math.hypot(x - sx, y - sy), v) for _, sx, sy, v in net]
        here = [v for h, v in d if h == 0]
        w = [1 / max(h, 0.5) ** 2 for h, _ in d]
        assert got[cell] == pytest.approx(here[0] if here else sum(a * v for a, (_, v) in zip(w, d, strict=True)) / sum(w))


def test_only_cells_around_the_features_are_joined(spark):
    """A far part of the grid does not travel, and edges are weighed by compiled expressions, one row each."""
    cells = spark.range(3000).selectExpr("id cell_id", "cast(id % 10 as double) x", "cast(id div 10 as double) y")
    box = spark.createDataFrame([(1, '{"type":"Polygon","coordinates":[[[1.2,2.1],[4.9,2.1],[4.9,5.3],[1.2,5.3],[1.2,2.1]]]}', "Polygon")], "feature_id long, geometry string, geom_type string")
    p = Y.weighted_cells(Y.shapes(box), cells, 1.0, 1.0, 4.0, "exact")
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "lambda" not in plan
    got = {r["cell_id"]: r["w"] for r in p.collect()}
    lap = lambda c, a, b: max(0.0, min(c + 0.5, b) - max(c - 0.5, a))
    want = {y * 10 + x: w for x in range(10) for y in range(300) if (w := lap(x, 1.2, 4.9) * lap(y, 2.1, 5.3)) > 0}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
