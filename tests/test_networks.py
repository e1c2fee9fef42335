"""Variograms, kriging from the nearest stations and streams that carry parcels, against plain versions and batch runs."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia import report
from pluvia.operators import flow as L
from pluvia.operators import rain as R
from pluvia.operators import routing as B
from pluvia.operators import stations as T
from pluvia.operators import variogram as V
from pluvia.streaming.run import RAIN, RunStream


def test_lags_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(b, k, float(x), float(y), None if k == 7 else float(v)) for b in (0, 1) for k, (x, y, v) in enumerate(rng.uniform(-50, 50, (60, 3)))]
    got = {(r["bin"], r["lag"]): r for r in V.lag_table(spark.createDataFrame(rows, "bin long, station int, x_m double, y_m double, value double"), 5.0, 6).collect()}
    want = {}
    for b in (0, 1):
        p = [r for r in rows if r[0] == b and r[4] is not None]
        for i in range(len(p)):
            for j in range(i):
                h = np.hypot(p[i][2] - p[j][2], p[i][3] - p[j][3])
                if h < 30:
                    want.setdefault((b, int(h // 5)), []).append((h, (p[i][4] - p[j][4]) ** 2 / 2))
    assert set(got) == set(want)
    for key, pairs in want.items():
        h, g = np.array(pairs).T
        assert (got[key]["pairs"], got[key]["distance_m"], got[key]["semivariance"]) == pytest.approx((len(h), h.mean(), g.mean()))


@pytest.mark.parametrize("model", list(V.MODELS))
def test_ranges_are_found_again(model):
    h = np.linspace(500, 12_000, 14)
    fit = V.fitted(h, 0.3 + 2.0 * V.MODELS[model](h / 6000), np.full(14, 50))
    assert fit.model == model and fit.range_m == pytest.approx(6000, rel=0.02) and fit.sill == pytest.approx(2.0, rel=0.03) and fit.nugget == pytest.approx(0.3, abs=0.03)
    assert V.fitted(h, np.zeros(14), np.full(14, 50)) is None and V.fitted(h[:2], h[:2], np.ones(2)) is None


def _plain(net, values, at, model):
    n = len(net)
    a = np.ones((n + 1, n + 1))
    a[:n, :n], a[n, n] = model(np.hypot(*(net[:, None] - net[None]).transpose(2, 0, 1))), 0
    b = np.append(model(np.hypot(*(net - at).T)), 1.0)
    return np.linalg.solve(a, b)[:n] @ values


def test_kriging_of_the_nearest_equals_plain_systems(spark):
    rng = np.random.default_rng(12)
    net = np.concatenate([rng.normal(0, 30, (80, 2)), rng.uniform(-2000, 2000, (40, 2))])  # a cluster and scattered ones
    values = np.sin(net[:, 0] / 300) + rng.normal(0, 0.1, 120)
    at = np.concatenate([rng.uniform(-2500, 2500, (150, 2)), net[:5]])
    model = V.Variogram("spherical", 700.0, 1.0, 0.05)
    s = spark.createDataFrame([(4, float(x), float(y), float(v)) for (x, y), v in zip(net, values)], "bin long, x_m double, y_m double, value double")
    t = spark.createDataFrame([(4, k, float(x), float(y)) for k, (x, y) in enumerate(at)], "bin long, cell_id long, x_m double, y_m double")
    got = {r["cell_id"]: r["value"] for r in V.krige_nearest(t, s, {4: model}, 12).collect()}
    assert len(got) == len(at)
    for k, p in enumerate(at):
        near = np.argsort(np.hypot(*(net - p).T), kind="stable")[:12]
        assert got[k] == pytest.approx(_plain(net[near], values[near], p, model), abs=1e-5), k
    for k in range(5):
        assert got[150 + k] == pytest.approx(values[k], abs=1e-5)


def test_bins_of_any_number_of_stations(spark):
    rows = [(0, 1, 0.0, 0.0, 3.0), (1, 1, 0.0, 0.0, 2.0), (1, 2, 100.0, 0.0, 4.0), *((2, k, float(k % 7) * 50, float(k // 7) * 50, 5.0) for k in range(40)), (3, 1, 0.0, 0.0, None)]
    binned = spark.createDataFrame(rows, "bin long, station int, x_m double, y_m double, rate double")
    cells = spark.createDataFrame([(k, 13.0 * k, 7.0 * k) for k in range(20)], "cell_id long, x_m double, y_m double")
    got = {(r["bin"], r["cell_id"]): r["value"] for r in T.interpolated(binned, cells, 0.0).collect()}
    assert len(got) == 80 and all(got[0, k] == 3.0 for k in range(20)) and all(2 <= got[1, k] <= 4 for k in range(20))
    assert all(got[2, k] == pytest.approx(5.0, abs=1e-6) for k in range(20))  # a field without variance
    assert all(got[3, k] == 0.0 for k in range(20))


def test_two_hundred_thousand_stations_in_one_bin(spark):
    n = 200_000
    place = lambda k, salt: (F.pmod(F.xxhash64(F.lit(salt), k), F.lit(1_000_000)) / 10.0)
    s = spark.range(n).select(F.lit(0).cast("long").alias("bin"), F.col("id").alias("station"), place(F.col("id"), 1).alias("x_m"), place(F.col("id"), 2).alias("y_m"))
    s = s.withColumn("rate", 5 + 4 * F.sin(F.col("x_m") / 9000) * F.cos(F.col("y_m") / 7000))
    cells = spark.range(400).select(F.col("id").alias("cell_id"), (F.col("id") % 20 * 5000 + 2500.0).alias("x_m"), (F.floor(F.col("id") / 20) * 5000 + 2500.0).alias("y_m"))
    out = T.interpolated(s, cells).join(cells, "cell_id").withColumn("want", 5 + 4 * F.sin(F.col("x_m") / 9000) * F.cos(F.col("y_m") / 7000))
    r = out.agg(F.count("*").alias("n"), F.max(F.abs(F.col("value") - F.col("want"))).alias("err")).first()
    assert r["n"] == 400 and r["err"] < 0.1


def _water(spark):
    rows, cols = 5, 4
    grid = spark.createDataFrame([(r * cols + c, r, c, r * cols + c != 6, 60.0 + 5 * c, 10_000.0 + r) for r in range(rows) for c in range(cols)], "cell_id long, r int, c int, active boolean, cn double, area_m2 double")
    flow = spark.createDataFrame([(k, k + cols if k + cols < rows * cols else None) for k in range(rows * cols)], "cell_id long, ds_id long")
    travel = spark.createDataFrame([(k, 400.0 + 170.0 * (k % 5)) for k in range(rows * cols)], "node long, travel_s double")
    rain = [(k, s, float((k * 7 + s * 3) % 11)) for s in range(12) for k in range(rows * cols)]
    return grid, flow, travel, rain


def test_stream_with_parcels_equals_a_batch_run(spark, tmp_path):
    grid, flow, travel, rain = _water(spark)
    src = tmp_path / "src"
    src.mkdir()

    def put(name, rows):
        spark.createDataFrame(rows, RAIN).coalesce(1).write.parquet(str(tmp_path / name))
        for f in (tmp_path / name).glob("part-*.parquet"):
            f.rename(src / f"{name}.parquet")

    sink = RunStream(grid, flow, travel, str(tmp_path / "run"), 600.0, 5.0)

    def run():
        s = spark.readStream.schema(RAIN).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = s.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    put("a", rain[:70])  # ends in the midst of a step
    put("b", rain[70:110])
    run()
    put("c", rain[110:])
    run()  # again, from the checkpoint and the state
    sink(spark.createDataFrame(rain[110:150], RAIN), 3)  # rain of steps that are done comes once more, and
    sink.finish()

    steps = spark.range(12).select(F.col("id").cast("int").alias("step"))
    runoff = R.runoff_steps(spark.createDataFrame(rain, RAIN).select("step", "cell_id", "rain_mm"), grid)
    parcels = L.spawn(runoff.join(grid.select("cell_id", "area_m2"), "cell_id"), 5.0)
    whole = B.by_blocks(parcels, grid, flow, travel, 600.0, steps.where("step = 11"), steps, [11])
    rows = lambda df, *c: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*c).collect())
    cols = ("step", "cell_id", "rain_mm", "p_cum_mm", "q_cum_mm", "dq_mm")
    assert rows(sink.results("runoff"), *cols) == rows(runoff, *cols)
    assert rows(sink.results("outflow"), "node", "step", "n", "vol") == rows(whole.outflow, "node", "step", "n", "vol")
    assert rows(sink.results("placed").where("step = 11"), "node", "n", "vol") == rows(whole.placed, "node", "n", "vol")
    kept = spark.read.parquet(f"{tmp_path}/run/state/epoch={max(sink._epochs('state'))}/parcels")
    assert rows(kept, "cell_id", "tau", "n", "vol") == rows(whole.kept, "cell_id", "tau", "n", "vol")
    assert len(sink._epochs("state")) == 2


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    grid, flow, travel, rain = _water(spark)
    sink = RunStream(grid, flow, travel, str(tmp_path / "run"), 600.0, 5.0)
    sink(spark.createDataFrame(rain[:60], RAIN), 0)
    sink(spark.createDataFrame(rain[60:120], RAIN), 1)
    before = sorted(map(tuple, sink.results("runoff").collect()))
    sink(spark.createDataFrame(rain[60:120], RAIN), 1)
    assert sorted(map(tuple, sink.results("runoff").collect())) == before
    sink(spark.createDataFrame([], RAIN), 2)
    assert sorted(map(tuple, sink.results("runoff").collect())) == before


def test_times_of_stages(spark):
    spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count().collect()
    found = report.stage_times(spark)
    assert found and all(s["tasks"] > 0 and s["run_s"] >= 0 for s in found)
    some = [s for s in found if s["task_s"]]
    assert some and all(s["task_s"] == sorted(s["task_s"]) and len(s["task_s"]) == 4 for s in some)
    assert json.dumps(found)
