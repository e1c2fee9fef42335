"""Files, state, streams and whole runs."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia import cli, config
from pluvia.plans import state
from pluvia.simulate import simulate
from pluvia.sources import domain, files, geotiff, netcdf
from pluvia.streaming import stations as streams


def _dataset() -> netcdf.Dataset:
    ds = netcdf.Dataset({"time": 2, "lat": 2, "lon": 3}, {"title": "t"})
    ds.variables["rain"] = (("time", "lat", "lon"), np.array([[[1, 2, -9999], [4, 5, 6]], [[7, 8, 9], [0, 1, 2]]], "f4"), {"_FillValue": -9999.0})
    ds.variables["lat"] = (("lat",), np.array([45.0, 44.5]), {"units": "degrees_north"})
    return ds


def test_netcdf_round_trip():
    back = netcdf.parse(netcdf.build(_dataset()))
    assert back.dims == {"time": 2, "lat": 2, "lon": 3} and back.attrs == {"title": "t"}
    dims, values, attrs = back.variables["rain"]
    assert dims == ("time", "lat", "lon") and values[1, 0, 2] == 9 and np.isnan(netcdf.decoded(values, attrs)[0, 0, 2])
    assert back.variables["lat"][2] == {"units": "degrees_north"}
    with pytest.raises(ValueError):
        netcdf.parse(b"noise")


def test_netcdf_source(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(netcdf.build(_dataset()))
    spark.dataSource.register(netcdf.NetcdfSource)
    a = spark.read.format("netcdf").option("path", str(tmp_path / "a.nc")).option("variable", "rain").load()
    b = netcdf.read_files(spark, str(tmp_path), "rain").drop("file")
    assert a.count() == 12 and a.where("value is null").count() == 1
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_station_files_and_stream(spark, tmp_path):
    head = "WEATHER_STATION_ID,ISO_8601_TIMESTAMP,LONGITUDE,LATITUDE,RAINRATE_VALUE\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(head + "A,2024-01-01T00:00:00Z,10,45,2\nA,2024-01-01T00:05:00Z,10,45,4\nB,2024-01-01 00:01:00,11,45,NaN\n")
    (tmp_path / "in/b.csv").write_text(head + "B,2024-01-01T03:00:00Z,11,45,1\n")
    assert files.read_stations(spark, str(tmp_path / "in")).where("rate is not null and ts is not null").count() == 3
    s = streams.binned_stream(files.stream_stations(spark, str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("bins").collect()
    assert [(r["station"], r["rate"], r["n"]) for r in got if r["station"] == "A"] == [("A", 3.0, 2)]


def test_features_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "z", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [0, 2], [0, 0]]]}, "properties": {"name": "Z", "n": 3}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"id": "p"}}]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    f = files.rings(files.read_features(spark, str(tmp_path / "f.json"))).orderBy("idx").collect()
    assert [r["feature_id"] for r in f] == ["z", "p"] and f[0]["ring"][:4] == [0.0, 0.0, 4.0, 0.0] and f[0]["x1"] == 4.0 and f[1]["ring"] is None
    files.write_features(files.read_features(spark, str(tmp_path / "f.json")), str(tmp_path / "out"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x["geometry"]["type"] for x in lines] == ["Polygon", "Point"] and lines[0]["properties"]["n"] == 3


def test_configuration():
    c = config.load(None, rain={"select": "nearest"}, model={"dt_s": 60.0})
    assert c["rain"]["select"] == "nearest" and c["rain"]["weight"] == 1.0 and config.DEFAULTS["model"]["dt_s"] == 5.0
    assert config.output_variables("all") == config.VARIABLES
    for bad in ([], ["x"], [1]):
        with pytest.raises(ValueError):
            config.output_variables(bad)


def test_whole_run_conserves_water(spark, tmp_path):
    cells = [(4 * r + c, r, c, 10 + 0.01 * c, 45 - 0.01 * r, float(20 - 4 * r - c), 80.0, False) for r in range(4) for c in range(4)]
    grid = spark.createDataFrame(cells, "cell_id long, r int, c int, x double, y double, dem double, cn double, channel boolean")
    steps = spark.range(12).select(F.col("id").cast("int").alias("step"), F.timestamp_seconds(1704067200 + (F.col("id") + 1) * 600).alias("t"))
    rain = grid.select(F.lit("radar").alias("source"), F.lit(0).alias("k"), F.timestamp_seconds(F.lit(1704067200)).alias("t"), "cell_id", F.lit(90.0).alias("rate"))
    cfg = config.load(None, model={"dt_s": 600.0, "particle_vol_m3": 5000.0}, output={"save_every_s": 3600.0})
    run = simulate(grid, rain, steps, cfg)
    assert sorted(r[0] for r in run.results.select("step").distinct().collect()) == [5, 11]
    q = run.report.first()
    assert q["numerical_ok"] and q["hydrological_ok"] and q["runoff_m3"] > 0
    area = {r["cell_id"]: r["area_m2"] for r in grid.select("cell_id", __import__("pluvia.functions.scalars", fromlist=["x"]).sphere_cell_area(F.col("y"), 0.01, 0.01).alias("area_m2")).collect()}
    stored = sum(r["flood_depth"] * area[r["cell_id"]] for r in run.results.where("step = 11").collect())
    last = run.balance.orderBy(F.desc("step")).first()
    assert stored == pytest.approx(last["stored_m3"], rel=1e-6)
    state.save(str(tmp_path / "s"), run.cells, run.parcels, {"elapsed_s": 7200})
    again, parcels, scalars = state.load(spark, str(tmp_path / "s"), 16)
    assert scalars == {"elapsed_s": 7200} and again.count() == 16 and parcels.count() == run.parcels.count()
    with pytest.raises(ValueError):
        state.load(spark, str(tmp_path / "s"), 17)
    # a run in two pieces is the whole run
    cfg["output"]["save_every_s"] = 600.0
    whole = simulate(grid, rain, steps, cfg)
    first = simulate(grid, rain, steps.where("step < 5"), cfg)
    s = first.state_at(4, 600.0)
    state.save(str(tmp_path / "half"), s.cells, s.parcels, s.scalars)
    second = simulate(grid, rain, steps.where("step >= 5"), cfg, state.read(spark, str(tmp_path / "half"), 16))
    for table, keys in (("results", ["step", "cell_id"]), ("balance", ["step"])):
        a = getattr(whole, table).where("step >= 5").orderBy(*keys).toPandas()
        b = getattr(second, table).select(*a.columns).orderBy(*keys).toPandas()
        skip = {"flood_depth_max", "inundation_mask_max"}  # maxima are of the run
        for c in a.columns:
            if c not in skip:
                assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True) if a[c].dtype.kind in "fiO" and c != "t" else (a[c] == b[c]).all(), c
    with pytest.raises(ValueError):
        simulate(grid, rain, steps, config.load(None, model={"dt_s": 60.0}), s)
    # the literal clock gives the same
    cfg["model"]["routing"] = "supersteps"
    for literal, first in ((simulate(grid, rain, steps, cfg), 0), (simulate(grid, rain, steps.where("step >= 5"), cfg, s), 5)):
        for table, keys in (("results", ["step", "cell_id"]), ("balance", ["step"])):
            a = getattr(whole, table).where(F.col("step") >= first).orderBy(*keys).drop("t", "flood_depth_max", "inundation_mask_max").toPandas()
            b = getattr(literal, table).select(*a.columns).orderBy(*keys).toPandas()
            assert np.allclose(a.to_numpy(float), b.to_numpy(float), equal_nan=True)
        assert sorted(map(tuple, literal.outflow.where("n > 0").select("node", "step", "n").collect())) == sorted(map(tuple, whole.outflow.where(F.col("step") >= first).select("node", "step", "n").collect()))


def test_sources_of_the_configuration(spark):
    c = config.load(None, rain={"sources": {"a": 0.5, "b": {"kind": "scalar", "value": 3, "weight": 1}, "c": {"path": "x.nc"}}, "select": "nearest"})
    s = config.rain_sources(c)
    assert s["a"]["weight"] == 0.5 and s["a"]["select"] == "nearest" and s["c"]["weight"] == 0.0 and s["b"]["kind"] == "scalar"
    for bad in ({"kind": "scalar"}, {"kind": "x"}, {"kind": "netcdf"}):
        with pytest.raises(ValueError):
            config.rain_sources(config.load(None, rain={"sources": {"z": bad}}))


def _axes(ny=4, nx=5):
    return domain.Axes(10 + 0.01 * np.arange(nx), 45 - 0.01 * np.arange(ny), "longitude", "latitude", "crs", {"grid_mapping_name": "latitude_longitude", "epsg_code": "EPSG:4326"})


def test_domain_and_rain_files(spark, tmp_path):
    axes = _axes()
    rows = [(r, c, None if (r, c) == (1, 1) else float(40 - 5 * r - c), 1 if c < 4 else 64, 70.0, (r + c) % 3 == 0) for r in range(4) for c in range(5)]
    cells = spark.createDataFrame(rows, "r int, c int, dem double, d8 int, cn double, channel boolean")
    path = str(tmp_path / "d.nc")
    domain.write_domain(cells, path, axes)
    names = {"x": "longitude", "y": "latitude"}
    back, axes2 = domain.read_domain(spark, path, names)
    assert axes2.mapping == "crs" and axes2.mapping_attrs["epsg_code"] == "EPSG:4326" and np.allclose(axes2.y, axes.y)
    got = {(r["r"], r["c"]): r for r in back.collect()}
    assert len(got) == 20 and not got[1, 1]["active"] and got[1, 1]["d8"] == 0 and got[1, 1]["cn"] == 0 and got[2, 4]["dem"] == 26.0 and got[2, 4]["d8"] == 64
    assert got[0, 0]["channel"] and not got[0, 1]["channel"] and got[3, 0]["area_m2"] == pytest.approx(got[3, 4]["area_m2"])
    with pytest.raises(ValueError):
        domain.read_domain(spark, path)  # the axes have other names
    rates = back.select(F.lit(0).alias("k"), "r", "c", (F.col("r") * 10.0 + F.col("c")).alias("rate")).unionByName(back.where("c > 0").select(F.lit(1).alias("k"), "r", "c", F.lit(2.0).alias("rate")))
    hours = [1087000.0, 1087000.25]
    domain.write_rain(rates, str(tmp_path / "r.nc"), axes, hours)
    rain = domain.read_rain(spark, str(tmp_path / "r.nc"), "radar", back)
    seen = {(r["k"], r["cell_id"]): r for r in rain.collect()}
    assert len(seen) == 40 and seen[0, 17]["rate"] == 32.0 and seen[1, 5]["rate"] is None
    assert (seen[1, 6]["t"] - seen[0, 6]["t"]).total_seconds() == 900.0
    cfg = config.load(None, rain={"sources": {"r": {"kind": "netcdf", "path": str(tmp_path / "r.nc"), "weight": 1}, "s": {"kind": "scalar", "value": 4, "weight": 0.5}, "off": {"path": "nowhere"}}})
    assert domain.configured_rain(spark, back, cfg).groupBy("source").count().orderBy("source").collect() == [("r", 40), ("s", 20)]
    one = spark.read.format("netcdf").option("path", str(tmp_path / "r.nc")).option("variable", "rain_rate").option("time", 1).load()
    assert one.count() == 20 and one.where("t <> 1").count() == 0
    for option, value in (("time", 2), ("variable", "none")):
        with pytest.raises(Exception):  # noqa: B017  raised by Spark's own planner
            spark.read.format("netcdf").option("path", str(tmp_path / "r.nc")).option("variable", "rain_rate").option(option, value).load().count()


def test_rain_schema(tmp_path):
    def broken(**change):
        ds = netcdf.Dataset({"time": 1, "latitude": 1, "longitude": 1})
        units = {"time": "hours since 1900-01-01 00:00:0.0", "latitude": "degrees_north", "longitude": "degrees_east", "rain_rate": "mm h-1"} | change
        for n in ("time", "latitude", "longitude"):
            ds.variables[n] = ((n,), np.zeros(1), {"units": units[n]})
        ds.variables["crs"] = ((), np.array(0, "i4"), {})
        ds.variables["rain_rate"] = (("time", "latitude", "longitude"), np.zeros((1, 1, 1), "f4"), {"units": units["rain_rate"], "grid_mapping": units.get("crs", "crs")})
        if change.get("drop"):
            del ds.variables[change["drop"]]
        path = str(tmp_path / "x.nc")
        (tmp_path / "x.nc").write_bytes(netcdf.build(ds))
        domain.check_rain(*netcdf.opened(path), domain.RAIN)

    broken()
    for bad in ({"time": "days since 2000-01-01"}, {"latitude": "m"}, {"longitude": ""}, {"rain_rate": "mm"}, {"crs": "other"}, {"drop": "latitude"}, {"drop": "rain_rate"}):
        with pytest.raises(ValueError):
            broken(**bad)


def test_rasters(spark, tmp_path):
    v = np.arange(12, dtype="f4").reshape(3, 4)
    v[1, 2] = -9999
    r = geotiff.Raster(v, 10.005, 44.995, 0.01, -0.01, -9999.0, 4326)
    back = geotiff.parse(geotiff.build(r))
    assert np.array_equal(back.values, v) and (back.epsg, back.nodata) == (4326, -9999.0) and back.x0 == pytest.approx(10.005) and back.dy == pytest.approx(-0.01)
    (tmp_path / "t").mkdir()
    for name, shift in (("b.tif", 1), ("a.tif", 0)):
        (tmp_path / "t" / name).write_bytes(geotiff.build(geotiff.Raster(v + shift, 10.005, 44.995, 0.01, -0.01, -9999.0 + shift, 4326)))
    d = geotiff.read_rasters(spark, str(tmp_path / "t"))
    assert d.count() == 24 and d.where("value is null").count() == 2 and d.where("k = 1 and r = 0 and c = 3").first()["value"] == 4.0
    with pytest.raises(ValueError):
        geotiff.parse(b"noise---")


def test_build_domain(spark, tmp_path):
    v = np.add.outer(-10.0 * np.arange(6), -np.arange(8)).astype("f8") + 100
    (tmp_path / "dem.tif").write_bytes(geotiff.build(geotiff.Raster(v, 10.0, 45.0, 0.1, -0.1, None, 4326)))
    (tmp_path / "cn.tif").write_bytes(geotiff.build(geotiff.Raster(np.full((6, 8), 60, "i4"), 10.0, 45.0, 0.1, -0.1)))
    cells, axes = domain.build_domain(spark, str(tmp_path / "dem.tif"), cn=str(tmp_path / "cn.tif"))
    got = {(r["r"], r["c"]): r for r in cells.collect()}
    assert len(got) == 48 and got[2, 3]["dem"] == 77.0 and got[2, 3]["d8"] in (2, 4) and got[5, 7]["d8"] == 0 and got[0, 0]["cn"] == 60.0
    small, axes = domain.build_domain(spark, str(tmp_path / "dem.tif"), box=(10.15, 44.65, 10.55, 44.95), resolution=(0.05,))
    assert (len(axes.x), len(axes.y)) == (7, 5) and small.count() == 35
    at = {(r["r"], r["c"]): r["dem"] for r in small.collect()}
    assert at[1, 1] == pytest.approx((v[1, 2] + v[1, 3] + v[2, 2] + v[2, 3]) / 4) and at[0, 0] == pytest.approx(v[1, 2])
    with pytest.raises(ValueError):
        domain.build_domain(spark, str(tmp_path / "dem.tif"), box=(0.0, 0.0, 1.0, 1.0))


def test_commands(spark, tmp_path, capsys):
    axes = _axes()
    v = np.add.outer(-5.0 * np.arange(4), -np.arange(5)).astype("f8") + 40
    (tmp_path / "dem.tif").write_bytes(geotiff.build(geotiff.Raster(v, 10.0, 45.0, 0.01, -0.01, None, 4326)))
    (tmp_path / "cn.tif").write_bytes(geotiff.build(geotiff.Raster(np.full((4, 5), 80, "i4"), 10.0, 45.0, 0.01, -0.01)))
    cli.main(["make-domain", "--dem", f"{tmp_path}/dem.tif", "--cn", f"{tmp_path}/cn.tif", "--out", f"{tmp_path}/grid"])
    (tmp_path / "s.csv").write_text("WEATHER_STATION_ID,ISO_8601_TIMESTAMP,LONGITUDE,LATITUDE,RAINRATE_VALUE\n" + "".join(f"S{k},2024-01-01T00:{m:02d}:00Z,{10 + 0.01 * k},{45 - 0.01 * k},{60 + k}\n" for k in range(3) for m in (0, 20)))
    cli.main(["stations", "--records", f"{tmp_path}/s.csv", "--domain", f"{tmp_path}/grid", "--out", f"{tmp_path}/rain"])
    rain = spark.read.parquet(f"{tmp_path}/rain")
    assert rain.select("k").distinct().count() == 2 and rain.where("rate between 59 and 63").count() == 40
    (tmp_path / "dbz").mkdir()
    (tmp_path / "dbz/1.tif").write_bytes(geotiff.build(geotiff.Raster(np.full((4, 5), 40.0, "f4"), 10.0, 45.0, 0.01, -0.01)))
    cli.main(["radar", "--input-dir", f"{tmp_path}/dbz", "--domain", f"{tmp_path}/grid", "--out", f"{tmp_path}/radar.nc", "--start", "2024-01-01T00:00:00Z", "--step-s", "600"])
    assert netcdf.parse((tmp_path / "radar.nc").read_bytes()).variables["rain_rate"][1][0, 0, 0] == pytest.approx((10**4 / 200) ** (1 / 1.6), rel=1e-5)
    model = netcdf.Dataset({"time": 2, "lat": 4, "lon": 5})
    model.variables["time"] = (("time",), np.array([1087000.0, 1087001.0]), {"units": "hours since 1900-01-01 00:00:0.0"})
    model.variables["lat"], model.variables["lon"] = (("lat",), axes.y, {}), (("lon",), axes.x, {})
    model.variables["DELTA_RAIN"] = (("time", "lat", "lon"), np.full((2, 4, 5), 6.0, "f4"), {})
    for name in ("m1.nc", "m2.nc"):
        (tmp_path / name).write_bytes(netcdf.build(model))
    cli.main(["model", "--inputs", f"{tmp_path}/m*.nc", "--domain", f"{tmp_path}/grid", "--out", f"{tmp_path}/model", "--hours", "2"])
    assert spark.read.parquet(f"{tmp_path}/model").where("rate = 3").count() == 40
    (tmp_path / "c.json").write_text(json.dumps({"model": {"T_s": 1800.0, "dt_s": 300.0}, "output": {"save_every_s": 900.0}, "restart": {"every": 3}}))
    cli.main(["simulate", "--grid", f"{tmp_path}/grid", "--rain", f"{tmp_path}/rain", "--config", f"{tmp_path}/c.json", "--start", "2024-01-01T00:00:00Z", "--out", f"{tmp_path}/run", "--report", f"{tmp_path}/report.json", "--metrics", f"{tmp_path}/metrics.json"])
    assert sorted(p.name for p in (tmp_path / "run/restart").iterdir()) == ["step=2", "step=5"]
    assert json.loads((tmp_path / "report.json").read_text())["status"]["numerical_ok"]
    metrics = json.loads((tmp_path / "metrics.json").read_text())
    assert metrics["summary"]["spawned_particles"] > 0 and metrics["summary"]["particle_hops"] > 0 and len(metrics["per_step_samples"]) == 6
    cli.main(["simulate", "--grid", f"{tmp_path}/grid", "--rain", f"{tmp_path}/rain", "--config", f"{tmp_path}/c.json", "--restart", f"{tmp_path}/run/restart/step=2", "--start", "2024-01-01T00:00:00Z", "--T-s", "900", "--out", f"{tmp_path}/rest"])
    last = lambda p: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{p}/results").where("step = 5").select("cell_id", F.round("flood_depth", 9), F.round("risk_index", 9)).collect()))
    assert last("run") == last("rest")
    grid = spark.read.parquet(f"{tmp_path}/grid")
    results = spark.read.parquet(f"{tmp_path}/run/results")
    domain.write_results(results, f"{tmp_path}/out.nc", axes, grid, config.load(f"{tmp_path}/c.json"))
    back = netcdf.parse((tmp_path / "out.nc").read_bytes())
    assert back.variables["flood_depth"][1].shape == (2, 4, 5) and back.variables["flood_depth_max"][1].shape == (4, 5) and back.variables["flood_depth"][2]["_FillValue"] == -9999.0
    want = {r["cell_id"]: r["flood_depth"] for r in results.where("step = 5").collect()}
    assert np.allclose(back.variables["flood_depth"][1][1].ravel(), [want[k] for k in range(20)], rtol=1e-6)
    zone = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[9.9, 44.9], [10.2, 44.9], [10.2, 45.1], [9.9, 45.1]]]}, "properties": {"name": "all", "n": 3}}
    (tmp_path / "z.json").write_text(json.dumps({"type": "FeatureCollection", "features": [zone, {"type": "Feature", "id": 7, "geometry": None, "properties": None}]}))
    for where, out in ((f"{tmp_path}/out.nc", "z1.json"), (f"{tmp_path}/run/results", "z2.json")):
        cli.main(["zones", "--features", f"{tmp_path}/z.json", "--results", where, "--domain", f"{tmp_path}/grid", "--out", f"{tmp_path}/{out}", "--variables", "flood_depth,risk_index,flood_depth_max"])
        z = json.loads((tmp_path / out).read_text())["features"]
        assert z[0]["properties"]["mode"] == "area" and z[0]["properties"]["n"] == 3 and z[0]["properties"]["depth_max"] == pytest.approx(max(want.values()), rel=1e-5) and z[1]["id"] == 7
    assert '"skipped": 1' in capsys.readouterr().out
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [{"name": "wet", "when": "depth_max > 0", "channels": ["rest"], "template": "{feature}: {actual}"}], "channels": {"rest": ["name"]}}))
    for _ in range(2):
        cli.main(["alerts", "--features", f"{tmp_path}/z2.json", "--rules", f"{tmp_path}/rules.json", "--outbox", f"{tmp_path}/outbox", "--sent", f"{tmp_path}/sent"])
    assert spark.read.parquet(f"{tmp_path}/outbox").count() == 1 and spark.read.parquet(f"{tmp_path}/outbox").first()["message"].startswith("all: ")
    assert '"deduplicated": 1' in capsys.readouterr().out
    cli.main(["map", "--domain", f"{tmp_path}/grid", "--results", f"{tmp_path}/run/results", "--out", f"{tmp_path}/m.png"])
    assert (tmp_path / "m.png").read_bytes()[:4] == b"\x89PNG"
    (tmp_path / "n.json").write_text(json.dumps({"domains": [{"name": "Child 1", "parent": "top", "grid": f"{tmp_path}/grid", "rain": f"{tmp_path}/rain", "config": f"{tmp_path}/c.json"}, {"name": "top", "grid": f"{tmp_path}/grid", "rain": f"{tmp_path}/rain", "config": f"{tmp_path}/c.json"}]}))
    cli.main(["nested", "--config", f"{tmp_path}/n.json", "--out", f"{tmp_path}/nest", "--start", "2024-01-01T00:00:00Z"])
    assert (tmp_path / "nest_child-1/results").is_dir() and (tmp_path / "nest_top/results").is_dir()


def test_runoff_stream_equals_the_table(spark, tmp_path):
    from pluvia.operators import rain as R
    from pluvia.streaming.runoff import runoff_stream

    rows = [(c, 60.0 + 10 * c, s, float((7 * s + c) % 9)) for c in range(4) for s in range(6)]
    schema = "cell_id long, cn double, step int, rain_mm double"
    source = str(tmp_path / "in")
    q = None
    for lo in (0, 2, 4):
        spark.createDataFrame([r for r in rows if lo <= r[2] < lo + 2] + [r for r in rows if r[2] == lo - 1], schema).coalesce(1).write.mode("append").parquet(source)
        if q is None:
            q = runoff_stream(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("runoff").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
    q.stop()
    d = spark.createDataFrame(rows, schema)
    grid = d.select("cell_id", "cn", F.lit(True).alias("active")).distinct()
    want = R.runoff_steps(d.select("step", "cell_id", "rain_mm"), grid)
    key = ["cell_id", "step"]
    a, b = (x.select("cell_id", "step", "p_cum_mm", "q_cum_mm", "dq_mm").orderBy(*key).toPandas() for x in (spark.table("runoff"), want))
    assert np.allclose(a.to_numpy(float), b.to_numpy(float))


def test_senders_note_failures(spark, tmp_path):
    d = spark.createDataFrame([("a", "rest", "m"), ("b", "sms", "m"), ("c", "email", "m")], "alert_id string, channel string, message string")

    def down(_):
        raise OSError("down")

    streams.senders({"rest": lambda m: None, "sms": down}, str(tmp_path / "o"))(d, 0)
    assert {r["alert_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {"a": "sent", "b": "failed: down", "c": "dry run"}
