"""SQL functions and reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pluvia import config, report
from pluvia.functions import registry
from pluvia.functions import scalars as S
from pluvia.operators import products as P


def test_sql_functions_equal_column_functions(spark):
    registry.register(spark)
    d = spark.createDataFrame([(p, cn, v) for p in (0.0, 30.0, 90.0) for cn in (0.0, 55.0, 100.0) for v in (0.2, 0.7, 2.5, 9.0)], "p double, cn double, v double")
    d.createOrReplaceTempView("cases")
    a = spark.sql("SELECT round(scs_runoff(p, cn), 9), round(dbz_to_rain(p), 9), risk_class(v) FROM cases").collect()
    b = d.select(F.round(S.scs_runoff_mm(F.col("p"), F.col("cn")), 9), F.round(S.dbz_to_rain(F.col("p")), 9), S.risk_class(F.col("v"))).collect()
    assert list(map(tuple, a)) == list(map(tuple, b))
    assert spark.sql("SELECT d8_offset(8).dr, d8_offset(8).dc, d8_offset(3)").first()[:] == (1, -1, None)
    assert spark.sql("SELECT cf_hours(TIMESTAMP '1900-01-02 00:00:00')").first()[0] == 24.0


def test_reports(spark):
    grid = spark.createDataFrame([(0, True, 10.0), (1, False, 99.0)], "cell_id long, active boolean, area_m2 double")
    runoff = spark.createDataFrame([(0, 10.0, 4.0, 10.0), (1, 10.0, 6.0, 10.0)], "step int, rain_mm double, dq_mm double, area_m2 double")
    stored = spark.createDataFrame([(0, 0.04), (1, 0.08)], "step int, vol double")
    b = P.volume_balance(runoff, spark.createDataFrame([(1, 0.02)], "step int, vol double"), stored)
    r = json.loads(report.run_report(grid, b, P.quality_report(b), config.load(), 1.5))
    assert r["domain"]["active_cells"] == 1 and r["time"]["steps"] == 2 and r["status"]["numerical_ok"]
    assert report.step_log(b).orderBy("step").first()["line"].startswith("mass_balance rain_m3=0.100")


def test_the_balance_can_be_wrong(spark):
    runoff = spark.createDataFrame([(0, 10.0, 4.0, 1000.0), (1, 10.0, 6.0, 1000.0)], "step int, rain_mm double, dq_mm double, area_m2 double")
    none = spark.createDataFrame([], "step int, vol double")
    report_ = lambda *stored: P.quality_report(P.volume_balance(runoff, none, spark.createDataFrame(list(enumerate(stored)), "step int, vol double"))).first()
    assert report_(4.0, 10.0)["numerical_ok"] and not report_(4.0, 9.0)["numerical_ok"]
    assert report_(4.0, 9.0)["mass_error_max_m3"] == 1.0
    assert P.quality_report(P.volume_balance(runoff, none)).first()["numerical_ok"] is None


def test_projections_of_known_places(spark):
    d = spark.createDataFrame([(14.25, 40.85, 32633), (-70.0, -33.5, 32719)], "lon double, lat double, epsg int")
    x, y = S.utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    a, b = S.equal_area(F.col("lon"), F.col("lat"))
    got = d.select(x, y, a, b).collect()
    # on the central meridian x is the false easting; the quarter meridian is 10001965.729 m
    assert 436000 < got[0][0] < 437000 and 4522000 < got[0][1] < 4523000
    assert 406000 < got[1][0] < 408000 and 6292000 < got[1][1] < 6294000
    pole = spark.range(1).select(S.utm(F.lit(15.0), F.lit(89.999999999), F.lit(32633))[1]).first()[0]
    assert abs(pole / 0.9996 - 10001965.729) < 0.01
    whole = spark.range(1).select(S.ellipsoid_cell_area(F.lit(90.0), 360.0, 180.0)).first()[0]
    assert abs(whole / 5.10065621724e14 - 1) < 1e-9
    assert abs(got[0][2] - 14.25 / 180 * 17367530.445) < 0.01


def test_texts_paths_and_units():
    import pytest

    assert S.cf_units("hours since 1900-01-01 00:00:0.0") == (3600.0, -2208988800)
    assert S.cf_units("days since 1970-01-02")[1] == 86400
    with pytest.raises(ValueError):
        S.cf_units("fortnights since then")
    assert S.rotated_path("a/b.nc", 3) == "a/b_0003.nc" and S.rotated_path("a.b/c", 3) == "a.b/c_0003"
    assert S.tagged_path("a/b.nc", "Campi Flegrei!") == "a/b_campi-flegrei.nc" and S.tagged_path("a", "") == "a"
    assert S.title("flood_depth", "m", "2024") == "Flood depth [m] - 2024"
    assert S.axis_attributes("Latitude")["units"] == "degrees_north" and S.axis_attributes("t") == {}
    assert S.crs_attributes({"epsg_code": "EPSG:4326"}) == {"grid_mapping_name": "unknown", "epsg_code": "EPSG:4326"}


def test_zoneless_times_do_not_follow_the_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        d = spark.createDataFrame([("2024-01-01T00:00:00",), ("2024-01-01",), ("2024-01-01T00:00:00.5Z",), ("2024-01-01 09:00:00+09:00",)], "s string")
        assert [r[0] for r in d.select(F.unix_seconds(S.iso_timestamp(F.col("s")))).collect()] == [1704067200] * 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_percentiles_by_passes_equal_the_exact_ones(spark):
    d = spark.range(3000).select((F.col("id") % 3).cast("int").alias("step"), F.when(F.col("id") % 7 != 0, F.pow(F.rand(5) * 10, 5.0)).otherwise(0.0).alias("a"), F.when(F.col("id") % 11 != 0, F.randn(7)).alias("b"))
    d = d.unionByName(spark.createDataFrame([(9, None, 2.0), (9, None, 2.0)], "step int, a double, b double")).cache()
    one = P.normalized(d, ["a", "b"], by="step")
    two = P.normalized(d, ["a", "b"], by="step", exact_rows=0)
    key = lambda r: (r["step"], r["a"] is None, r["a"] or 0, r["b"] is None, r["b"] or 0)
    for x, y in zip(sorted(one.collect(), key=key), sorted(two.collect(), key=key), strict=True):
        for c in ("a_norm", "b_norm"):
            assert (x[c] is None) == (y[c] is None) and (x[c] is None or abs(x[c] - y[c]) < 1e-9)
    assert P.colour_top(d, "a").first()[0] > 0
