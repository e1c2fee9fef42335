"""Commands: ``python -m pluvia.cli <command> --help``.

simulate a run; make-domain from rasters; rain from stations, radar pictures or model output; zones (statistics of features);
alerts by rules; map.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia import config, maps, simulate
from pluvia.functions import scalars as S
from pluvia.operators import alerts as A
from pluvia.operators import geometry as Y
from pluvia.operators import grid as G
from pluvia.operators import products as P
from pluvia.operators import stations as T
from pluvia.plans import domains
from pluvia.plans.storage import cut
from pluvia.sources import domain as D
from pluvia.sources import files, geotiff, netcdf
from pluvia.streaming import delivery as O


def _spark() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def numbers(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(","))


def names(text: str) -> list[str]:
    """Names of a comma list, once each, in order; at least one."""
    out = list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))
    if not out:
        raise argparse.ArgumentTypeError("the list is empty")
    return out


def output_path(path: str, default: str = "rain_rate_merged.nc") -> str:
    """``path``, or the default name in it where it is a folder."""
    target = Path(path)
    if target.is_dir() or path.endswith("/") or not target.suffix:
        target.mkdir(parents=True, exist_ok=True)
        return str(target / default)
    target.parent.mkdir(parents=True, exist_ok=True)
    return path


def make_domain(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="make-domain", description="a domain from elevation, curve numbers, directions and a channel mask")
    p.add_argument("--dem", required=True)
    p.add_argument("--out", required=True, help="a .nc file, or a folder for Parquet")
    for name in ("cn", "d8", "mask"):
        p.add_argument(f"--{name}")
    for name, var in D.DOMAIN.items():
        p.add_argument(f"--{name.replace('_', '-')}-var", default=var)
    p.add_argument("--bbox", type=numbers, help="west,south,east,north")
    p.add_argument("--resolution", type=numbers, help="one step, or dx,dy")
    a = p.parse_args(argv)
    variables = {k: getattr(a, f"{k}_var") for k in D.DOMAIN}
    cells, axes = D.build_domain(_spark(), a.dem, a.cn, a.d8, a.mask, variables, a.bbox, a.resolution)
    if a.out.endswith(".nc"):
        D.write_domain(cells, a.out, axes)
    else:
        cells.write.mode("overwrite").parquet(a.out)


def _domain(spark: SparkSession, path: str) -> tuple[DataFrame, D.Axes]:
    if path.endswith(".nc"):
        return D.read_domain(spark, path)
    cells = spark.read.parquet(path)
    axis = lambda i, v: [r[1] for r in cells.select(i, v).distinct().orderBy(i).collect()]  # noqa: E731  an axis
    import numpy as np

    return cells, D.Axes(np.array(axis("c", "x")), np.array(axis("r", "y")))


def _save_rain(rates: DataFrame, out: str, axes: D.Axes, hours: list[float], cells: DataFrame, source: str) -> None:
    """``rates`` (k, cell_id, rate) as NetCDF or as a table of rain."""
    if out.endswith(".nc"):
        D.write_rain(rates.join(cells.select("cell_id", "r", "c"), "cell_id"), output_path(out), axes, hours)
    else:
        times = rates.sparkSession.createDataFrame([(k, h) for k, h in enumerate(hours)], "k int, h double").select("k", S.from_cf(F.col("h"), S.TIME_UNITS).alias("t"))
        rates.join(F.broadcast(times), "k").select(F.lit(source).alias("source"), "k", "t", "cell_id", "rate").write.mode("overwrite").parquet(out)


def station_rain(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="stations", description="rain of stations, binned and interpolated on a domain")
    p.add_argument("--records", required=True, help="CSV file or folder")
    p.add_argument("--domain", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--interval-s", type=int, default=900)
    p.add_argument("--buffer-m", type=float, default=0.0, help="cells farther from the stations' hull have no rain")
    p.add_argument("--variogram", default="best", choices=["best", "spherical", "exponential", "gaussian"])
    p.add_argument("--neighbours", type=int, default=32, help="stations that a cell's value is made from")
    a = p.parse_args(argv)
    spark = _spark()
    cells, axes = _domain(spark, a.domain)
    (lon, lat) = float(axes.x.mean()), float(axes.y.mean())
    epsg = spark.range(1).select(S.utm_epsg(F.lit(lon), F.lit(lat))).first()[0]
    metres = lambda d, x, y: d.withColumns(dict(zip(("x_m", "y_m"), S.utm(F.col(x), F.col(y), F.lit(epsg)), strict=True)))
    binned = metres(T.station_bins(files.read_stations(spark, a.records), a.interval_s), "lon", "lat")
    times = [(r["bin"], r["h"]) for r in binned.groupBy("bin").agg(F.min(S.cf_hours(F.col("t"))).alias("h")).orderBy("bin").collect()]  # bins of a run
    grid = metres(cells, "x", "y")
    outside = None
    if a.buffer_m > 0:
        spots = binned.select("x_m", "y_m").distinct().toPandas().to_numpy(float)  # a network
        grid = T.in_buffered_hull(grid, T.hull(spots), a.buffer_m)
        grid, outside = grid.where("inside"), grid.where("not inside")
    number = spark.createDataFrame([(b, k) for k, (b, _) in enumerate(times)], "bin long, k int")
    rates = T.interpolated(binned, grid, None, a.variogram, a.neighbours)
    if outside is not None:  # no rain there
        rates = rates.unionByName(outside.select("cell_id").join(F.broadcast(number.select("bin")), F.lit(True)).select("bin", "cell_id", F.lit(0.0).alias("value")))
    rates = rates.join(F.broadcast(number), "bin").select("k", "cell_id", F.col("value").alias("rate"))
    _save_rain(rates, a.out, axes, [h for _, h in times], cells, "stations")


def radar_rain(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="radar", description="rain rates of a folder of reflectivity rasters, by name in order of time")
    p.add_argument("--input-dir", required=True)
    p.add_argument("--domain", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--start", required=True)
    p.add_argument("--step-s", type=float, required=True)
    p.add_argument("--a", type=float, default=200.0)
    p.add_argument("--b", type=float, default=1.6)
    p.add_argument("--min-dbz", type=float)
    p.add_argument("--max-dbz", type=float)
    p.add_argument("--crs", help="of the rasters: an EPSG code (4326, 6933, UTM zones) or a grid mapping's attributes as JSON; else what the first file says")
    a = p.parse_args(argv)
    spark = _spark()
    cells, axes = _domain(spark, a.domain)
    raw = geotiff.read_rasters(spark, a.input_dir).withColumn("rate", S.dbz_to_rain(F.col("value"), a.a, a.b, a.min_dbz, a.max_dbz))
    width, height, place = geotiff.place(raw.where("k = 0").select("file").first()["file"])
    crs = json.loads(a.crs) if a.crs else place.epsg
    source = raw.select("k", F.col("c").alias("i"), F.col("r").alias("j"), "rate")
    own = None if axes.in_metres else crs  # a domain in metres is on the grid of its rasters
    rates = G.reprojected(cells, own, place.x0, place.dx, width, place.y0, place.dy, height, source).select("k", "cell_id", "rate")
    first = spark.range(1).select(S.cf_hours(S.iso_timestamp(F.lit(a.start)))).first()[0]
    n = raw.select("k").distinct().count()
    _save_rain(rates, a.out, axes, [first + k * a.step_s / 3600.0 for k in range(n)], cells, "radar")


def model_rain(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="model", description="rain rates of accumulated model rain in several files; of equal times the first file's stay")
    p.add_argument("--inputs", required=True, type=names, help="files or patterns, separated by commas")
    p.add_argument("--domain", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--variable", default="DELTA_RAIN")
    p.add_argument("--hours", type=float, default=1.0)
    a = p.parse_args(argv)
    if a.variable != "DELTA_RAIN":
        sys.exit("only DELTA_RAIN is known")
    import glob

    spark = _spark()
    cells, axes = _domain(spark, a.domain)
    paths = list(dict.fromkeys(f for x in a.inputs for f in (sorted(glob.glob(x)) or [x])))
    rows = None
    for k, path in enumerate(paths):  # files of one run
        one = model_file(spark, path, a.variable, a.hours, cells).withColumn("file_idx", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    rows = T.merged_files(rows, ["h", "cell_id"], "file_idx")
    hours = [r["h"] for r in rows.select("h").distinct().orderBy("h").collect()]
    number = spark.createDataFrame([(h, k) for k, h in enumerate(hours)], "h double, k int")
    _save_rain(rows.join(F.broadcast(number), "h").select("k", "cell_id", "rate"), a.out, axes, hours, cells, "model")


#: Names by which model files call their axes, in the order in which they are tried.
AXIS_NAMES = {"lon": ("longitude", "lon", "x"), "lat": ("latitude", "lat", "y"), "time": ("time", "Time", "t")}


def model_file(spark: SparkSession, path: str, variable: str, hours: float, cells: DataFrame) -> DataFrame:
    """(h, cell_id, rate) of one file of accumulated rain."""
    ds, entries = netcdf.opened(path)
    find = lambda k: next((n for n in AXIS_NAMES[k] if n in ds.variables), None)
    lon, lat, time = find("lon"), find("lat"), find("time")
    if variable not in entries or not lon or not lat or not time:
        raise ValueError(f"{path} lacks {variable!r} or its axes")
    schema = {"rain_var": variable, "time_var": time, "lat_var": lat, "lon_var": lon}
    rain = D.read_rain(spark, path, "model", cells, schema, require_cf=False)
    return rain.select(S.cf_hours(F.col("t")).alias("h"), "cell_id", S.accumulation_rate(F.col("rate"), hours).alias("rate"))


#: Prefixes of the properties that zones get.
PROPERTIES = {"flood_depth": ("depth_mean", "depth_max"), "risk_index": ("risk_mean", "risk_max")}


def _regular(axis) -> bool:
    """Whether steps of an axis differ by rounding only."""
    steps = [b - a for a, b in zip(axis, axis[1:], strict=False)]
    return not steps or max(steps) - min(steps) <= 1e-3 * abs(sum(steps) / len(steps))


def zones(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="zones", description="features with statistics of a run's results")
    p.add_argument("--features", required=True)
    p.add_argument("--results", required=True, help="results.nc, or the folder of a run's tables")
    p.add_argument("--domain", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--time-index", type=int, default=-1)
    p.add_argument("--variables", type=names, default=["flood_depth", "risk_index"], help="all, or a list")
    p.add_argument("--depth-threshold-m", type=float, default=0.1)
    p.add_argument("--stats-mode", choices=("centre", "touched", "exact"), default="centre")
    p.add_argument("--point-buffer-deg", type=float, default=0.0)
    p.add_argument("--line-buffer-deg", type=float, default=0.0)
    p.add_argument("--risk-class-by", choices=("mean", "max"), default="mean")
    p.add_argument("--risk-thresholds", type=numbers)
    a = p.parse_args(argv)
    spark = _spark()
    cells, axes = _domain(spark, a.domain)
    wanted = config.output_variables("all" if a.variables == ["all"] else a.variables)
    values = results_at(spark, a.results, cells, a.time_index, wanted)
    values = values.withColumnsRenamed({"flood_depth": "depth_m", "risk_index": "risk"})
    for name in ("depth_m", "risk"):
        values = values if name in values.columns else values.withColumn(name, F.lit(None).cast("double"))
    # ids need not be unique: rows are numbered, and written so that their numbers stay
    features = cut(files.read_features(spark, a.features).withColumnRenamed("feature_id", "own_id").withColumn("feature_id", F.monotonically_increasing_id()))
    step = lambda v: float(v[1] - v[0]) if len(v) > 1 else 1.0
    dx, dy = axes.steps
    grid = (float(axes.x[0]), step(axes.x), len(axes.x), float(axes.y[0]), step(axes.y), len(axes.y))
    tile = max(abs(dx), abs(dy)) * 16
    uneven = None
    if not (_regular(axes.x) and _regular(axes.y)):
        axis = lambda v: spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "i int, v double")
        uneven = axis(axes.x), axis(axes.y)
    e = Y.enriched(features, values, grid, tile, a.depth_threshold_m, a.point_buffer_deg, a.line_buffer_deg, a.stats_mode, a.risk_class_by, a.risk_thresholds, uneven)
    new = [c for v in wanted for c in PROPERTIES.get(v, ())]
    for v in wanted:
        if v not in PROPERTIES:
            one = Y.zonal_single(Y.shapes(features).where("kind = 'area'"), Y.uneven_boxes(values, *uneven) if uneven else values, dx, dy, tile, v, a.stats_mode)
            e = e.join(one, "feature_id", "left")
            new += [f"{v}_mean", f"{v}_max"]
    e = e.drop("feature_id").withColumnRenamed("own_id", "feature_id")
    new += ["mode", "flooded_pct"] + (["risk_class"] if "risk_index" in wanted else [])
    files.write_collection(files.with_values(e, new), a.out)
    print(json.dumps(Y.update_counts(e).first().asDict()))


def results_at(spark: SparkSession, path: str, cells: DataFrame, index: int, variables: list[str]) -> DataFrame:
    """Cells with the variables of one output step; negative indices count from the last."""
    where = cells.select("cell_id", "r", "c", "x", "y")
    if not path.endswith(".nc"):
        steps = [r[0] for r in spark.read.parquet(path).select("step").distinct().orderBy("step").collect()]
        if not -len(steps) <= index < len(steps):
            raise ValueError(f"time {index} is not among {len(steps)} steps")
        return spark.read.parquet(path).where(F.col("step") == steps[index]).select("cell_id", *variables).join(where, "cell_id")
    ds, entries = netcdf.opened(path)
    n = ds.dims.get("time", 1)
    if not -n <= index < n:
        raise ValueError(f"time {index} is not among {n} steps")
    spark.dataSource.register(netcdf.NetcdfSource)
    out = where
    for v in variables:
        raw = spark.read.format("netcdf").option("path", path).option("variable", v)
        raw = raw.option("time", index % n) if len(entries[v].shape) == 3 else raw
        out = out.join(raw.load().select("r", "c", F.col("value").alias(v)), ["r", "c"], "left")
    return out


def alerts(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="alerts", description="alerts of features that satisfy rules, to an outbox table")
    p.add_argument("--features", required=True)
    p.add_argument("--rules", required=True, help="JSON: rules [{name, when, severity, channels, template}], channels {name: [properties]}")
    p.add_argument("--outbox", required=True)
    p.add_argument("--sent", help="table of alerts that were sent before")
    a = p.parse_args(argv)
    spark = _spark()
    cfg = json.loads(Path(a.rules).read_text())
    rows = [(r["name"], *A.parse_rule(r["when"]), r.get("severity", "info"), r.get("channels", []), r.get("template")) for r in cfg["rules"]]
    rules = spark.createDataFrame(rows, "rule string, property string, op string, value string, severity string, channels array<string>, template string")
    f = files.read_features(spark, a.features)
    # ids need not be unique: rows are numbered, and written so that their numbers stay
    f = cut(f.withColumn("feature_row", F.monotonically_increasing_id().cast("string")).select(F.col("feature_id").alias("own_id"), "properties", F.col("feature_row").alias("feature_id")))
    hits = A.matches(f, rules).join(f, "feature_id").drop("feature_id").withColumnRenamed("own_id", "feature_id")
    hits = hits.withColumn("feature", S.feature_name(F.col("properties"), F.col("feature_id")))
    hits = hits.withColumn("alert_id", A.alert_id(F.col("feature_id"), F.col("rule"), F.col("property"), F.col("op"), F.col("value"), A.six_digits(F.col("actual"))))
    templates = {r["name"]: r.get("template") for r in cfg["rules"]}
    message = F.lit(None).cast("string")
    for name, text in templates.items():
        message = F.when(F.col("rule") == name, A.rendered(text, F.col("rule"), F.col("feature"), F.col("property"), F.col("actual"), F.col("severity"))).otherwise(message)
    contacts = cfg.get("channels", {})
    routed = A.routed(hits.withColumn("message", message), list(contacts), contacts).withColumn("ts", F.current_timestamp())
    sent = A.read_sent(spark, a.sent) if a.sent else spark.createDataFrame([], "alert_id string, ts timestamp")
    routed = cut(routed)
    # what lies in the outbox is on its way; it is remembered as sent when it is (see deliver)
    known = sent.unionByName(O.queued(spark, a.outbox).select("alert_id", F.lit(None).cast("timestamp").alias("ts")).distinct())
    summary = A.run_summary(routed, known).first().asDict()
    new = cut(A.unsent(routed, known))
    A.deliveries(new).write.mode("append").parquet(a.outbox)
    print(json.dumps(summary))


def deliver(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="deliver", description="sends what lies in an outbox, and again what failed")
    p.add_argument("--outbox", required=True)
    p.add_argument("--log", required=True, help="folder of claims and acknowledgements")
    p.add_argument("--senders", required=True, help="module:name of a dict {channel: function(message, key)}")
    p.add_argument("--sent", help="table of alerts that were sent")
    p.add_argument("--most-attempts", type=int, default=8)
    a = p.parse_args(argv)
    module, _, name = a.senders.partition(":")
    senders = getattr(importlib.import_module(module), name)
    done = O.deliver(_spark(), a.outbox, a.log, senders, a.sent, a.most_attempts)
    print(json.dumps({r["kind"]: r["n"] for r in done.groupBy(F.split("status", ":")[0].alias("kind")).agg(F.count("*").alias("n")).collect()}))


def draw(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="map", description="a PNG of one output step on shaded relief")
    p.add_argument("--domain", required=True)
    p.add_argument("--results", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--variable", default="flood_depth")
    p.add_argument("--time-index", type=int, default=-1)
    p.add_argument("--threshold", type=float)
    p.add_argument("--top-percentile", type=float, default=99.5)
    a = p.parse_args(argv)
    spark = _spark()
    cells, axes = _domain(spark, a.domain)
    risk = a.variable == "risk_index"
    step = lambda v: float(v[1] - v[0]) if len(v) > 1 else 1.0
    shade = G.hillshade(cells, step(axes.x), step(axes.y))
    values = results_at(spark, a.results, cells, a.time_index, [a.variable]).withColumn("value", P.shown(F.col(a.variable), a.threshold))
    top = 1.0 if risk else P.colour_top(values, "value", a.top_percentile).first()["top"]
    picture = maps.draw(values.join(shade, "cell_id"), "value", top, len(axes.y), len(axes.x), risk=risk)
    Path(a.out).write_bytes(picture)


def nested(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="nested", description="runs of several domains, parents first")
    p.add_argument("--config", required=True, help="JSON: domains [{name, parent, grid, rain, config}]")
    p.add_argument("--out", required=True)
    a, rest = p.parse_known_args(argv)
    listed = {d["name"]: d for d in json.loads(Path(a.config).read_text())["domains"]}
    for _, name in domains.run_order({n: d.get("parent") for n, d in listed.items()}):
        d = listed[name]
        more = [x for k in ("rain", "config") if d.get(k) for x in (f"--{k}", d[k])]
        simulate.main(["--grid", d["grid"], "--out", S.tagged_path(a.out, name), *more, *rest])


COMMANDS = {"simulate": simulate.main, "nested": nested, "make-domain": make_domain, "stations": station_rain, "radar": radar_rain, "model": model_rain, "zones": zones, "alerts": alerts, "deliver": deliver, "map": draw}


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] not in COMMANDS:
        sys.exit(f"usage: pluvia {{{','.join(COMMANDS)}}} ...\n{__doc__}")
    COMMANDS[argv[0]](argv[1:])


if __name__ == "__main__":
    main()
