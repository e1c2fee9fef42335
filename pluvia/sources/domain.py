"""Domains and rain in NetCDF: reading with configurable names, checks of the rain schema, writing of domains, rain and results.

Grids are read by the ``netcdf`` source, a part of the rows to a task. Files are written from rows in order of the grid, so that
the driver holds a batch of them and not a grid; large products stay Parquet.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia import config
from pluvia.functions import scalars as S
from pluvia.operators import grid as G
from pluvia.operators import rain as R
from pluvia.sources import geotiff, netcdf

#: Names of a domain's and of rain's variables.
DOMAIN = {"dem": "dem", "d8": "d8", "cn": "cn", "channel_mask": "channel_mask", "x": "x", "y": "y"}
RAIN = {"rain_var": "rain_rate", "time_var": "time", "lat_var": "latitude", "lon_var": "longitude", "crs_var": "crs", "time_units": S.TIME_UNITS, "rate_units": S.RATE_UNITS}
DEM_FILL = 1e37
RASTERS = (".tif", ".tiff", ".geotiff", ".gtiff")


@dataclass
class Axes:
    """Centres of columns and rows, names of the axes, and the grid mapping's name and attributes."""

    x: np.ndarray
    y: np.ndarray
    x_name: str = "longitude"
    y_name: str = "latitude"
    mapping: str | None = None
    mapping_attrs: dict = field(default_factory=dict)

    @property
    def steps(self) -> tuple[float, float]:
        d = [float(np.median(np.abs(np.diff(a)))) if len(a) > 1 else 1.0 for a in (self.x, self.y)]
        return d[0], d[1]

    @property
    def in_metres(self) -> bool:
        return not any(k in self.x_name.lower() for k in ("lon",)) and (max(np.abs(self.x).max(initial=0), np.abs(self.y).max(initial=0)) > 360)


def _frame(spark: SparkSession, name: str, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], f"{name} int, v double")


def located(grid: DataFrame, axes: Axes) -> DataFrame:
    """``grid`` (r, c, ...) with cell_id, x and y; axes are one-dimensional and broadcast."""
    spark = grid.sparkSession
    x, y = _frame(spark, "c", axes.x).withColumnRenamed("v", "x"), _frame(spark, "r", axes.y).withColumnRenamed("v", "y")
    out = grid.join(F.broadcast(x), "c").join(F.broadcast(y), "r")
    return out.withColumn("cell_id", F.col("r").cast("long") * len(axes.x) + F.col("c"))


def read_domain(spark: SparkSession, path: str, varmap: dict[str, str] | None = None) -> tuple[DataFrame, Axes]:
    """(cells, axes): (cell_id, r, c, x, y, dem, d8, cn, channel, active, area_m2) of a domain file, cleaned.

    Cells without elevation are inactive; directions and curve numbers that are missing or of inactive cells are 0; the channel
    mask is optional. Areas: of the grid's own metres, else on the ellipsoid, from a row's centre to the next.
    """
    names = DOMAIN | (varmap or {})
    ds, entries = netcdf.opened(path)
    for k in ("dem", "d8", "cn", "x", "y"):
        if names[k] not in entries:
            raise ValueError(f"{path} has no variable {names[k]!r}")
    gm = entries[names["dem"]].attrs.get("grid_mapping")
    axes = Axes(*(ds.variables[names[k]][1].astype(float) for k in ("x", "y")), names["x"], names["y"], gm if gm in entries else None, dict(entries[gm].attrs) if gm in entries else {})
    spark.dataSource.register(netcdf.NetcdfSource)
    have = [k for k in ("dem", "d8", "cn", "channel_mask") if names[k] in entries]
    raw = spark.read.format("netcdf").option("path", path).option("variable", ",".join(names[k] for k in have)).load()
    cells = located(raw.select("r", "c", *(F.col(names[k]).alias("channel" if k == "channel_mask" else k) for k in have)), axes)
    dx, dy = axes.steps
    if axes.in_metres:
        area = F.lit(S.projected_cell_area(dx, dy))
    else:
        area = S.ellipsoid_cell_area(F.col("y"), dx, dy if len(axes.y) < 2 or axes.y[1] < axes.y[0] else -dy)
    cells = G.clean_domain(cells.withColumn("dem", F.col("dem").cast("float").cast("double"))).withColumn("area_m2", area)
    return cells, axes


def check_rain(ds: netcdf.Dataset, entries: dict[str, netcdf.Entry], names: dict[str, str], require_time: bool = True) -> None:
    """Raises ValueError where a rain file breaks the schema: variables, dimensions, units, grid mapping."""
    var = names["rain_var"]
    for k, what in (("rain_var", "rain variable"), ("time_var", "time"), ("lat_var", "latitude"), ("lon_var", "longitude")):
        if names[k] not in entries:
            raise ValueError(f"the rain file has no {what} {names[k]!r}")
    rain = entries[var]
    for k in (["time_var"] if require_time else []) + ["lat_var", "lon_var"]:
        if names[k] not in rain.dims:
            raise ValueError(f"{var!r} has no dimension {names[k]!r}")
    for k, unit in (("lat_var", "degrees_north"), ("lon_var", "degrees_east")):
        if unit not in str(entries[names[k]].attrs.get("units", "")).lower():
            raise ValueError(f"{names[k]!r} is not in {unit}")
    if names["crs_var"] and (names["crs_var"] not in entries or rain.attrs.get("grid_mapping") != names["crs_var"]):
        raise ValueError(f"{var!r} does not refer to the grid mapping {names['crs_var']!r}")
    if str(rain.attrs.get("units", "")).strip() != names["rate_units"]:
        raise ValueError(f"{var!r} is not in {names['rate_units']!r}")
    if str(entries[names["time_var"]].attrs.get("units", "")).strip() != names["time_units"].strip():
        raise ValueError(f"the time is not in {names['time_units']!r}")


def read_rain(spark: SparkSession, path: str, source: str, cells: DataFrame, schema: dict[str, str] | None = None, require_cf: bool = True, require_time: bool = True) -> DataFrame:
    """(source, k, t, cell_id, rate) of a rain file on the cells of a domain (cell_id, x, y): the nearest value of each."""
    names = RAIN | (schema or {})
    ds, entries = netcdf.opened(path)
    if require_cf:
        check_rain(ds, entries, names, require_time)
    spark.dataSource.register(netcdf.NetcdfSource)
    raw = spark.read.format("netcdf").option("path", path).option("variable", names["rain_var"]).load()
    axis = lambda k: _frame(spark, "i", ds.variables[names[k]][1].astype(float))
    near = G.nearest_nodes(cells.select("cell_id", "x", "y"), axis("lon_var"), axis("lat_var"))
    hours = ds.variables[names["time_var"]][1].astype(float) if names["time_var"] in ds.variables else np.zeros(1)
    units = str(ds.variables[names["time_var"]][2].get("units", names["time_units"])) if names["time_var"] in ds.variables else names["time_units"]
    times = spark.createDataFrame([(k, float(h)) for k, h in enumerate(np.atleast_1d(hours))], "k int, h double").select("k", S.from_cf(F.col("h"), units).alias("t"))
    rates = raw.select(F.col("t").alias("k"), F.col("c").alias("i"), F.col("r").alias("j"), F.col("value").alias("rate"))
    return near.join(rates, ["i", "j"]).join(F.broadcast(times), "k").select(F.lit(source).alias("source"), "k", "t", "cell_id", "rate")


def configured_rain(spark: SparkSession, cells: DataFrame, cfg: dict) -> DataFrame:
    """Rain of all sources of the configuration that have a weight."""
    out = None
    for name, x in config.rain_sources(cfg).items():
        if not x["weight"]:
            continue
        if x["kind"] == "scalar":
            one = R.scalar_rain(cells, name, x["value"])
        elif x["kind"] == "table":
            one = spark.read.parquet(x["path"]).select(F.lit(name).alias("source"), "k", "t", "cell_id", "rate")
        else:
            schema = {k: x[k] for k in RAIN if x.get(k)} | {"rain_var": x["variable"]}
            one = read_rain(spark, x["path"], name, cells, schema, x.get("require_cf", True), x.get("require_time_dim", True))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no rain source has a weight")
    return out


def read_raster(spark: SparkSession, path: str, variable: str, x_name: str = "longitude", y_name: str = "latitude") -> tuple[DataFrame, Axes]:
    """((r, c, value), axes) of a GeoTIFF or of a NetCDF variable of two dimensions."""
    if path.lower().endswith(RASTERS):
        w, h, head = geotiff.place(spark.read.format("binaryFile").load(path).select("path").first()["path"])  # one file's header
        axes = Axes(head.x0 + np.arange(w) * head.dx, head.y0 + np.arange(h) * head.dy, x_name, y_name, "crs", S.crs_attributes({"epsg_code": f"EPSG:{head.epsg}"} if head.epsg else None))
        return geotiff.read_rasters(spark, path).select("r", "c", "value"), axes
    ds, entries = netcdf.opened(path)
    if variable not in entries or len(entries[variable].shape) != 2:
        raise ValueError(f"{path} has no variable {variable!r} of two dimensions")
    if not {x_name, y_name} <= set(ds.variables):
        raise ValueError(f"{path} has no axes {x_name!r} and {y_name!r}")
    spark.dataSource.register(netcdf.NetcdfSource)
    raw = spark.read.format("netcdf").option("path", path).option("variable", variable).load().select("r", "c", "value")
    if entries[variable].dims == (x_name, y_name):
        raw = raw.select(F.col("c").alias("r"), F.col("r").alias("c"), "value")
    gm = entries[variable].attrs.get("grid_mapping")
    return raw, Axes(ds.variables[x_name][1].astype(float), ds.variables[y_name][1].astype(float), x_name, y_name, gm if gm in entries else None, dict(entries[gm].attrs) if gm in entries else {})


def boxed(raw: DataFrame, axes: Axes, box: tuple[float, float, float, float] | None) -> tuple[DataFrame, Axes]:
    """The part of a raster (r, c, value) in a box (west, south, east, north), borders included."""
    if box is None:
        return raw, axes
    west, south, east, north = box
    c, r = np.flatnonzero((axes.x >= west) & (axes.x <= east)), np.flatnonzero((axes.y >= south) & (axes.y <= north))
    if not len(c) or not len(r):
        raise ValueError("the box has no cell of the raster")
    part = raw.where(F.col("c").between(int(c[0]), int(c[-1])) & F.col("r").between(int(r[0]), int(r[-1])))
    part = part.withColumn("c", F.col("c") - int(c[0])).withColumn("r", F.col("r") - int(r[0]))
    return part, Axes(axes.x[c], axes.y[r], axes.x_name, axes.y_name, axes.mapping, axes.mapping_attrs)


def build_domain(spark: SparkSession, dem: str, cn: str | None = None, d8: str | None = None, mask: str | None = None, variables: dict[str, str] | None = None, box: tuple[float, float, float, float] | None = None, resolution: tuple[float, ...] | None = None) -> tuple[DataFrame, Axes]:
    """(cells, axes) of a new domain: elevation in the box, linear on a new resolution; the rest by the nearest value.

    Without directions they come from the elevation, without curve numbers these are 0.
    """
    v = DOMAIN | (variables or {})
    raw, axes = boxed(*read_raster(spark, dem, v["dem"]), box)
    if resolution is None:
        grid = located(raw.withColumnRenamed("value", "dem"), axes)
    else:
        dx, dy = resolution if len(resolution) == 2 else (resolution[0],) * 2
        rising = lambda a: len(a) < 2 or a[0] < a[-1]
        new = Axes(*(np.array(G.axis_values(a.min(), a.max(), d, rising(a))) for a, d in ((axes.x, dx), (axes.y, dy))), axes.x_name, axes.y_name, axes.mapping, axes.mapping_attrs)
        empty = spark.range(len(new.x) * len(new.y)).select((F.col("id") % len(new.x)).cast("int").alias("c"), F.floor(F.col("id") / len(new.x)).cast("int").alias("r"))
        target = located(empty, new)
        first = lambda a: (float(a[0]), float(a[1] - a[0]) if len(a) > 1 else 1.0, len(a))
        linear = G.regrid_bilinear(target, *first(axes.x), *first(axes.y), raw.select(F.col("c").alias("i"), F.col("r").alias("j"), "value"), "value")
        grid, axes = target.join(linear.withColumnRenamed("value", "dem"), "cell_id"), new
    dx, dy = axes.steps

    def nearest(path: str, name: str) -> DataFrame:
        other, its = boxed(*read_raster(spark, path, v[name]), box)
        return G.regrid_nearest(grid.select("cell_id", "x", "y"), _frame(spark, "i", its.x), _frame(spark, "i", its.y), other.select(F.col("c").alias("i"), F.col("r").alias("j"), "value"), "value")

    d8_cells = nearest(d8, "d8").withColumnRenamed("value", "d8") if d8 else G.d8_from_dem(grid, dx, dy)
    grid = grid.join(d8_cells, "cell_id", "left")
    grid = grid.join(nearest(cn, "cn").withColumnRenamed("value", "cn"), "cell_id", "left") if cn else grid.withColumn("cn", F.lit(0.0))
    if mask:
        grid = grid.join(nearest(mask, "channel_mask").withColumnRenamed("value", "channel"), "cell_id", "left")
    return G.clean_domain(grid), axes


# --- writing -------------------------------------------------------------------------------------------------------------


def _layout(axes: Axes, kinds: dict[str, tuple[str, dict, bool]], steps: list[float] | None, attrs: dict) -> netcdf.Dataset:
    ds = netcdf.Dataset({}, attrs)
    if steps is not None:
        ds.dims["time"] = len(steps)
        ds.variables["time"] = (("time",), np.array(steps, "f8"), {"description": "Time", "long_name": "time", "units": S.TIME_UNITS, "calendar": "gregorian"})
    ds.dims |= {axes.y_name: len(axes.y), axes.x_name: len(axes.x)}
    for name, a in ((axes.y_name, axes.y), (axes.x_name, axes.x)):
        ds.variables[name] = ((name,), np.asarray(a, "f8"), S.axis_attributes(name))
    if axes.mapping:
        ds.variables[axes.mapping] = ((), np.array(0, "i4"), S.crs_attributes(axes.mapping_attrs))
    for name, (kind, more, timed) in kinds.items():
        dims = (("time",) if timed and steps is not None else ()) + (axes.y_name, axes.x_name)
        shape = tuple(ds.dims[d] for d in dims)
        ds.variables[name] = (dims, np.broadcast_to(np.zeros((), kind), shape), more | ({"grid_mapping": axes.mapping} if axes.mapping else {}))
    return ds


def write_grid(rows: DataFrame, path: str, axes: Axes, kinds: dict[str, tuple[str, dict, bool]], steps: list[float] | None, attrs: dict, fill: float = -9999.0) -> None:
    """A file of ``rows`` (k, r, c, <names of kinds>); ``kinds``: name -> (type, attributes, one plane for each step?).

    ``k`` counts steps from 0. Rows arrive in order of the grid, batch by batch, and go to their places in the file; NULL is the
    variable's fill value, or 0 of a variable without one.
    """
    ds = _layout(axes, kinds, steps, attrs)
    n, cols = len(axes.y) * len(axes.x), len(axes.x)
    with open(path, "wb") as f:
        head = netcdf.head(ds)
        f.write(head)
    _, entries = netcdf.header(head)
    empty = {name: netcdf.fill_value(kind, more) for name, (kind, more, _) in kinds.items()}
    with open(path, "r+b") as f:
        for name, e in entries.items():
            if name not in kinds:
                f.seek(e.begin)
                f.write(np.ascontiguousarray(ds.variables[name][1], e.kind).tobytes())
                continue
            planes = e.shape[0] if len(e.shape) == 3 else 1
            for k in range(planes):
                f.seek(e.begin + k * n * e.kind.itemsize)
                for lo in range(0, n, netcdf.BATCH):
                    f.write(np.full(min(netcdf.BATCH, n - lo), empty[name], e.kind).tobytes())
        f.truncate(max(e.begin + -(-int(np.prod(e.shape, dtype=int)) * e.kind.itemsize // 4) * 4 for e in entries.values()))
        ordered = rows.select("k", "r", "c", *kinds).orderBy("k", "r", "c")
        for batch in _batches(ordered):
            at = batch["r"].to_numpy(np.int64) * cols + batch["c"].to_numpy(np.int64)
            step = batch["k"].to_numpy(np.int64)
            for name, (_, _, timed) in kinds.items():
                e = entries[name]
                v = batch[name].to_numpy(float, na_value=np.nan)
                v = np.where(np.isnan(v), empty[name], v).astype(e.kind)
                where = at + (step * n if len(e.shape) == 3 else 0)
                for part in np.split(np.arange(len(v)), np.flatnonzero(np.diff(where) != 1) + 1):  # runs of neighbours
                    if len(part):
                        f.seek(e.begin + int(where[part[0]]) * e.kind.itemsize)
                        f.write(v[part].tobytes())


def _batches(rows: DataFrame, size: int = 1 << 16):
    import pandas as pd

    held = []
    for r in rows.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(r))
        if len(held) == size:
            yield pd.DataFrame(held, columns=rows.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=rows.columns)


def write_domain(cells: DataFrame, path: str, axes: Axes) -> None:
    """Elevation, directions, curve numbers and the channel mask of (r, c, dem, d8, cn[, channel])."""
    kinds = {"dem": ("f8", {"long_name": "elevation", "units": "m", "_FillValue": DEM_FILL}, False), "d8": ("i4", {"long_name": "flow direction"}, False), "cn": ("f8", {"long_name": "curve number", "units": "1"}, False)}
    rows = cells.withColumn("k", F.lit(0))
    if "channel" in cells.columns:
        kinds["channel_mask"] = ("i1", {"long_name": "channel mask"}, False)
        rows = rows.withColumn("channel_mask", F.col("channel").cast("int"))
    write_grid(rows, path, axes, kinds, None, {"Conventions": S.CONVENTIONS, "history": S.history("domain written")})


def write_rain(rates: DataFrame, path: str, axes: Axes, times: list[float], title: str = "rain rate", fill: float = -9999.0) -> None:
    """Rain of (k, r, c, rate); ``times``: hours since 1900 of the slices."""
    a = Axes(axes.x, axes.y, "longitude", "latitude", axes.mapping or "crs", S.crs_attributes(axes.mapping_attrs))
    kinds = {"rain_rate": ("f4", {"long_name": "rain rate", "units": S.RATE_UNITS, "_FillValue": fill}, True)}
    write_grid(rates.withColumnRenamed("rate", "rain_rate"), path, a, kinds, times, {"Conventions": S.CONVENTIONS, "title": title, "history": S.history("rain written")}, fill)


def write_results(results: DataFrame, path: str, axes: Axes, cells: DataFrame, cfg: dict, title: str = "flood depth and hydrogeological risk index") -> None:
    """The chosen variables of a run's ``results`` (step, t, cell_id, ...) with the configuration that made them.

    Maxima over the run are one plane, that of the last step.
    """
    fill, least = cfg["output"]["fill"], cfg["output"]["inundation_threshold_m"]
    flags = lambda what, words: {"long_name": what, "units": "1", "flag_values": [0, 1], "flag_meanings": words, "threshold_depth_m": least}
    # Names of variables, standard name, units and flags; the descriptions are free texts.
    known = {
        "flood_depth": ("f4", {"standard_name": "water_depth", "long_name": "depth of water on the cell", "units": "m", "_FillValue": fill}, True),
        "risk_index": ("f4", {"long_name": "risk from runoff and upstream area, 0 to 1", "units": "1", "_FillValue": fill}, True),
        "inundation_mask": ("i1", flags("whether the depth reaches the threshold", "dry inundated"), True),
        "flood_depth_max": ("f4", {"long_name": "largest depth up to the last step", "units": "m", "_FillValue": fill}, False),
        "inundation_mask_max": ("i1", flags("whether the depth has reached the threshold by the last step", "never_inundated inundated"), False),
    }
    kinds = {k: v for k, v in known.items() if k in results.columns}
    steps = results.select("step", S.cf_hours(F.col("t")).alias("h")).distinct().orderBy("step").collect()  # output steps of a run
    number = results.sparkSession.createDataFrame([(r["step"], k) for k, r in enumerate(steps)], "step int, k int")
    rows = results.join(F.broadcast(number), "step").join(cells.select("cell_id", "r", "c"), "cell_id")
    attrs = {"Conventions": S.CONVENTIONS, "title": title, "institution": cfg["output"].get("institution", ""), "source": "pluvia", "history": S.history("results written"), "config_json": json.dumps(cfg, separators=(",", ":"), sort_keys=True), "inundation_threshold_m": least}
    write_grid(rows, path, axes, kinds, [r["h"] for r in steps], attrs, fill)
