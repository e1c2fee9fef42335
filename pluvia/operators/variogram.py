"""Kriging of networks of any size: semivariances by distance, a fitted model, and the nearest stations of every cell.

Pairs of places come from an equi-join on tiles as wide as the farthest lag, so that there are as many as places have within that
reach; one aggregation makes the lag table, a few rows for each bin of time. Stations near a cell are looked for in rings of tiles that
grow until the nearest ``k`` are certain, and each cell's system has k + 1 unknowns. No matrix of all stations is built.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.plans.storage import cut

#: Shapes of semivariance by the distance as a share of the range, from 0 to 1.
MODELS = {
    "spherical": lambda h: np.where(h < 1, 1.5 * h - 0.5 * h**3, 1.0),
    "exponential": lambda h: 1 - np.exp(-3 * h),
    "gaussian": lambda h: 1 - np.exp(-3 * h * h),
}
#: Stations that a cell's value is made from, and pairs that one block of an executor's search compares.
NEAREST, COMPARED = 16, 1 << 21


def lag_table(stations: DataFrame, lag_m: float, lags: int) -> DataFrame:
    """(bin, lag, pairs, distance_m, semivariance) of stations (bin, station, x_m, y_m, value): half the mean squared difference.

    Lag k has the pairs from k * ``lag_m`` up to the next; a pair counts once. Stations (one row each in a bin) without a value count
    for nothing. Stations of one place are paired with others as one: counts, means and squared deviations give all their pairs.
    """
    reach = lag_m * lags
    tile = lambda c: F.floor(F.col(c) / reach)
    known = stations.where("value is not null and not isnan(value) and station is not null and not isnan(x_m) and not isnan(y_m)")
    n, mean = F.count("*"), F.avg("value")
    s = cut(known.groupBy("bin", "x_m", "y_m").agg(n.alias("n"), mean.alias("value"), (F.var_pop("value") * n).alias("dev")).withColumns({"tx": tile("x_m"), "ty": tile("y_m")}))
    other = s.select("bin", "tx", "ty", *(F.col(c).alias(f"{c}_2") for c in ("x_m", "y_m", "n", "value", "dev")))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = s.withColumn("d", F.explode(around)).withColumns({"tx": F.col("tx") + F.col("d.i"), "ty": F.col("ty") + F.col("d.j")}).drop("d")
    far = F.hypot(F.col("x_m") - F.col("x_m_2"), F.col("y_m") - F.col("y_m_2"))
    apart = near.join(other, ["bin", "tx", "ty"]).where(F.struct("x_m", "y_m") < F.struct("x_m_2", "y_m_2")).withColumn("h", far).where(F.col("h") < reach)
    squares = F.col("n_2") * F.col("dev") + F.col("n") * F.col("dev_2") + F.col("n") * F.col("n_2") * F.pow(F.col("value") - F.col("value_2"), 2)
    apart = apart.select("bin", "h", (F.col("n") * F.col("n_2")).alias("m"), (squares / 2).alias("half"))
    within = s.where("n > 1").select("bin", F.lit(0.0).alias("h"), F.expr("n * (n - 1) div 2").alias("m"), (F.col("n") * F.col("dev") / 2).alias("half"))
    m = F.sum("m")
    lag = F.floor(F.col("h") / lag_m).cast("int").alias("lag")
    return apart.unionByName(within).groupBy("bin", lag).agg(m.alias("pairs"), (F.sum(F.col("m") * F.col("h")) / m).alias("distance_m"), (F.sum("half") / m).alias("semivariance"))


@dataclass(frozen=True)
class Variogram:
    model: str
    range_m: float
    sill: float
    nugget: float

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return np.where(h > 0, self.nugget + self.sill * MODELS[self.model](h / self.range_m), 0.0)


def fitted(distance: np.ndarray, semivariance: np.ndarray, pairs: np.ndarray, model: str = "best") -> Variogram | None:
    """Least squares over lags, weighted by their pairs; ``best``: of the three models the one that errs least. None: nothing to fit.

    For a range the rest is linear in nugget and sill, neither below 0; ranges are tried on a fine scale, then around the best.
    """
    ok = np.isfinite(semivariance) & (pairs > 0) & (distance > 0)
    h, g, w = distance[ok], semivariance[ok], np.sqrt(pairs[ok].astype(float))
    if len(h) < 3 or not (g > 0).any():
        return None
    found = []

    def at(name: str, reach: float) -> tuple[float, float, float]:
        shape = MODELS[name](h / reach)
        best = (math.inf, 0.0, 0.0)
        for use in ((0, 1), (1,), (0,)):  # nugget and sill, sill alone, nugget alone
            a = np.stack([np.ones(len(h)), shape], 1)[:, use]
            x, *_ = np.linalg.lstsq(a * w[:, None], g * w, rcond=None)
            if (x >= -1e-12 * g.max()).all():
                error = float((((a @ x - g) * w) ** 2).sum())
                full = dict(zip(use, np.maximum(x, 0.0), strict=True))
                if error < best[0] * (1 - 1e-12):
                    best = (error, float(full.get(1, 0.0)), float(full.get(0, 0.0)))
        return best

    for name in MODELS if model == "best" else (model,):
        ranges = np.geomspace(h.min() / 2, 4 * h.max(), 80)
        for _ in range(4):
            errors = [at(name, r)[0] for r in ranges]
            k = int(np.argmin(errors))
            ranges = np.linspace(ranges[max(0, k - 1)], ranges[min(len(ranges) - 1, k + 1)], 25)
        reach = float(ranges[len(ranges) // 2])
        error, sill, nugget = at(name, reach)
        found.append((error, name, reach, sill, nugget))
    _, name, reach, sill, nugget = min(found)
    return Variogram(name, reach, sill, nugget) if sill + nugget > 0 else None


def reach_of(n: int, area: float, extent: float, partners: int = 200) -> float:
    """The farthest lag for ``n`` stations: half the extent, but no farther than ``partners`` stations are away in the mean."""
    return min(extent / 2, math.sqrt(partners * max(area, 1e-9) / (math.pi * max(n, 1)))) or 1.0


def models_of(stations: DataFrame, model: str = "best", lags: int = 12) -> dict[int, Variogram]:
    """A fitted variogram of each bin with three stations at least; bins of one run: few numbers each reach the driver."""
    span = stations.groupBy("bin").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("x_m", "y_m") for f in (F.min, F.max))).where("n > 2")
    out = {}
    by_reach: dict[float, list[int]] = {}
    for r in span.collect():  # bins of a run
        dx, dy = r["max_x_m"] - r["min_x_m"], r["max_y_m"] - r["min_y_m"]
        reach = reach_of(r["n"], dx * dy, math.hypot(dx, dy))
        by_reach.setdefault(float(f"{reach:.1e}"), []).append(r["bin"])  # bins of much the same reach share a job
    for reach, bins in by_reach.items():
        which = stations.sparkSession.createDataFrame([(b,) for b in bins], "bin long")
        table = lag_table(stations.join(F.broadcast(which), "bin"), reach / lags, lags).toPandas()  # ``lags`` rows a bin
        for b, rows in table.groupby("bin"):
            rows = rows.sort_values("lag")
            fit = fitted(rows["distance_m"].to_numpy(), rows["semivariance"].to_numpy(), rows["pairs"].to_numpy(), model)
            if fit is not None:
                out[int(b)] = fit
    return out


def _solved(at: np.ndarray, near: np.ndarray, values: np.ndarray, variogram: Variogram) -> np.ndarray:
    """Ordinary kriging of each target from its own stations: ``at`` (m, 2), ``near`` (m, k, 2), ``values`` (m, k)."""
    m, k = values.shape
    a = np.ones((m, k + 1, k + 1))
    a[:, :k, :k] = variogram(np.hypot(*np.moveaxis(near[:, :, None] - near[:, None], -1, 0)))
    a[:, k, k] = 0
    b = np.ones((m, k + 1, 1))
    b[:, :k, 0] = variogram(np.hypot(*np.moveaxis(near - at[:, None], -1, 0)))
    top = max(variogram.sill + variogram.nugget, 1e-12)
    a[:, :k, :k] -= 1e-10 * top * np.eye(k)  # a system of very near stations stays solvable
    return (np.linalg.solve(a, b)[:, :k, 0] * values).sum(1)


def _search(targets: pa.Table, stations: pa.Table, side: float, k: int, last: bool, models: dict[int, Variogram]) -> pa.Table:
    """(bin, cell_id, x_m, y_m, value) of a tile's targets; value null where the nearest ``k`` may lie beyond the tiles around."""
    n = targets.num_rows
    value, known = np.zeros(n), np.zeros(n, bool)
    if n and stations.num_rows >= (1 if last else k):
        at = np.stack([targets.column(c).to_numpy() for c in ("x_m", "y_m")], 1)
        p = np.stack([stations.column(c).to_numpy() for c in ("sx", "sy")], 1)
        v = stations.column("value").to_numpy()
        take = min(k, len(p))
        model = models.get(targets.column("bin")[0].as_py()) or Variogram("exponential", max(float(np.ptp(p, 0).max()), 1.0), 1.0, 0.0)
        inner = at - np.floor(at / side) * side
        safe = side + np.minimum(inner, side - inner).min(1)  # all stations nearer than this are here
        step = max(1, COMPARED // len(p))
        for lo in range(0, n, step):
            t = at[lo : lo + step]
            d = np.hypot(t[:, :1] - p[:, 0], t[:, 1:] - p[:, 1])
            which = np.argpartition(d, take - 1, 1)[:, :take] if take < len(p) else np.tile(np.arange(len(p)), (len(t), 1))
            farthest = np.take_along_axis(d, which, 1).max(1)
            ok = (farthest <= safe[lo : lo + step]) | last
            known[lo : lo + step] = ok
            for a in range(0, len(t), 4096):
                rows = np.flatnonzero(ok[a : a + 4096]) + a
                if len(rows):
                    value[lo + rows] = _solved(t[rows], p[which[rows]], v[which[rows]], model)
    columns = [targets.column(c) for c in ("bin", "cell_id", "x_m", "y_m")]
    return pa.table([*columns, pa.array(value, mask=~known)], names=["bin", "cell_id", "x_m", "y_m", "value"])


def _searching(side: float, k: int, last: bool, models: dict[int, Variogram]):
    return lambda targets, stations: _search(targets, stations, side, k, last, models)


def krige_nearest(targets: DataFrame, stations: DataFrame, models: dict[int, Variogram], k: int = NEAREST) -> DataFrame:
    """(bin, cell_id, value): ordinary kriging of targets (bin, cell_id, x_m, y_m) from their ``k`` nearest stations (bin, x_m, y_m, value).

    Stations of one place are one, with their mean. ``models``: a variogram for each bin, a few numbers each; bins without one get an
    exponential one as wide as the stations around. Tiles begin with about k / 2 stations in the mean and widen fourfold for the cells
    whose nearest stations are not certain yet.
    """
    s = cut(stations.where("value is not null and not isnan(value)").groupBy("bin", F.col("x_m").alias("sx"), F.col("y_m").alias("sy")).agg(F.avg("value").alias("value")))
    span = s.groupBy("bin").agg(F.count("*").alias("n"), (F.max("sx") - F.min("sx")).alias("dx"), (F.max("sy") - F.min("sy")).alias("dy"))
    wide = targets.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("x_m", "y_m") for f in (F.min, F.max))).first()
    first = span.agg(F.min(F.sqrt(F.greatest(F.col("dx") * F.col("dy"), F.lit(1.0)) * k / (2 * F.col("n")))), F.max("dx"), F.max("dy")).first()
    schema = "bin long, cell_id long, x_m double, y_m double, value double"
    if first[0] is None or wide["min_x_m"] is None:
        return targets.sparkSession.createDataFrame([], "bin long, cell_id long, value double")
    whole = s.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("sx", "sy") for f in (F.min, F.max))).first()
    extent = max(max(wide[f"max_{c}_m"], whole[f"max_s{c}"]) - min(wide[f"min_{c}_m"], whole[f"min_s{c}"]) for c in "xy")
    side, left, done = max(float(first[0]), 1e-6), targets.select("bin", "cell_id", "x_m", "y_m"), []
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    while True:
        last = side >= extent
        tile = lambda c, side=side: F.floor(F.col(c) / side)
        t = left.withColumns({"tx": tile("x_m"), "ty": tile("y_m")})
        p = s.withColumn("d", F.explode(around)).select(F.col("bin").alias("sbin"), (tile("sx") + F.col("d.i")).alias("ux"), (tile("sy") + F.col("d.j")).alias("uy"), "sx", "sy", "value")
        found = cut(t.groupBy("bin", "tx", "ty").cogroup(p.groupBy("sbin", "ux", "uy")).applyInArrow(_searching(side, k, last, models), schema))
        done.append(found.where("value is not null").select("bin", "cell_id", "value"))
        left = found.where("value is null").drop("value")
        if last or left.isEmpty():
            break
        side *= 4
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def rain_by_kriging(binned: DataFrame, cells: DataFrame, model: str = "best", k: int = NEAREST) -> DataFrame:
    """(bin, cell_id, value) of bins (bin, station, x_m, y_m, rate) with three stations or more: kriging of log(1 + rate), and back."""
    rate = F.greatest(F.col("rate"), F.lit(0.0))
    s = cut(binned.where("rate is not null and not isnan(rate)").select("bin", "station", "x_m", "y_m", F.log1p(rate).alias("value")))
    bins = s.select("bin", "x_m", "y_m").distinct().groupBy("bin").count().where("count > 2").select("bin")
    targets = cells.select("cell_id", "x_m", "y_m").join(F.broadcast(bins), F.lit(True)).select("bin", "cell_id", "x_m", "y_m")  # the result's rows
    out = krige_nearest(targets, s.join(F.broadcast(bins), "bin"), models_of(s, model), k)
    return out.withColumn("value", F.greatest(F.expm1("value"), F.lit(0.0)))
