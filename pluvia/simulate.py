"""A whole run: grid and rain to runoff, routing, depth, risk and balance, as one plan without a step loop.

    python -m pluvia.simulate --grid grid.parquet --rain rain.parquet --out folder [--config run.json] [--restart folder]

``grid``: (cell_id, r, c, x, y, dem, cn, channel[, d8]); ``rain``: (source, k, t, cell_id, rate). Runoff comes from windows over
steps, routing from blocks of the grid. Steps count on over restarts, and a state holds parcels where they are with the time that
they still wait, so that a run in pieces gives what a whole one does without doing any part again.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia import config, report
from pluvia.functions import scalars as S
from pluvia.operators import flow as L
from pluvia.operators import grid as G
from pluvia.operators import products as P
from pluvia.operators import rain as R
from pluvia.operators import routing as B
from pluvia.plans import state
from pluvia.sources import domain, files


@dataclass
class Run:
    results: DataFrame
    balance: DataFrame
    report: DataFrame
    outflow: DataFrame
    cells: DataFrame
    parcels: DataFrame
    runoff: DataFrame
    schedule: DataFrame | None
    start: state.State | None = None
    kept: DataFrame | None = None
    kept_steps: frozenset = frozenset()
    route: Callable | None = None
    moved: DataFrame | None = None

    def state_at(self, step: int, dt_s: float) -> state.State:
        """What a later run needs to go on after ``step``."""
        last = self.runoff.where(F.col("step") <= step).groupBy("cell_id").agg(F.max_by("p_cum_mm", "step").alias("p_cum_mm"), F.max_by("q_cum_mm", "step").alias("q_cum_mm"))
        cells = self.cells.select("cell_id").join(last, "cell_id", "left")
        if self.start is not None:
            before = self.start.cells.select("cell_id", F.col("p_cum_mm").alias("p0"), F.col("q_cum_mm").alias("q0"))
            cells = cells.join(before, "cell_id", "left").select("cell_id", F.coalesce("p_cum_mm", "p0").alias("p_cum_mm"), F.coalesce("q_cum_mm", "q0").alias("q_cum_mm"))
        b = self.balance.where(F.col("step") == step).first()
        totals = {k: b[k] if b else 0.0 for k in ("rain_cum_m3", "runoff_cum_m3", "outflow_cum_m3")}
        if self.schedule is not None:
            parcels = L.active_parcels(self.parcels, self.schedule, step)
        else:  # parcels where they are and with the time that they still wait, however they were routed
            kept = self.kept if step in self.kept_steps else self.route(step).kept
            parcels = kept.where(F.col("step") == step).select("cell_id", (F.col("step") + 1).alias("step0"), "tau", "n", "vol")
        return state.State(cells.fillna(0.0), parcels, {"step": step, "dt_s": dt_s, "elapsed_s": (step + 1) * dt_s, **totals})


def simulate(grid: DataFrame, rain: DataFrame, steps: DataFrame, cfg: dict, start: state.State | None = None) -> Run:
    """``steps`` (step, t). Results are the output steps that the configuration saves, and always the last."""
    m, out, auto = cfg["model"], cfg["output"], cfg["travel_time_auto"]
    if start is not None and start.scalars.get("dt_s", m["dt_s"]) != m["dt_s"]:
        raise ValueError("a run goes on with the time step it began with")
    dx = G.median_step(grid.select(F.col("c").alias("i"), F.col("x").alias("v")).distinct()).first()[0] or 1.0
    dy = G.median_step(grid.select(F.col("r").alias("i"), F.col("y").alias("v")).distinct()).first()[0] or dx
    g = grid if "d8" in grid.columns else grid.join(G.d8_from_dem(grid, dx, dy), "cell_id", "left")
    g = G.clean_domain(g)
    if "area_m2" not in g.columns:
        g = g.withColumn("area_m2", S.sphere_cell_area(F.col("y"), dx, dy))
    flow = G.downstream(g, m["encoding"])
    hop = S.hop_distance_m(F.col("area_m2"), F.col("d8"))
    channel = F.col("channel") if "channel" in g.columns else F.lit(False)
    if auto["enabled"]:
        speed = lambda v: S.auto_travel_s(hop, v, auto["min_s"], auto["max_s"])
        travel = F.when(channel, speed(auto["channel_velocity_ms"])).otherwise(speed(auto["hillslope_velocity_ms"]))
    else:
        travel = F.when(channel, F.lit(m["travel_time_channel_s"])).otherwise(F.lit(m["travel_time_s"]))
    travel = g.select(F.col("cell_id").alias("node"), travel.alias("travel_s"))
    slices = rain.select("source", "k", "t").distinct()
    sources = config.rain_sources(cfg, [r[0] for r in slices.select("source").distinct().collect()])  # as many as are configured
    of = lambda k: {n: x[k] for n, x in sources.items()}
    picked = R.pick_by_source(steps, slices, of("select"))
    mm = R.blend(picked, rain.select("source", "k", "cell_id", "rate"), of("weight"), of("mode"), m["dt_s"])
    runoff = R.runoff_steps(mm, g, m["ia_ratio"], start=start and start.cells).join(g.select("cell_id", "area_m2"), "cell_id")
    runoff = L.cut(runoff)
    parcels = L.spawn(runoff, m["particle_vol_m3"])
    m_routing = m["routing"]
    if m_routing not in ("auto", "blocks", "paths", "supersteps"):
        raise ValueError(f"no routing {m_routing!r}")
    if not m["outflow_sink"] and m_routing not in ("auto", "blocks"):
        raise ValueError("only routing by blocks keeps water that has nowhere to go")
    if m_routing != "paths":
        parcels = parcels.withColumn("tau", F.lit(0.0))
    if start is not None:
        if m_routing == "paths" and "tau" in start.parcels.columns:
            raise ValueError("this state goes on with routing by blocks: its parcels are on their way")
        parcels = parcels.unionByName(start.parcels, allowMissingColumns=True)
    parcels = L.cut(parcels)
    first, last = steps.agg(F.min("step"), F.max("step")).first()
    begun = parcels.agg(F.min("step0")).first()[0]
    hops = int(last) - int(first if begun is None else begun) + 1
    saved = L.cut(P.saved_steps(steps.select("step"), m["dt_s"], out["save_every_s"]).select("step"))
    every, kept_steps = cfg["restart"]["every"], {int(last)}
    if every > 0:
        kept_steps |= set(range(int(first) + every - 1, int(last) + 1, every))
    schedule, kept = None, None

    def by_blocks(until: int | None = None) -> B.Routed:
        """The run, or what it is up to a step whose state was not kept."""
        clock = steps if until is None else steps.where(F.col("step") <= until)
        return B.by_blocks(parcels, g.select("cell_id", "r", "c"), flow, travel, m["dt_s"], saved, clock, sorted(kept_steps) if until is None else [until], sink=m["outflow_sink"])

    if m_routing == "paths":
        schedule = L.cut(L.hop_schedule(L.paths(flow, hops), travel, m["dt_s"]))
        routed = L.by_schedule(parcels, schedule, saved, steps)
    elif m_routing == "supersteps":
        routed, kept_steps = L.by_supersteps(parcels, flow, travel, m["dt_s"], saved, steps), set()
    else:
        routed = by_blocks()
        kept = routed.kept
    outflow = routed.outflow
    least = out["inundation_threshold_m"]
    depth = L.cut(P.flood_depths(routed.placed, g, saved))
    acc = L.flow_accumulation(g.select("cell_id", "active", "area_m2"), flow)
    # cumulated runoff as of each output step: one running window over runoff and questions, ordered by step
    q = runoff.select("step", "cell_id", "q_cum_mm", F.lit(0).alias("ask"))
    if start is not None:
        q = q.unionByName(start.cells.select(F.lit(int(first) - 1).alias("step"), "cell_id", "q_cum_mm", F.lit(0).alias("ask")))
    asked = g.where("active").select("cell_id").join(F.broadcast(saved), F.lit(True)).select("step", "cell_id", F.lit(None).cast("double").alias("q_cum_mm"), F.lit(1).alias("ask"))
    so_far = Window.partitionBy("cell_id").orderBy("step", "ask").rowsBetween(Window.unboundedPreceding, 0)
    q = q.unionByName(asked).withColumn("q_cum_mm", F.last("q_cum_mm", True).over(so_far)).where("ask = 1").drop("ask")
    cells = g.select("cell_id", "active").join(acc, "cell_id").join(F.broadcast(saved), F.lit(True)).join(q, ["step", "cell_id"], "left").fillna(0.0, ["q_cum_mm"])
    risk = P.risk_index(cells, cfg["risk"]["balance"], cfg["risk"]["p_low"], cfg["risk"]["p_high"], by="step")
    top = P.running_max(depth, least).withColumnsRenamed({"depth_max_m": "flood_depth_max", "inundated_max": "inundation_mask_max"})
    results = depth.join(risk, ["step", "cell_id"], "left").join(top, ["step", "cell_id"]).join(F.broadcast(steps), "step")
    names = {"flood_depth": F.col("depth_m"), "risk_index": F.col("risk"), "inundation_mask": S.inundated(F.col("depth_m"), F.col("depth_m").isNotNull(), least)}
    chosen = config.output_variables(out["variables"])
    results = results.select("step", "t", "cell_id", *(names.get(v, F.col(v)).alias(v) for v in chosen if v in names or v in top.columns))
    # measured from the parcels, those of an earlier run included, so that the balance can be wrong
    balance = L.cut(P.volume_balance(runoff, outflow, routed.inside, start and start.scalars))
    state_ = runoff.groupBy("cell_id").agg(F.max_by("p_cum_mm", "step").alias("p_cum_mm"), F.max_by("q_cum_mm", "step").alias("q_cum_mm"))
    return Run(results, balance, P.quality_report(balance), outflow, g.select("cell_id").join(state_, "cell_id", "left").fillna(0.0), parcels, runoff, schedule, start, kept, frozenset(kept_steps), by_blocks, routed.moved)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="rainfall to runoff, routing, depth and risk")
    for name in ("grid", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--rain", help="table of rain; without it the configuration's sources are read")
    p.add_argument("--config")
    p.add_argument("--start", default="1970-01-01T00:00:00Z")
    p.add_argument("--T-s", type=float)
    p.add_argument("--dt-s", type=float)
    p.add_argument("--restart", help="state of an earlier run to go on from")
    p.add_argument("--report", help="path of a JSON report")
    p.add_argument("--metrics", help="path of a JSON report of times and throughput")
    p.add_argument("--compact", action="store_true", help="JSON without indentation and configuration")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    began = time.time()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    cfg = config.load(a.config, model={k: v for k, v in (("T_s", a.T_s), ("dt_s", a.dt_s)) if v is not None})
    dt = cfg["model"]["dt_s"]
    n = max(1, int(-(-cfg["model"]["T_s"] // dt)))
    grid = spark.read.parquet(a.grid)
    begin = a.restart or cfg["restart"]["read"]
    before = state.read(spark, begin, grid.count() if cfg["restart"]["strict_grid"] else None) if begin else None
    first = before.scalars["step"] + 1 if before else 0
    start = S.iso_timestamp(F.lit(a.start))
    steps = spark.range(first, first + n).select(F.col("id").cast("int").alias("step"), F.timestamp_micros(F.unix_micros(start) + ((F.col("id") + 1) * dt * 1e6).cast("long")).alias("t"))
    rain = spark.read.parquet(a.rain) if a.rain else domain.configured_rain(spark, grid, cfg)
    times = report.Timings()
    spark.sparkContext.setJobGroup("plan and route", "plan and route")
    with times("plan and route"):
        run = simulate(grid, rain, steps, cfg, before)
    every = cfg["output"]["rotate_every_s"] or cfg["output"]["save_every_s"]
    rotation = P.saved_steps(steps.select("step"), dt, every).select("step", "rotation")
    spark.sparkContext.setJobGroup("results", "results")
    with times("results"):
        run.results.join(F.broadcast(rotation), "step", "left").fillna(0, ["rotation"]).write.mode("overwrite").partitionBy("rotation", "step").parquet(f"{a.out}/results")
    interval = cfg["output"]["outflow_interval_s"]
    spark.sparkContext.setJobGroup("outflow", "outflow")
    with times("outflow"):
        arrays = L.cut(L.outflow_arrays(run.outflow, interval, dt))
        arrays.write.mode("overwrite").parquet(f"{a.out}/outflow")
        files.write_outflow(arrays, grid, f"{a.out}/outflow_geojson", interval)
    run.report.write.mode("overwrite").json(f"{a.out}/report")
    keep = cfg["restart"]["every"]
    spark.sparkContext.setJobGroup("state", "state")
    with times("state"):
        for step in sorted({*range(first + keep - 1, first + n, keep), first + n - 1}) if keep > 0 else []:
            s = run.state_at(step, dt)
            state.save(f"{a.out}/restart/step={step}", s.cells, s.parcels, s.scalars)
    if a.report:
        area = grid if "area_m2" in grid.columns else grid.withColumn("area_m2", F.lit(None).cast("double"))
        area = area if "active" in area.columns else area.withColumn("active", F.col("dem").isNotNull())
        files.write_text(spark, a.report, report.run_report(area, run.balance, run.report, cfg, time.time() - began, not a.compact))
    if a.metrics:
        files.write_text(spark, a.metrics, report.run_metrics(run, steps, cfg, time.time() - began, times, not a.compact))


if __name__ == "__main__":
    main()
