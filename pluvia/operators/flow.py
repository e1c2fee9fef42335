"""Flow over the cell graph: upstream area by pointer doubling, routing of parcels by closed-form schedules or the literal clock.

Runs are routed by blocks (:mod:`pluvia.operators.routing`); what is here beside it serves questions about single paths and tests.

Parcels do not act on each other, so equal parcels (cell, tau) travel as one row with a count and a volume.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.operators.routing import Routed
from pluvia.plans.storage import cut, shared


def _doubled(jump: DataFrame) -> DataFrame:
    """Twice as far: (cell_id, to) after (cell_id, to)."""
    far = jump.select(F.col("cell_id").alias("to"), F.col("to").alias("next"))
    return jump.join(far, "to").where("next is not null").select("cell_id", F.col("next").alias("to"))


def flow_accumulation(cells: DataFrame, flow: DataFrame) -> DataFrame:
    """(cell_id, acc_m2): own active area and that of all cells upstream.

    ``cells`` (cell_id, active, area_m2), ``flow`` (cell_id, ds_id). Edges leave active cells only; an inactive cell receives and
    does not forward; cells on a cycle receive from outside it and do not forward. Pointer doubling: after k rounds every cell
    holds the sum over cells nearer than 2^k hops, so rounds grow with the logarithm of the longest path. Walks that are longer
    than there are cells end on cycles: only then edges out of cycles are left out and the sums are done again.
    """
    edges = flow.where("ds_id is not null").join(cells.where("active").select("cell_id"), "cell_id", "left_semi").select("cell_id", F.col("ds_id").alias("to"))
    own = cut(cells.select("cell_id", F.when(F.col("active"), F.col("area_m2")).otherwise(0.0).alias("acc_m2")))
    edges = cut(edges)
    total, endless = _summed(own, edges, math.ceil(math.log2(max(2, own.count()))) + 1)
    if endless is None:
        return total
    loops = endless.select(F.col("to").alias("cell_id")).distinct()
    return _summed(own, cut(edges.join(loops, "cell_id", "left_anti")), None)[0]


def _summed(total: DataFrame, jump: DataFrame, rounds: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(sums, what is left): doubling until no walk goes on, or for ``rounds``; then the walks (cell_id, to) that still do."""
    done = 0
    while not jump.isEmpty():
        if done == rounds:
            return total, jump
        inflow = jump.join(total, "cell_id").groupBy(F.col("to").alias("cell_id")).agg(F.sum("acc_m2").alias("more"))
        total = cut(total.join(inflow, "cell_id", "left").select("cell_id", (F.col("acc_m2") + F.coalesce("more", F.lit(0.0))).alias("acc_m2")))
        jump, done = cut(_doubled(jump)), done + 1
    return total, None


def paths(flow: DataFrame, hops: int | None = None) -> DataFrame:
    """(cell_id, j, node): where a walk from each cell is after j hops, j from 0; built by doubling, up to ``hops`` if given."""
    table = cut(flow.select("cell_id", F.lit(0).alias("j"), F.col("cell_id").alias("node")))
    jump, length = cut(flow.where("ds_id is not null").select("cell_id", F.col("ds_id").alias("to"))), 1
    while not jump.isEmpty() and (hops is None or length <= hops):
        more = jump.join(table.select(F.col("cell_id").alias("to"), "j", "node"), "to").select("cell_id", (F.col("j") + length).alias("j"), "node")
        table = cut(table.unionByName(more if hops is None else more.where(F.col("j") <= hops)))
        jump, length = cut(_doubled(jump)), 2 * length
    return table


def hop_schedule(path: DataFrame, travel: DataFrame, dt_s: float) -> DataFrame:
    """(cell_id, j, node, offset): the step, counted from its spawn step, at which a parcel of ``cell_id`` arrives at hop j.

    A parcel moves at most once in a step, when its waiting time is used up; hop j+1 happens at j + max over i <= j of (a_i - i)
    with a_0 = 0 and a_i = ceil(C_i / dt) - 1, C_i the travel time of the first i hops (``travel``: node, travel_s by
    destination). The row j = 0 is the spawn itself.
    """
    p = path.join(travel, "node")
    w = Window.partitionBy("cell_id").orderBy("j")
    c = F.sum(F.when(F.col("j") > 0, F.col("travel_s")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    a = F.when(F.col("j") == 0, F.lit(0)).otherwise(F.ceil(c / dt_s - 1e-9).cast("int") - 1)
    p = p.withColumn("lead", a - F.col("j"))
    due = F.max("lead").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("j")  # when the next hop happens
    return p.withColumn("due", due).select("cell_id", "j", "node", F.coalesce(F.lag("due").over(w), F.lit(-1)).alias("offset"), "due")


def advect(parcels: DataFrame, schedule: DataFrame, step: int) -> DataFrame:
    """(node, n, vol) of parcels (cell_id, step0, n, vol) after step ``step``; node NULL is what has flowed out."""
    at = parcels.sparkSession.createDataFrame([(step,)], "step int")
    return advect_to(parcels, schedule, at).drop("step")


def advect_to(parcels: DataFrame, schedule: DataFrame, steps: DataFrame) -> DataFrame:
    """(step, node, n, vol) after each of ``steps`` (step: output steps of one run's clock, broadcast); NULL is what has flowed out.

    The last hop with step0 + offset <= step tells the place; a parcel whose next hop from its last node is due is out. Parcels
    of a cell and step travel as one row, so each meets its path once for all output steps.
    """
    p = parcels.groupBy("cell_id", "step0").agg(F.sum("n").alias("n"), F.sum("vol").alias("vol"))
    walk = schedule.select("cell_id", "j", "node", F.when(F.col("offset") < 0, F.lit(-(1 << 30))).otherwise(F.col("offset")).alias("from"), "due", (F.lead("j").over(Window.partitionBy("cell_id").orderBy("j"))).isNull().alias("last"))
    # at a node from arrival up to the step before the next hop; the last node up to the hop out of the grid
    s = p.join(walk, "cell_id").join(F.broadcast(steps.select("step")), F.col("step") >= F.col("step0"))
    here = (F.col("step0") + F.col("from") <= F.col("step")) & ((F.col("step0") + F.col("due") > F.col("step")) | F.col("last"))
    out = F.col("last") & (F.col("step0") + F.col("due") <= F.col("step"))
    return s.where(here).select("step", F.when(~out, F.col("node")).alias("node"), "n", "vol").groupBy("step", "node").agg(F.sum("n").alias("n"), F.sum("vol").alias("vol"))


def in_grid(parcels: DataFrame, schedule: DataFrame, steps: DataFrame) -> DataFrame:
    """(step, vol) measured from the parcels: what has been spawned and has not left by the end of each step."""
    end = schedule.groupBy("cell_id").agg(F.max_by("due", "j").alias("due"))
    p = parcels.join(end, "cell_id", "left")
    moves = p.select(F.col("step0").alias("step"), "vol").unionByName(p.where("due is not null").select((F.col("step0") + F.col("due")).alias("step"), (-F.col("vol")).alias("vol")))
    by = moves.groupBy("step").agg(F.sum("vol").alias("change"))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one row a step: a run's clock
    return steps.select("step").join(by, "step", "left").select("step", F.sum(F.coalesce("change", F.lit(0.0))).over(w).alias("vol"))


def active_parcels(parcels: DataFrame, schedule: DataFrame, step: int) -> DataFrame:
    """The parcels that are in the grid after ``step``, as they were spawned: with the schedule their place follows."""
    end = schedule.groupBy("cell_id").agg(F.max_by("due", "j").alias("due"))
    return parcels.join(end, "cell_id", "left").where((F.col("step0") <= step) & (F.col("due").isNull() | (F.col("step0") + F.col("due") > step))).select(*parcels.columns)


def superstep(parcels: DataFrame, flow: DataFrame, dt_s: float, sink: bool = True) -> DataFrame:
    """One literal step over parcels (cell_id, tau, n, vol), for runs too deep for path tables: (cell_id or NULL, tau, n, vol).

    ``flow``: (cell_id, ds_id, ds_travel_s). Equal parcels merge afterwards.
    """
    p = parcels.join(flow, "cell_id", "left").withColumn("left", F.col("tau") - dt_s)
    go = F.col("left") <= 1e-9
    cell = F.when(~go, F.col("cell_id")).when(F.col("ds_id").isNotNull(), F.col("ds_id")).otherwise(F.lit(None) if sink else F.col("cell_id"))
    tau = F.when(go & F.col("ds_id").isNotNull(), F.col("left") + F.col("ds_travel_s")).otherwise(F.col("left"))
    return p.select(cell.alias("cell_id"), tau.alias("tau"), "n", "vol").groupBy("cell_id", "tau").agg(F.sum("n").alias("n"), F.sum("vol").alias("vol"))


def by_schedule(parcels: DataFrame, schedule: DataFrame, saved: DataFrame, steps: DataFrame) -> Routed:
    first, last = steps.agg(F.min("step"), F.max("step")).first()
    outflow = outflow_events(parcels, schedule).where(F.col("step").between(first, last))
    clock = steps.select("step").unionByName(parcels.select(F.col("step0").alias("step")).distinct()).distinct()
    return Routed(advect_to(parcels, schedule, saved), outflow, in_grid(parcels, schedule, clock))


def by_supersteps(parcels: DataFrame, flow: DataFrame, travel: DataFrame, dt_s: float, saved: DataFrame, steps: DataFrame) -> Routed:
    """The literal clock, for grids whose path tables would be larger than their parcels: rows are active (cell, waiting time)s.

    Steps follow one another; every one is written, so that a lost executor costs one step. Parcels with a waiting time ``tau``
    go on with it, others have just been spawned.
    """
    spark = parcels.sparkSession
    first, last = steps.agg(F.min("step"), F.max("step")).first()
    begun = parcels.agg(F.min("step0")).first()[0]
    outputs = {r[0] for r in saved.collect()}  # output steps of a run
    folder = f"{shared(spark)}/supersteps-{uuid.uuid4().hex}"
    none = "node bigint, step int, n bigint, vol double"
    spark.createDataFrame([], none).write.parquet(f"{folder}/out/at=none")
    spark.createDataFrame([], none).write.parquet(f"{folder}/placed/at=none")
    spark.createDataFrame([], "step int, vol double").write.parquet(f"{folder}/inside/at=none")
    f = flow.join(travel.select(F.col("node").alias("ds_id"), F.col("travel_s").alias("ds_travel_s")), "ds_id", "left").select("cell_id", "ds_id", "ds_travel_s")
    f = cut(f.repartition("cell_id"))
    state = None
    tau0 = F.coalesce(F.col("tau"), F.lit(0.0)) if "tau" in parcels.columns else F.lit(0.0)
    for step in range(first if begun is None else min(first, begun), last + 1):
        new = parcels.where(F.col("step0") == step).select("cell_id", tau0.cast("double").alias("tau"), "n", "vol")
        now = new if state is None else state.unionByName(new)
        p = now.join(f, "cell_id", "left").withColumn("left", F.col("tau") - dt_s)
        go = F.col("left") <= 1e-9
        out = go & F.col("ds_id").isNull()
        cell = F.when(~go | out, F.col("cell_id")).otherwise(F.col("ds_id"))
        tau = F.when(out, 0.0).when(go, F.col("left") + F.col("ds_travel_s")).otherwise(F.col("left"))
        moved = cut(p.select(cell.alias("cell_id"), tau.alias("tau"), out.alias("out"), "n", "vol").groupBy("cell_id", "tau", "out").agg(F.sum("n").alias("n"), F.sum("vol").alias("vol")))
        state = moved.where("not out").drop("out")
        write = lambda d, kind, step=step: d.write.parquet(f"{folder}/{kind}/at={step}")
        by_node = lambda d, step=step: d.groupBy(F.col("cell_id").alias("node")).agg(F.lit(step).alias("step"), F.sum("n").alias("n"), F.sum("vol").alias("vol"))
        if step >= first:
            write(by_node(moved.where("out")), "out")
        write(state.agg(F.lit(step).alias("step"), F.coalesce(F.sum("vol"), F.lit(0.0)).alias("vol")), "inside")
        if step in outputs:
            write(by_node(state), "placed")
    read = lambda kind, schema: spark.read.schema(schema).parquet(f"{folder}/{kind}").drop("at")
    return Routed(read("placed", none), read("out", none), read("inside", "step int, vol double"))


def outflow_events(parcels: DataFrame, schedule: DataFrame) -> DataFrame:
    """(node, step, n, vol): when parcels leave the grid and from which cell."""
    last = schedule.groupBy("cell_id").agg(F.max_by(F.struct("node", "due"), "j").alias("end"))
    e = parcels.join(last, "cell_id")
    return e.groupBy(F.col("end.node").alias("node"), (F.col("step0") + F.col("end.due")).alias("step")).agg(F.sum("n").alias("n"), F.sum("vol").alias("vol"))


def spawn(runoff: DataFrame, particle_m3: float) -> DataFrame:
    """(cell_id, step0, n, vol): runoff (cell_id, step, dq_mm, area_m2) as parcels; n is rounded half to even, 1 at least."""
    vol = F.col("dq_mm") / 1000.0 * F.col("area_m2")
    s = runoff.where("dq_mm > 0").select("cell_id", F.col("step").alias("step0"), vol.alias("vol"))
    return s.select("cell_id", "step0", F.greatest(F.rint(F.col("vol") / particle_m3), F.lit(1.0)).cast("long").alias("n"), "vol")


def exploded(parcels: DataFrame) -> DataFrame:
    """One row for each particle: ``n`` rows of ``vol / n``."""
    return parcels.withColumn("particle", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("vol", F.col("vol") / F.col("n")).drop("n")


def outflow_arrays(events: DataFrame, interval_s: float, dt_s: float) -> DataFrame:
    """(node, base, particles_per_interval, total): counts by interval of the end of the step, zeros filled in."""
    k = F.floor((F.col("step") + 1) * dt_s / interval_s).cast("int") if interval_s > 0 else F.lit(0)
    e = events.groupBy("node", k.alias("k")).agg(F.sum("n").alias("n"))
    span = e.agg(F.min("k").alias("base"), F.max("k").alias("top"))  # one row
    e = e.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("by"), F.sum("n").alias("total"))
    counts = F.transform(F.sequence("base", "top"), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0).cast("long")))
    return e.join(F.broadcast(span), F.lit(True)).select("node", "base", counts.alias("particles_per_interval"), "total")
