"""Routing by blocks of the grid: parcels advance inside a block in one go, and only those that cross its border are exchanged.

A block is a square of ``tile`` x ``tile`` cells with a margin of ``halo`` cells around it. Water goes to a neighbouring cell, so a
parcel that begins in the square needs ``halo`` hops at least before it comes to the edge of the margin; there it stops and goes
to the block in whose square it then is. Parcels do not act on each other, so a block does not wait for its neighbours' clocks: each
round takes every parcel as far as it gets, and there are at most hops / halo + 1 rounds, whatever the depth of the grid.

A parcel is (cell_id, step0, tau, n, vol): at the beginning of step ``step0`` it waits in its cell with the time ``tau`` (0 when
it is spawned). In each step tau falls by the step's length; when it is used up, the parcel moves on, once in a step, and out where
there is no next cell. A block's parcels are cut into shares of ``most_parcels``, so that a group in one task is bounded by that and
by the square's size, not by the number of steps or the rain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.plans.storage import cut

TILE, HALO, MOST_PARCELS = 512, 64, 1_000_000
#: Kinds of rows that a block gives: where parcels are at output steps, what flows out, changes of the water inside, moved particles,
#: states that are kept, parcels for other blocks.
PLACED, OUT, INSIDE, MOVED, KEPT, CROSSING = range(6)
_SCHEMA = "kind int, step int, node long, r int, c int, tau double, n long, vol double"
_WALKED = "kind int, origin long, step int, node long, r int, c int, tau double"
#: Rows of one kind that a block gathers before it sums them up.
_GATHER = 1 << 20


@dataclass
class Routed:
    """``placed`` (step, node, n, vol) at output steps, ``outflow`` (node, step, n, vol), ``inside`` (step, vol), and by blocks
    ``kept`` (step, cell_id, tau, n, vol) at the end of chosen steps and ``moved`` (step, moved): particles that changed cells or left."""

    placed: DataFrame
    outflow: DataFrame
    inside: DataFrame
    kept: DataFrame | None = None
    moved: DataFrame | None = None


def waiting_steps(tau: np.ndarray, dt_s: float) -> np.ndarray:
    """Steps up to and with the one in which a parcel moves on: one at least."""
    return np.maximum(1, np.ceil((tau - 1e-9) / dt_s).astype(np.int64))


class _Net:
    """A block's cells by their place in arrays; ``down``: the next cell's place, -1 out, -2 beyond the margin."""

    def __init__(self, region: pa.Table) -> None:
        col = lambda name: region.column(name).to_numpy()
        order = np.argsort(col("cell_id"), kind="stable")
        self.cell, self.r, self.c = col("cell_id")[order], col("r")[order], col("c")[order]
        self.wait = np.nan_to_num(region.column("ds_travel_s").fill_null(0.0).to_numpy()[order])
        ds = region.column("ds_id").fill_null(-1).to_numpy()[order]
        has = ~region.column("ds_id").is_null().to_numpy(zero_copy_only=False)[order]
        at = np.minimum(np.searchsorted(self.cell, ds), max(0, len(self.cell) - 1))
        known = has & (self.cell[at] == ds) if len(self.cell) else has
        self.down = np.where(known, at, np.where(has, -2, -1))

    def places(self, cells: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.cell, cells), len(self.cell) - 1)
        if not (self.cell[at] == cells).all():
            raise ValueError("a parcel is in a cell that the grid does not have")
        return at


class _Sums:
    """Rows (key, n, vol), summed up whenever many have come together."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, key: np.ndarray, n: np.ndarray, vol: np.ndarray) -> None:
        if len(key):
            self.parts.append((key, n, vol))
            self.size += len(key)
            if self.size > _GATHER:
                self.parts = [self.summed()]
                self.size = len(self.parts[0][0])

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        key, n, vol = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        key, back = np.unique(key, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, back, n)
        return key, total, np.bincount(back, vol, len(key))


def advanced(parcels: pa.Table, region: pa.Table, dt_s: float, first: int, last: int, saved: np.ndarray, kept: np.ndarray, sink: bool = True) -> pa.Table:
    """What becomes of a block's parcels up to step ``last``, or until they leave it: rows of ``_SCHEMA``."""
    net = _Net(region)
    at = net.places(parcels.column("cell_id").to_numpy())
    step = parcels.column("step0").to_numpy().astype(np.int64)
    tau, n, vol = (parcels.column(c).to_numpy() for c in ("tau", "n", "vol"))
    if (net.down[at] == -2).any():
        raise ValueError("water must flow to a neighbouring cell")
    cells, span = len(net.cell), max(0, last - first + 2)
    change, moved = np.zeros(span), np.zeros(span, np.int64)
    placed, out = _Sums(), _Sums()
    rows = {k: [] for k in (KEPT, CROSSING)}
    arrived = np.zeros(len(at), bool)
    while len(at):
        hop = step + waiting_steps(tau, dt_s) - 1
        if not sink:  # what has nowhere to go stays
            hop = np.where(net.down[at] == -1, last + 1, hop)
        # at this cell at the end of the steps a to b; a parcel that has just come was here at the end of the step before
        a, b = np.maximum(step - arrived, first), np.minimum(hop - 1, last)
        here = a <= b
        change[: span] += np.bincount(a[here] - first, vol[here], span) - np.bincount(b[here] + 1 - first, vol[here], span)
        for steps, kind in ((saved, PLACED), (kept, KEPT)):
            lo, hi = np.searchsorted(steps, a), np.searchsorted(steps, b, side="right")
            count = np.where(here, np.maximum(hi - lo, 0), 0)
            who = np.repeat(np.arange(len(at)), count)
            which = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            if kind == PLACED:
                placed.add(which * cells + at[who], n[who], vol[who])
            elif len(who):
                rows[KEPT].append((steps[which], at[who], tau[who] - (steps[which] - step[who] + 1) * dt_s, n[who], vol[who]))
        go = hop <= last
        at, step, hop, tau, n, vol = (x[go] for x in (at, step, hop, tau, n, vol))
        counted = hop >= first
        np.add.at(moved, hop[counted] - first, n[counted])
        left = net.down[at] == -1
        out.add(((hop - first) * cells + at)[left & counted], n[left & counted], vol[left & counted])
        go = ~left
        at, step, hop, tau, n, vol = (x[go] for x in (at, step, hop, tau, n, vol))
        tau = tau - (hop - step + 1) * dt_s + net.wait[at]
        at, step = net.down[at], hop + 1
        edge = net.down[at] == -2
        if edge.any():
            seen = edge & (hop >= first)  # counted here at the end of the step of the hop, by the next block from then on
            change[:span] += np.bincount(hop[seen] - first, vol[seen], span) - np.bincount(hop[seen] + 1 - first, vol[seen], span)
            for steps, kind in ((saved, PLACED), (kept, KEPT)):
                i = np.minimum(np.searchsorted(steps, hop), max(0, len(steps) - 1))
                on = seen & (steps[i] == hop) if len(steps) else np.zeros(len(at), bool)
                if kind == PLACED:
                    placed.add((i * cells + at)[on], n[on], vol[on])
                elif on.any():
                    rows[KEPT].append((hop[on], at[on], tau[on], n[on], vol[on]))
            rows[CROSSING].append((step[edge], at[edge], tau[edge], n[edge], vol[edge]))
            at, step, tau, n, vol = (x[~edge] for x in (at, step, tau, n, vol))
        arrived = np.ones(len(at), bool)
    parts = []

    def put(kind, steps, where=None, waits=None, count=None, volume=None) -> None:
        m = len(steps)
        if m:
            none = lambda t: pa.nulls(m, t)
            place = [none(pa.int64()), none(pa.int32()), none(pa.int32())] if where is None else [pa.array(net.cell[where], pa.int64()), pa.array(net.r[where].astype(np.int32)), pa.array(net.c[where].astype(np.int32))]
            parts.append(pa.table([pa.array(np.full(m, kind, np.int32)), pa.array(np.asarray(steps).astype(np.int32)), *place, none(pa.float64()) if waits is None else pa.array(waits), none(pa.int64()) if count is None else pa.array(count, pa.int64()), none(pa.float64()) if volume is None else pa.array(volume)], names=[x.split()[0] for x in _SCHEMA.split(", ")]))

    for kind, sums, steps in ((PLACED, placed, saved), (OUT, out, np.arange(first, last + 1))):
        key, count, volume = sums.summed()
        if len(key):
            put(kind, steps[key // cells], key % cells, None, count, volume)
    on = np.flatnonzero(change)
    put(INSIDE, on + first, volume=change[on])
    on = np.flatnonzero(moved)
    put(MOVED, on + first, count=moved[on])
    for kind, found in rows.items():
        if found:
            steps, where, waits, count, volume = (np.concatenate(x) for x in zip(*found, strict=True))
            put(kind, steps, where, waits, count, volume)
    empty = pa.table({x.split()[0]: pa.array([], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]]) for x in _SCHEMA.split(", ")})
    return pa.concat_tables([empty, *(p.cast(empty.schema) for p in parts)])


def _block(r: str, c: str, tile: int) -> Column:
    """The block in whose square a cell is."""
    return F.shiftleft(F.floor(F.col(r) / tile).cast("long"), 31) + F.floor(F.col(c) / tile).cast("long")


def _around(cells: DataFrame, flow: DataFrame, travel: DataFrame, tile: int, halo: int) -> tuple[DataFrame, DataFrame]:
    """Cells with what is next to them, and the same rows for each block in whose square or margin they are."""
    inner = lambda c, d: F.floor((F.col(c) + d) / tile)
    ahead = travel.select(F.col("node").alias("ds_id"), F.col("travel_s").alias("ds_travel_s"))
    net = cells.select("cell_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).join(flow.select("cell_id", "ds_id"), "cell_id", "left").join(ahead, "ds_id", "left")
    net = cut(net.select("cell_id", "r", "c", "ds_id", F.col("ds_travel_s").cast("double").alias("ds_travel_s")))
    region = net.withColumn("i", F.explode(F.sequence(inner("r", -halo), inner("r", halo)))).withColumn("j", F.explode(F.sequence(inner("c", -halo), inner("c", halo))))
    return net, region.select(_block("i", "j", 1).alias("block"), "cell_id", "r", "c", "ds_id", "ds_travel_s")


def _shared(p: DataFrame, region: DataFrame, most: int, *key: str):
    """Rows of ``p`` (block, *key, ...) in shares of about ``most``, grouped, and the cells around each share; None without rows."""
    n = p.count()
    if not n:
        return None
    sizes = p.groupBy("block").agg(F.ceil(F.count("*") / most).cast("int").alias("shares"))
    around = region.join(F.broadcast(sizes.withColumnRenamed("block", "home")), F.col("block") == F.col("home"))
    if n > most:
        sizes = cut(sizes)
        shared = p.join(F.broadcast(sizes), "block").withColumn("share", F.pmod(F.xxhash64(*key), F.col("shares")).cast("int")).drop("shares")
    else:
        shared = p.withColumn("share", F.lit(0))
    around = around.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return shared.groupBy("block", "share"), around.select("home", "part", "cell_id", "r", "c", "ds_id", "ds_travel_s").groupBy("home", "part")


def by_blocks(parcels: DataFrame, cells: DataFrame, flow: DataFrame, travel: DataFrame, dt_s: float, saved: DataFrame, steps: DataFrame, keep: list[int] | None = None, tile: int = TILE, halo: int = HALO, most_parcels: int = MOST_PARCELS, sink: bool = True) -> Routed:
    """Routes ``parcels`` (cell_id, step0, n, vol[, tau]) over ``cells`` (cell_id, r, c) through ``steps``; see :class:`Routed`.

    ``flow``: (cell_id, ds_id), ``travel``: (node, travel_s), ``saved``: the run's output steps, ``keep``: steps whose states are kept.
    Without ``sink`` parcels stay in a cell that has no next one.
    Sizes of blocks are broadcast: one row for each ``tile`` x ``tile`` cells.
    """
    first, last = (int(x) for x in steps.agg(F.min("step"), F.max("step")).first())
    outputs = np.array(sorted(r[0] for r in saved.select("step").distinct().collect()), np.int64)  # output steps of a run
    chosen = np.array(sorted({k for k in keep or () if first <= k <= last}), np.int64)
    net, region = _around(cells, flow, travel, tile, halo)
    tau = F.coalesce(F.col("tau"), F.lit(0.0)) if "tau" in parcels.columns else F.lit(0.0)
    at = parcels.where(F.col("step0") <= last).select("cell_id", F.col("step0").cast("int").alias("step0"), tau.cast("double").alias("tau"), "n", "vol")
    waiting = at.join(net.select("cell_id", "r", "c"), "cell_id")
    given = []

    def advance(group: pa.Table, around: pa.Table) -> pa.Table:
        return advanced(group, around, dt_s, first, last, outputs, chosen, sink)

    while True:
        p = waiting.groupBy(_block("r", "c", tile).alias("block"), "cell_id", "step0", "tau").agg(F.sum("n").cast("long").alias("n"), F.sum("vol").cast("double").alias("vol"))
        groups = _shared(cut(p), region, most_parcels, "cell_id", "step0", "tau")
        if groups is None:
            break
        left, right = groups
        found = cut(left.cogroup(right).applyInArrow(advance, _SCHEMA))
        given.append(found)
        crossing = found.where(F.col("kind") == CROSSING)
        if crossing.isEmpty():
            break
        waiting = crossing.select(F.col("node").alias("cell_id"), F.col("step").alias("step0"), "tau", "n", "vol", "r", "c")
    every = given[0] if given else steps.sparkSession.createDataFrame([], _SCHEMA)
    for more in given[1:]:
        every = every.unionByName(more)
    of = lambda kind: every.where(F.col("kind") == kind)
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("vol").alias("vol"))
    by_step = of(INSIDE).groupBy("step").agg(F.sum("vol").alias("change"))
    so_far = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one row a step: a run's clock
    inside = steps.select("step").join(by_step, "step", "left").select("step", F.sum(F.coalesce("change", F.lit(0.0))).over(so_far).alias("vol"))
    kept = total(of(KEPT), "step", F.col("node").alias("cell_id"), "tau").select("step", "cell_id", "tau", "n", "vol")
    moved = of(MOVED).groupBy("step").agg(F.sum("n").alias("moved"))
    return Routed(total(of(PLACED), "step", "node"), total(of(OUT), "node", "step"), inside, kept, moved)


def walked(walkers: pa.Table, region: pa.Table, dt_s: float, last: int) -> pa.Table:
    """Rows of ``_WALKED``: where and in which step a block's walkers leave the grid, or cross to another block; none for those that
    do neither up to step ``last``."""
    net = _Net(region)
    at = net.places(walkers.column("cell_id").to_numpy())
    origin, step, tau = (walkers.column(c).to_numpy() for c in ("origin", "step", "tau"))
    step = step.astype(np.int64)
    if (net.down[at] == -2).any():
        raise ValueError("water must flow to a neighbouring cell")
    found = {OUT: [], CROSSING: []}
    while len(at):
        hop = step + waiting_steps(tau, dt_s) - 1
        ahead, left = net.down[at], (net.down[at] == -1) & (hop <= last)
        found[OUT].append((origin[left], hop[left], at[left], tau[left]))
        go = (ahead >= 0) & (hop <= last)
        origin, at, tau, step, hop, ahead = (x[go] for x in (origin, at, tau, step, hop, ahead))
        tau, at, step = tau - (hop - step + 1) * dt_s + net.wait[at], ahead, hop + 1
        edge = net.down[at] == -2
        if edge.any():
            found[CROSSING].append((origin[edge], step[edge], at[edge], tau[edge]))
            origin, at, tau, step = (x[~edge] for x in (origin, at, tau, step))
    parts = []
    for kind, rows in found.items():
        who, when, where, waits = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        columns = [np.full(len(who), kind, np.int32), who.astype(np.int64), when.astype(np.int32), net.cell[where].astype(np.int64), net.r[where].astype(np.int32), net.c[where].astype(np.int32), waits.astype(np.float64)]
        parts.append(pa.table(columns, names=[x.split()[0] for x in _WALKED.split(", ")]))
    return pa.concat_tables(parts)


def exits(origins: DataFrame, cells: DataFrame, flow: DataFrame, travel: DataFrame, dt_s: float, steps: int, tile: int = TILE, halo: int = HALO, most_parcels: int = MOST_PARCELS) -> DataFrame:
    """(cell_id, node, after): a parcel spawned in a cell of ``origins`` (cell_id) in step s leaves the grid from ``node`` in step
    s + after. Cells whose parcels need ``steps`` steps or more have no row.

    A path does not depend on the step it begins in, so one walker a cell stands for the parcels of all steps. Walkers go by
    blocks as the parcels of :func:`by_blocks` do, in as many rounds.
    """
    net, region = _around(cells, flow, travel, tile, halo)
    waiting = origins.select("cell_id").distinct().join(net.select("cell_id", "r", "c"), "cell_id").select(F.col("cell_id").alias("origin"), "cell_id", "r", "c", F.lit(0).alias("step"), F.lit(0.0).alias("tau"))
    given = []

    def walk(group: pa.Table, around: pa.Table) -> pa.Table:
        return walked(group, around, dt_s, steps - 1)

    while True:
        groups = _shared(waiting.select(_block("r", "c", tile).alias("block"), "origin", "cell_id", "step", "tau"), region, most_parcels, "origin")
        if groups is None:
            break
        found = cut(groups[0].cogroup(groups[1]).applyInArrow(walk, _WALKED))
        given.append(found.where(F.col("kind") == OUT).select(F.col("origin").alias("cell_id"), "node", F.col("step").alias("after")))
        crossing = found.where(F.col("kind") == CROSSING)
        if crossing.isEmpty():
            break
        waiting = crossing.select("origin", F.col("node").alias("cell_id"), "r", "c", "step", "tau")
    every = given[0] if given else cells.sparkSession.createDataFrame([], "cell_id long, node long, after int")
    for more in given[1:]:
        every = every.unionByName(more)
    return every
