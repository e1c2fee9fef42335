"""Routing by blocks against the literal clock: small squares and margins, shares, restarts, states, odd waiting times."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.operators import flow as L
from pluvia.operators import products as P
from pluvia.operators import routing as B
from pluvia.plans import queries as Q

ROWS, COLS, DT, LAST = 13, 11, 5.0, 24


@pytest.fixture(scope="module")
def water(spark):
    """A grid that flows at random to neighbours without cycles (to a higher number), with sinks, and parcels of several steps."""
    rng = np.random.default_rng(9)
    cells, flow, travel = [], [], []
    for r in range(ROWS):
        for c in range(COLS):
            k = r * COLS + c
            ahead = [(r + i) * COLS + c + j for i, j in ((0, 1), (1, -1), (1, 0), (1, 1)) if r + i < ROWS and 0 <= c + j < COLS]
            cells.append((k, r, c))
            flow.append((k, int(rng.choice(ahead)) if ahead and rng.random() < 0.97 else None))
            travel.append((k, float(rng.choice([0.5, 1.0, 5.0, 7.0, 12.0, 33.0]))))
    parcels = [(int(rng.integers(ROWS * COLS)), int(rng.integers(0, 20)), int(rng.integers(1, 5)), float(rng.integers(1, 9))) for _ in range(300)]
    steps = spark.range(LAST + 1).select(F.col("id").cast("int").alias("step"))
    return (
        spark.createDataFrame(parcels, "cell_id long, step0 int, n long, vol double"), spark.createDataFrame(cells, "cell_id long, r int, c int"),
        spark.createDataFrame(flow, "cell_id long, ds_id long"), spark.createDataFrame(travel, "node long, travel_s double"), steps,
    )


def _rows(routed):
    take = lambda df, *names: sorted(tuple(r[c] for c in names) for r in df.collect())
    inside = [(r["step"], round(r["vol"], 6)) for r in routed.inside.orderBy("step").collect()]
    return take(routed.placed, "step", "node", "n", "vol"), take(routed.outflow.where("n > 0"), "node", "step", "n", "vol"), inside


@pytest.fixture(scope="module")
def literal(water):
    parcels, _, flow, travel, steps = water
    return _rows(L.by_supersteps(parcels, flow, travel, DT, steps.where("step % 3 = 1"), steps))


@pytest.mark.parametrize(("tile", "halo", "most"), [(512, 64, 1_000_000), (4, 1, 1_000_000), (3, 2, 7), (2, 5, 40)])
def test_blocks_equal_the_literal_clock(water, literal, tile, halo, most):
    parcels, cells, flow, travel, steps = water
    assert _rows(B.by_blocks(parcels, cells, flow, travel, DT, steps.where("step % 3 = 1"), steps, tile=tile, halo=halo, most_parcels=most)) == literal


def test_states_go_on(water, literal):
    parcels, cells, flow, travel, steps = water
    saved = steps.where("step % 3 = 1")
    first = B.by_blocks(parcels.where("step0 <= 10"), cells, flow, travel, DT, saved, steps.where("step <= 10"), [4, 10], tile=3, halo=1)
    state = first.kept.where("step = 10").select("cell_id", (F.col("step") + 1).alias("step0"), "tau", "n", "vol")
    then = B.by_blocks(parcels.where("step0 > 10").withColumn("tau", F.lit(None).cast("double")).unionByName(state), cells, flow, travel, DT, saved, steps.where("step > 10"), tile=5, halo=2)
    whole = [sorted([*a, *b]) for a, b in zip(_rows(first), _rows(then), strict=True)]
    assert whole == [sorted(x) for x in literal]
    # what is kept is what is inside
    kept = {r[0]: r[1] for r in first.kept.groupBy("step").agg(F.sum("vol")).collect()}
    inside = {r["step"]: r["vol"] for r in first.inside.collect()}
    assert kept == pytest.approx({k: inside[k] for k in (4, 10)})


def test_particles_that_move(water):
    parcels, cells, flow, travel, steps = water
    got = {r["step"]: r["moved"] for r in B.by_blocks(parcels, cells, flow, travel, DT, steps.limit(0), steps, tile=4, halo=2).moved.collect()}
    f = flow.join(travel.select(F.col("node").alias("ds_id"), F.col("travel_s").alias("ds_travel_s")), "ds_id", "left").collect()
    down = {r["cell_id"]: (r["ds_id"], r["ds_travel_s"]) for r in f}
    want = dict.fromkeys(range(LAST + 1), 0)
    for p in parcels.collect():
        at, tau = p["cell_id"], 0.0
        for step in range(p["step0"], LAST + 1):
            tau -= DT
            if tau <= 1e-9:
                want[step] += p["n"]
                at, wait = down[at]
                if at is None:
                    break
                tau += wait
    assert got == {k: v for k, v in want.items() if v}


def test_without_a_sink_water_stays(water):
    parcels, cells, flow, travel, steps = water
    kept = B.by_blocks(parcels, cells, flow, travel, DT, steps.where("step = 24"), steps, tile=4, halo=2, sink=False)
    assert kept.outflow.count() == 0 and kept.placed.agg(F.sum("vol")).first()[0] == parcels.agg(F.sum("vol")).first()[0] == kept.inside.where("step = 24").first()["vol"]
    ends = {r["cell_id"] for r in flow.where("ds_id is null").collect()}
    gone = B.by_blocks(parcels, cells, flow, travel, DT, steps.where("step = 24"), steps)
    moving = lambda x: {(r["node"], r["vol"]) for r in x.placed.collect() if r["node"] not in ends}
    assert moving(kept) == moving(gone)


def test_nothing_to_route_and_water_that_jumps(spark, water):
    parcels, cells, flow, travel, steps = water
    none = B.by_blocks(parcels.limit(0), cells, flow, travel, DT, steps, steps)
    assert none.placed.count() == none.outflow.count() == none.kept.count() == 0 and none.inside.where("vol <> 0").count() == 0
    far = spark.createDataFrame([(0, 142)], "cell_id long, ds_id long")
    with pytest.raises(Exception, match="neighbouring"):
        B.by_blocks(spark.createDataFrame([(0, 0, 1, 1.0)], "cell_id long, step0 int, n long, vol double"), cells, far, travel, DT, steps, steps, tile=2, halo=1)


def test_rounds_follow_the_margin_not_the_depth(spark):
    """A channel of 400 cells through squares of 8 with margins of 40: eleven exchanges at most."""
    n = 400
    cells = spark.range(n).select(F.col("id").alias("cell_id"), F.lit(0).alias("r"), F.col("id").cast("int").alias("c"))
    flow = spark.range(n).select(F.col("id").alias("cell_id"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("ds_id"))
    travel = spark.range(n).select(F.col("id").alias("node"), F.lit(1.0).alias("travel_s"))
    steps = spark.range(n + 1).select(F.col("id").cast("int").alias("step"))
    parcels = spark.createDataFrame([(0, 0, 3, 2.0)], "cell_id long, step0 int, n long, vol double")
    rounds, real = [], B.cut
    B.cut = lambda df: rounds.append(df.columns) or real(df)
    try:
        out = B.by_blocks(parcels, cells, flow, travel, 5.0, steps.limit(0), steps, tile=8, halo=40)
        assert [tuple(r) for r in out.outflow.select("node", "step", "n", "vol").collect()] == [(n - 1, n - 1, 3, 2.0)]
    finally:
        B.cut = real
    assert sum("kind" in c for c in rounds) <= n / 40 + 1


@pytest.mark.parametrize(("tile", "halo", "most"), [(512, 64, 1_000_000), (4, 1, 1_000_000), (3, 2, 7)])
def test_walkers_leave_as_the_parcels_of_the_literal_clock(water, literal, tile, halo, most):
    parcels, cells, flow, travel, steps = water
    out = B.exits(parcels, cells, flow, travel, DT, LAST + 1, tile=tile, halo=halo, most_parcels=most)
    assert out.count() == out.select("cell_id").distinct().count()
    left = parcels.join(out, "cell_id").withColumn("step", F.col("step0") + F.col("after")).where(F.col("step") <= LAST).groupBy("node", "step").agg(F.sum("n").alias("n"), F.sum("vol").alias("vol"))
    assert sorted((r["node"], r["step"], r["n"], r["vol"]) for r in left.collect()) == literal[1]


def test_the_balance_of_stays_is_that_of_the_literal_clock(water):
    parcels, cells, flow, travel, steps = water
    runoff = parcels.groupBy("cell_id", F.col("step0").alias("step")).agg(F.sum("vol").alias("dq_mm")).select("cell_id", "step", (F.col("dq_mm") * 2).alias("rain_mm"), "dq_mm", F.lit(1000.0).alias("area_m2"))
    dry = steps.select(F.lit(0).cast("long").alias("cell_id"), "step", F.lit(3.0).alias("rain_mm"), F.lit(0.0).alias("dq_mm"), F.lit(1000.0).alias("area_m2"))
    runoff = runoff.unionByName(dry)
    clock = L.by_supersteps(parcels, flow, travel, DT, steps.limit(0), steps)
    want = P.volume_balance(runoff, clock.outflow, clock.inside).orderBy("step").collect()
    got = P.balance_of_stays(runoff, B.exits(parcels, cells, flow, travel, DT, LAST + 1, tile=4, halo=2), steps).orderBy("step").collect()
    assert len(got) == len(want) == LAST + 1 and any(r["outflow_m3"] for r in want)
    for a, b in zip(got, want, strict=True):
        assert a.asDict() == pytest.approx(b.asDict())


def test_the_balance_routes_one_walker_a_cell(spark, monkeypatch):
    rows, real = [], B._shared
    monkeypatch.setattr(B, "_shared", lambda p, *rest: rows.append(p.count()) or real(p, *rest))
    assert Q.volume_balance(spark, "/root/testdata/sf0.001").count() == Q.X.n_steps(spark, "/root/testdata/sf0.001")
    assert rows and max(rows) <= Q.X.grid(spark, "/root/testdata/sf0.001").where("active").count()


def test_nothing_to_walk_and_water_that_jumps(spark, water):
    parcels, cells, flow, travel, steps = water
    assert B.exits(parcels.limit(0), cells, flow, travel, DT, 5).count() == 0
    with pytest.raises(Exception, match="neighbouring"):
        B.exits(cells.limit(1).select(F.lit(0).cast("long").alias("cell_id")), cells, spark.createDataFrame([(0, 142)], "cell_id long, ds_id long"), travel, DT, 5, tile=2, halo=1).count()
