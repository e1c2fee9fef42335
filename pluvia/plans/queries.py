"""One query for each operator family of the engine, with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions import scalars as S
from pluvia.operators import alerts as A
from pluvia.operators import flow as L
from pluvia.operators import grid as G
from pluvia.operators import products as P
from pluvia.operators import rain as R
from pluvia.operators import routing as B
from pluvia.operators import stations as T
from pluvia.operators import zonal as Z
from pluvia.plans import domains
from pluvia.plans import fixtures as X
from pluvia.plans.storage import dealt

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def rnd(name: str, places: int = 6):
    return F.round(F.col(name), places).alias(name)


# --- grid ----------------------------------------------------------------------------------------------------------


@query(f"WITH {X.GRID} SELECT cell_id, r, c, dem, cn, channel, round(x, 6) AS x, round(y, 6) AS y FROM grid WHERE active")
def grid_scan(spark: SparkSession, d: str) -> DataFrame:
    g = G.clean_domain(X.grid(spark, d).drop("active")).where("active")
    return g.select("cell_id", "r", "c", "dem", "cn", (F.col("cell_id") % 7 == 0).alias("channel"), rnd("x"), rnd("y"))


@query(f"WITH {X.GRID}, {X.D8} SELECT cell_id, d8 FROM d8")
def d8_from_dem(spark, d):
    return G.d8_from_dem(X.grid(spark, d), X.DX, X.DY)


@query(f"WITH {X.GRID}, {X.D8} SELECT cell_id, ds_id FROM flow")
def downstream_index(spark, d):
    return G.downstream(X.directed(X.grid(spark, d)))


@query(f"WITH {X.GRID} SELECT r, round(min(area_m2), 3) AS area_m2, count(*) AS cells FROM grid GROUP BY r")
def cell_area_sphere(spark, d):
    return X.grid(spark, d).groupBy("r").agg(F.round(F.min("area_m2"), 3).alias("area_m2"), F.count("*").alias("cells"))


HOP = "CASE WHEN d8 IN (1,4,16,64) THEN sqrt(area_m2) WHEN d8 IN (2,8,32,128) THEN sqrt(area_m2) * sqrt(2.0::DOUBLE) ELSE 0 END"


@query(f"WITH {X.GRID}, {X.D8} SELECT f.cell_id, round({HOP}, 4) AS hop_m FROM flow f JOIN grid USING (cell_id)")
def hop_distance(spark, d):
    g = X.directed(X.grid(spark, d))
    return g.select("cell_id", F.round(S.hop_distance_m(F.col("area_m2"), F.col("d8")), 4).alias("hop_m"))


def _travel(g: DataFrame) -> DataFrame:
    """(node, travel_s): whole seconds to enter a cell, by channel."""
    hop = S.hop_distance_m(F.col("area_m2"), F.col("d8"))
    t = F.when(F.col("channel"), S.auto_travel_s(hop, 1.5, 0.25, 3600.0)).otherwise(S.auto_travel_s(hop, 0.5, 0.25, 3600.0))
    return g.select(F.col("cell_id").alias("node"), F.round(t).alias("travel_s"))


TRAVEL = f"travel AS (SELECT f.cell_id AS node, round(least(greatest(({HOP}) / CASE WHEN channel THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END, 0.25), 3600.0)) AS travel_s FROM flow f JOIN grid USING (cell_id))"


@query(f"WITH {X.GRID}, {X.D8}, {TRAVEL} SELECT node, travel_s FROM travel")
def travel_time_auto(spark, d):
    return _travel(X.directed(X.grid(spark, d)))


@query(f"WITH {X.GRID} SELECT cell_id, round(x, 6) AS x, round(y, 6) AS y FROM grid WHERE x BETWEEN 10.055 AND 10.205 AND y BETWEEN 44.705 AND 44.955")
def bbox_filter(spark, d):
    return G.within(X.grid(spark, d), 10.055, 44.705, 10.205, 44.955).select("cell_id", rnd("x"), rnd("y"))


SLAB = "CAST(least(floor((sum(cells) OVER (ORDER BY r) - cells / 2.0::DOUBLE) / sum(cells) OVER () * 8), 7) AS INTEGER)"


@query(f"WITH {X.GRID}, rows_ AS (SELECT r, sum(active::INT)::BIGINT AS cells FROM grid GROUP BY r) SELECT r, cells, {SLAB} AS slab FROM rows_")
def slab_partition(spark, d):
    return G.slabs(X.grid(spark, d), 8)


@query("SELECT n_nationkey, CAST(round(10 + ceil((10.003 + n_nationkey * 0.004 - 10) / 0.01 - 1e-9) * 0.01, 6) AS DOUBLE) AS west, CAST(round(10 + floor((10.1 + n_nationkey * 0.013 - 10) / 0.01 + 1e-9) * 0.01, 6) AS DOUBLE) AS east, CAST(0.0025 AS DOUBLE) AS dx FROM nation")
def snap_bbox(spark, d):
    n = [r[0] for r in X.read(spark, d, "nation").select("n_nationkey").collect()]  # one row for each configured domain
    rows = []
    for k in n:
        b = G.snapped_box(10.003 + k * 0.004, 44.0, 10.1 + k * 0.013, 44.5, 10.0, 44.0, X.DX, X.DY, 4)
        rows.append((k, round(b["west"], 6), round(b["east"], 6), round(b["dx"], 6)))
    return spark.createDataFrame(rows, "n_nationkey int, west double, east double, dx double")


@query("""WITH RECURSIVE o AS (SELECT n_nationkey AS k, 0 AS level FROM nation WHERE n_nationkey = 0
  UNION ALL SELECT n.n_nationkey, level + 1 FROM nation n JOIN o ON n.n_nationkey > 0 AND (n.n_nationkey - 1) // 3 = o.k)
SELECT 'NATION_' || k AS name, level FROM o""")
def domain_toposort(spark, d):
    keys = [r[0] for r in X.read(spark, d, "nation").select("n_nationkey").collect()]
    order = domains.run_order({f"NATION_{k}": f"NATION_{(k - 1) // 3}" if k else None for k in keys})
    return spark.createDataFrame([(name, level) for level, name in order], "name string, level int")


# --- rain and runoff ---------------------------------------------------------------------------------------------------


def _picked(spark, d, select):
    return R.pick_slices(X.steps(spark, d), X.slices(spark, d), select)


_AS = f"WITH {X.SLICES}, {X.STEPS}, pairs AS (SELECT s.source, step, k, s.t AS st, steps.t AS t FROM slices s CROSS JOIN steps)"
_PREVIOUS = "SELECT source, step, k FROM pairs QUALIFY row_number() OVER (PARTITION BY source, step ORDER BY (st > t), CASE WHEN st <= t THEN -epoch(st) ELSE epoch(st) END) = 1"


@query(f"{_AS} {_PREVIOUS}")
def rain_previous(spark, d):
    return _picked(spark, d, "previous")


@query(f"{_AS} SELECT source, step, k FROM pairs QUALIFY row_number() OVER (PARTITION BY source, step ORDER BY abs(epoch(st) - epoch(t)), st) = 1")
def rain_nearest(spark, d):
    return _picked(spark, d, "nearest")


@query(f"WITH {X.SLICES}, {X.STEPS}, n AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY t) - 1 AS place, count(*) OVER (PARTITION BY source) - 1 AS last FROM slices) SELECT source, step, k FROM n JOIN steps ON place = least(step, last)")
def rain_step(spark, d):
    return _picked(spark, d, "step")


def _rates(spark, d):
    """Rates of slices at cells; the grid is cut into five classes of rain, so that a slice is a small table times the grid."""
    g = dealt(X.grid(spark, d).where("active").select("cell_id", (1 + (F.col("cell_id") % 5) / 10.0).alias("factor")), "cell_id")
    s = F.broadcast(X.slices(spark, d).select("source", "k", "base"))  # a month's slices of five sources
    return g.join(s, F.lit(True)).select("source", "k", "cell_id", (F.col("base") * F.col("factor") * 0.2).alias("rate"))


def _blended(spark, d, steps="true"):
    return R.blend(_picked(spark, d, "previous").where(steps), _rates(spark, d), X.WEIGHTS, "intensity_mmph", X.STEP_S)


_RAIN = f"""WITH {X.GRID}, {X.SLICES}, {X.STEPS}, pairs AS (SELECT s.source, step, k, base, s.t AS st, steps.t AS t FROM slices s CROSS JOIN steps),
picked AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY source, step ORDER BY (st > t), CASE WHEN st <= t THEN -epoch(st) ELSE epoch(st) END) = 1),
rain AS (SELECT step, cell_id, sum(greatest(base * (1 + (cell_id % 5) / 10.0::DOUBLE) * 0.2::DOUBLE, 0) * 21600 / 3600.0::DOUBLE * CASE source WHEN 'click' THEN 0.5::DOUBLE WHEN 'view' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END) AS rain_mm
  FROM picked CROSS JOIN grid WHERE active AND source IN ('click', 'view', 'purchase') GROUP BY ALL),
cum AS (SELECT step, cell_id, cn, area_m2, rain_mm, sum(rain_mm) OVER (PARTITION BY cell_id ORDER BY step) AS p, 25400.0::DOUBLE / cn - 254.0::DOUBLE AS s FROM rain JOIN grid USING (cell_id)),
q AS (SELECT *, CASE WHEN p > 0.2::DOUBLE * s THEN (p - 0.2::DOUBLE * s) * (p - 0.2::DOUBLE * s) / (p - 0.2::DOUBLE * s + s) ELSE 0 END AS q FROM cum),
runoff AS (SELECT *, greatest(q - coalesce(lag(q) OVER (PARTITION BY cell_id ORDER BY step), 0), 0) AS dq FROM q)"""


@query(f"{_RAIN} SELECT step, cell_id, round(rain_mm, 6) AS rain_mm FROM rain")
def rain_blend(spark, d):
    return _blended(spark, d).select("step", "cell_id", rnd("rain_mm"))


@query(f"{_AS}, p AS ({_PREVIOUS}) SELECT source, step, k FROM p QUALIFY k IS DISTINCT FROM lag(k) OVER (PARTITION BY source ORDER BY step)")
def rain_advance(spark, d):
    return R.advances(_picked(spark, d, "previous"))


def _scs(spark, d, compat):
    g = X.grid(spark, d).select("cell_id", "cn", F.explode(F.array(*(F.lit(float(p)) for p in (0, 20, 50, 100, 250)))).alias("p"))
    return g.select("cell_id", "p", F.round(S.scs_runoff_mm(F.col("p"), F.col("cn"), 0.2, compat), 6).alias("q_mm"))


_SCS = f"WITH {X.GRID}, a AS (SELECT cell_id, p, 25400.0::DOUBLE / cn - 254 AS s FROM grid, (VALUES (0.0::DOUBLE), (20), (50), (100), (250)) v(p)), b AS (SELECT *, CASE WHEN p > 0.2::DOUBLE * s THEN pow(p - 0.2::DOUBLE * s, 2) / (p + 0.8::DOUBLE * s) ELSE 0 END AS q FROM a)"


@query(f"{_SCS} SELECT cell_id, p, round(q, 6) AS q_mm FROM b")
def scs_runoff(spark, d):
    return _scs(spark, d, "documented")


@query(f"{_SCS} SELECT cell_id, p, round(CASE WHEN q > 0 THEN q * q / (q + s) ELSE 0 END, 6) AS q_mm FROM b")
def scs_runoff_as_coded(spark, d):
    return _scs(spark, d, "as_coded")


def _runoff(spark, d):
    g = X.grid(spark, d)
    return R.runoff_steps(_blended(spark, d), g).join(g.select("cell_id", "area_m2"), "cell_id")


@query(f"{_RAIN} SELECT step, cell_id, round(p, 6) AS p_cum_mm, round(q, 6) AS q_cum_mm, round(dq, 6) AS dq_mm FROM runoff")
def runoff_increment(spark, d):
    return _runoff(spark, d).select("step", "cell_id", rnd("p_cum_mm"), rnd("q_cum_mm"), rnd("dq_mm"))


#: Parcels for routing: one batch for each active cell, spawned at step id % 4, of whole cubic metres.
def _parcels(spark, d):
    g = X.grid(spark, d).where("active")
    return g.select("cell_id", (F.col("cell_id") % 4).cast("int").alias("step0"), (F.col("cell_id") % 5 + 1).cast("long").alias("n"), (F.col("cell_id") % 11 + 1).cast("double").alias("vol"))


_PARCELS = "parcels AS (SELECT cell_id, CAST(cell_id % 4 AS INTEGER) AS step0, cell_id % 5 + 1 AS n, CAST(cell_id % 11 + 1 AS DOUBLE) AS vol FROM grid WHERE active)"
DT = 600.0


@query(f"{_RAIN} SELECT cell_id, step AS step0, greatest(CAST(round_even(dq / 1000 * area_m2 / 50000.0::DOUBLE, 0) AS BIGINT), 1) AS n, round(dq / 1000 * area_m2, 3) AS vol FROM runoff WHERE dq > 0")
def spawn_particles(spark, d):
    return L.spawn(_runoff(spark, d), 50000.0).select("cell_id", "step0", "n", rnd("vol", 3))


@query(f"WITH {X.GRID}, {_PARCELS} SELECT cell_id, step0, CAST(i AS BIGINT) AS particle, round(vol / n, 6) AS vol FROM parcels, unnest(range(1, n + 1)) u(i)")
def particle_explode(spark, d):
    return L.exploded(_parcels(spark, d)).select("cell_id", "step0", "particle", rnd("vol"))


# --- flow --------------------------------------------------------------------------------------------------------------


def _flow(spark, d):
    g = X.directed(X.grid(spark, d))
    return g, G.downstream(g)


_WALK = "walk AS (SELECT cell_id AS src, cell_id AS cur, 0 AS j FROM grid UNION ALL SELECT src, ds_id, j + 1 FROM walk JOIN flow ON flow.cell_id = cur JOIN grid g ON g.cell_id = cur WHERE ds_id IS NOT NULL AND g.active)"


@query(f"WITH RECURSIVE {X.GRID}, {X.D8}, {_WALK} SELECT cur AS cell_id, round(sum(CASE WHEN active THEN area_m2 ELSE 0 END), 1) AS acc_m2 FROM walk JOIN grid ON grid.cell_id = src GROUP BY cur")
def flow_accumulation(spark, d):
    g, f = _flow(spark, d)
    return L.flow_accumulation(g.select("cell_id", "active", "area_m2"), f).select("cell_id", rnd("acc_m2", 1))


def _schedule(spark, d, hops=None):
    g, f = _flow(spark, d)
    return L.hop_schedule(L.paths(f, hops), _travel(g), DT), f, g


def _by_blocks(spark, d, last, saved=()):
    """The parcels' run up to step ``last`` by blocks, and the grid."""
    g, f = _flow(spark, d)
    clock = spark.range(last + 1).select(F.col("id").cast("int").alias("step"))
    at = spark.createDataFrame([(s,) for s in saved], "step int")
    return B.by_blocks(_parcels(spark, d), g.select("cell_id", "r", "c"), f, _travel(g), DT, at, clock), g


#: The literal clock: waiting time goes down by dt each step, at most one hop a step, out where there is no next cell.
_CLOCK = f"""WITH RECURSIVE {X.GRID}, {X.D8}, {TRAVEL}, {_PARCELS},
moves AS (SELECT cell_id AS src, step0, n, vol, cell_id AS cur, 0.0::DOUBLE AS tau, step0 - 1 AS step, FALSE AS gone, cell_id AS prev FROM parcels
  UNION ALL SELECT src, step0, n, vol, CASE WHEN tau - 600 <= 1e-9 THEN ds_id ELSE cur END, CASE WHEN tau - 600 <= 1e-9 THEN tau - 600 + coalesce(travel_s, 0) ELSE tau - 600 END,
    step + 1, tau - 600 <= 1e-9 AND ds_id IS NULL, cur FROM moves JOIN flow ON flow.cell_id = cur LEFT JOIN travel ON node = ds_id WHERE NOT gone AND step < 60)"""


@query(f"{_CLOCK} SELECT src AS cell_id, step - step0 AS \"offset\", cur AS node FROM moves WHERE cur IS NOT NULL AND cur <> prev AND step <= 39")
def hop_schedule(spark, d):
    s, _, _ = _schedule(spark, d, 42)  # a hop takes a step at least
    p = _parcels(spark, d)
    return s.where("j > 0").join(p.select("cell_id", "step0"), "cell_id").where("step0 + `offset` <= 39").select("cell_id", F.col("offset").cast("int").alias("offset"), "node")


@query(f"{_CLOCK} SELECT cur AS node, sum(n)::BIGINT AS n, round(sum(vol), 6) AS vol FROM moves WHERE step = 19 AND NOT gone OR gone AND step <= 19 GROUP BY cur")
def advect_k_steps(spark, d):
    s, _, _ = _schedule(spark, d, 21)
    return L.advect(_parcels(spark, d), s, 19).select("node", "n", rnd("vol"))


@query(f"{_CLOCK} SELECT cur AS node, sum(n)::BIGINT AS n, round(sum(vol), 6) AS vol FROM moves WHERE step = 7 AND NOT gone OR gone AND step <= 7 GROUP BY cur")
def advect_supersteps(spark, d):
    g, f = _flow(spark, d)
    f = f.join(_travel(g).select(F.col("node").alias("ds_id"), F.col("travel_s").alias("ds_travel_s")), "ds_id", "left").select("cell_id", "ds_id", "ds_travel_s")
    state = None
    for step in range(8):
        new = _parcels(spark, d).where(F.col("step0") == step).select("cell_id", F.lit(0.0).alias("tau"), "n", "vol")
        now = new if state is None else state.where("cell_id is not null").unionByName(new)
        moved = L.superstep(now, f, DT)
        gone = None if state is None else state.where("cell_id is null")
        state = L.cut(moved if gone is None else moved.unionByName(gone))
    return state.groupBy(F.col("cell_id").alias("node")).agg(F.sum("n").alias("n"), F.round(F.sum("vol"), 6).alias("vol"))


def _outflow(spark, d):
    return _by_blocks(spark, d, 60)[0].outflow.where("n > 0")


@query(f"{_CLOCK} SELECT prev AS node, CAST((step + 1) * 600 // 3600 AS INTEGER) AS k, sum(n)::BIGINT AS n, round(sum(vol), 6) AS vol FROM moves WHERE gone GROUP BY ALL")
def outflow_by_interval(spark, d):
    e = _outflow(spark, d)
    return e.groupBy("node", F.floor((F.col("step") + 1) * DT / 3600).cast("int").alias("k")).agg(F.sum("n").alias("n"), F.round(F.sum("vol"), 6).alias("vol"))


@query(f"""{_CLOCK}, e AS (SELECT prev AS node, CAST((step + 1) * 600 // 3600 AS INTEGER) AS k, sum(n)::BIGINT AS n FROM moves WHERE gone GROUP BY ALL),
f AS (SELECT node, i FROM (SELECT DISTINCT node FROM e), unnest(range((SELECT min(k) FROM e), (SELECT max(k) + 1 FROM e))) u(i))
SELECT f.node, (SELECT min(k) FROM e) AS base, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY i) AS counts, sum(coalesce(n, 0))::BIGINT AS total FROM f LEFT JOIN e ON e.node = f.node AND e.k = i GROUP BY f.node""")
def outflow_array(spark, d):
    a = L.outflow_arrays(_outflow(spark, d), 3600.0, DT)
    return a.select("node", "base", F.array_join(F.col("particles_per_interval").cast("array<string>"), ",").alias("counts"), "total")


_DEPTH = f"{_CLOCK}, v AS (SELECT cur, sum(vol) AS vol FROM moves WHERE step = 19 AND NOT gone GROUP BY cur), depth AS (SELECT cell_id, CASE WHEN active THEN coalesce(vol, 0) / area_m2 END AS depth_m, active FROM grid LEFT JOIN v ON cur = cell_id)"


def _depth(spark, d):
    routed, g = _by_blocks(spark, d, 19, [19])
    return P.flood_depth(routed.placed.drop("step"), g)


@query(f"{_DEPTH} SELECT cell_id, round(depth_m * 1e6, 4) AS depth_um FROM depth")
def flood_depth(spark, d):
    return _depth(spark, d).select("cell_id", F.round(F.col("depth_m") * 1e6, 4).alias("depth_um"))


@query(f"{_DEPTH} SELECT cell_id, CAST(active AND coalesce(depth_m >= 1e-5, FALSE) AS INTEGER) AS inundated FROM depth")
def inundation_mask(spark, d):
    return _depth(spark, d).select("cell_id", S.inundated(F.col("depth_m"), F.col("depth_m").isNotNull(), 1e-5).cast("int").alias("inundated"))


_OUT_STEPS = "step % 6 = 5"


@query(f"{_RAIN} SELECT step, cell_id, round(max(dq / 1000) OVER (PARTITION BY cell_id ORDER BY step), 9) AS depth_max_m, CAST(max(dq / 1000) OVER (PARTITION BY cell_id ORDER BY step) >= 0.001::DOUBLE AS INTEGER) AS inundated_max FROM runoff WHERE {_OUT_STEPS}")
def running_max_depth(spark, d):
    r = _runoff(spark, d).where(_OUT_STEPS).select("step", "cell_id", (F.col("dq_mm") / 1000).alias("depth_m"))
    return P.running_max(r, 0.001).select("step", "cell_id", rnd("depth_max_m", 9), F.col("inundated_max").cast("int").alias("inundated_max"))


# --- risk, balance -----------------------------------------------------------------------------------------------------


def _risk_cells(spark, d):
    g, f = _flow(spark, d)
    acc = L.flow_accumulation(g.select("cell_id", "active", "area_m2"), f)
    last = R.runoff_total(_blended(spark, d), g).select("cell_id", "q_cum_mm")
    return g.join(acc, "cell_id").join(last, "cell_id", "left").select("cell_id", "active", "acc_m2", F.coalesce("q_cum_mm", F.lit(0.0)).alias("q_cum_mm"), "x", "y", "r", "c")


_RISK = (
    _RAIN.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {X.D8}, {_WALK}, acc AS (SELECT cur AS cell_id, sum(CASE WHEN active THEN area_m2 ELSE 0 END) AS acc FROM walk JOIN grid ON grid.cell_id = src GROUP BY cur),
last AS (SELECT cell_id, q FROM runoff WHERE step = (SELECT n - 1 FROM span)), cells AS (SELECT cell_id, acc, q, x, y, r, c FROM grid JOIN acc USING (cell_id) JOIN last USING (cell_id) WHERE active),
st AS (SELECT quantile_cont(q, 0.05) AS ql, quantile_cont(q, 0.95) AS qh, quantile_cont(acc, 0.05) AS al, quantile_cont(acc, 0.95) AS ah FROM cells),
norm AS (SELECT cell_id, x, y, r, c, least(greatest((q - ql) / (qh - ql), 0), 1) AS qn, least(greatest((acc - al) / (ah - al), 0), 1) AS an FROM cells, st),
risk AS (SELECT *, 0.55::DOUBLE * qn + (1 - 0.55::DOUBLE) * qn * an AS risk FROM norm)"""
)


@query(f"{_RISK} SELECT cell_id, round(qn, 6) AS q_cum_mm_norm FROM norm")
def robust_normalize(spark, d):
    return P.robust_normalize(_risk_cells(spark, d).where("active"), "q_cum_mm").select("cell_id", rnd("q_cum_mm_norm"))


@query(f"{_RISK} SELECT cell_id, round(risk, 6) AS risk FROM risk")
def risk_index(spark, d):
    return P.risk_index(_risk_cells(spark, d)).select("cell_id", rnd("risk"))


@query(f"{_RISK} SELECT cell_id, round(0.3::DOUBLE * qn, 6) AS risk FROM norm")
def runoff_only_risk(spark, d):
    c = P.robust_normalize(_risk_cells(spark, d).where("active"), "q_cum_mm")
    return c.select("cell_id", F.round(S.risk_blend(F.col("q_cum_mm_norm"), F.lit(0.0), 0.3), 6).alias("risk"))


def _classes(spark, d, compat):
    e = X.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("event_id") % 500 / 100.0).alias("v"))
    return e.select("event_id", S.risk_class(F.col("v"), None, compat).alias("class"), S.risk_class(F.col("v"), (1.0, 2.0, 3.0)).alias("by_threshold"))


_V = "WITH v AS (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN event_id % 500 / 100.0::DOUBLE END AS v FROM events)"
_QUARTERS = "CASE WHEN v <= 0.25 THEN 'R1' WHEN v <= 0.5 THEN 'R2' WHEN v <= 0.75 THEN 'R3' ELSE 'R4' END"
_BY = "CASE WHEN v IS NULL THEN NULL WHEN v <= 1 THEN 'R1' WHEN v <= 2 THEN 'R2' WHEN v <= 3 THEN 'R3' ELSE 'R4' END"
_NUM = "'R' || CAST(round_even(v, 0) AS INTEGER)"


@query(f"{_V} SELECT event_id, CASE WHEN v BETWEEN 0 AND 1 THEN {_QUARTERS} WHEN v > 1 AND v <= 4.5 THEN {_NUM} END AS class, {_BY} AS by_threshold FROM v")
def risk_class(spark, d):
    return _classes(spark, d, "documented")


@query(f"{_V} SELECT event_id, CASE WHEN v >= 0.5 AND v <= 4.5 AND round_even(v, 0) BETWEEN 1 AND 4 THEN {_NUM} WHEN v BETWEEN 0 AND 1 THEN {_QUARTERS} END AS class, {_BY} AS by_threshold FROM v")
def risk_class_as_coded(spark, d):
    return _classes(spark, d, "as_coded")


def _balance(spark, d):
    """The balance of the runoff's parcels over the rain's own steps; a walker for each cell is routed by blocks."""
    g, f = _flow(spark, d)
    clock = X.steps(spark, d).select("step")
    exits = B.exits(g.where("active"), g.select("cell_id", "r", "c"), f, _travel(g), X.STEP_S, X.n_steps(spark, d))
    return P.balance_of_stays(_runoff(spark, d), exits, clock)


#: The literal clock over the rain's steps of six hours, with the parcels that the runoff makes.
_BALANCE = (
    _RAIN.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {X.D8}, {TRAVEL}, made AS (SELECT cell_id, step AS step0, dq / 1000 * area_m2 AS vol FROM runoff WHERE dq > 0),
moves AS (SELECT step0, vol, cell_id AS cur, 0.0::DOUBLE AS tau, step0 - 1 AS step, FALSE AS gone FROM made
  UNION ALL SELECT step0, vol, CASE WHEN tau - 21600 <= 1e-9 THEN ds_id ELSE cur END, CASE WHEN tau - 21600 <= 1e-9 THEN tau - 21600 + coalesce(travel_s, 0) ELSE tau - 21600 END,
    step + 1, tau - 21600 <= 1e-9 AND ds_id IS NULL FROM moves JOIN flow ON flow.cell_id = cur LEFT JOIN travel ON node = ds_id WHERE NOT gone AND step < (SELECT n - 1 FROM span)),
held AS (SELECT step, sum(CASE WHEN gone THEN vol ELSE 0 END) AS outf, sum(CASE WHEN gone THEN 0 ELSE vol END) AS stored FROM moves WHERE step >= step0 GROUP BY step),
b AS (SELECT step, sum(rain_mm / 1000 * area_m2) AS rain, sum(dq / 1000 * area_m2) AS run FROM runoff GROUP BY step),
bal AS (SELECT b.step, rain, run, coalesce(outf, 0) AS outf, coalesce(stored, 0) AS stored, sum(rain) OVER w AS rc, sum(run) OVER w AS uc, sum(coalesce(outf, 0)) OVER w AS oc FROM b LEFT JOIN held USING (step) WINDOW w AS (ORDER BY b.step))"""
)


@query(f"{_BALANCE} SELECT step, round(rain) AS rain_m3, round(run) AS runoff_m3, round(outf) AS outflow_m3, round(rc) AS rain_cum_m3, round(uc) AS runoff_cum_m3, round(oc) AS outflow_cum_m3, round(stored) AS stored_m3 FROM bal")
def volume_balance(spark, d):
    b = _balance(spark, d)
    return b.select("step", *(F.round(c).alias(c) for c in b.columns if c != "step"))


@query(f"""{_BALANCE} SELECT round(max(abs(stored - (uc - oc)))) AS mass_error_m3, round(max(rc)) AS rain_m3, round(max(uc)) AS runoff_m3, round(max(oc)) AS outflow_m3, round(max(uc) / max(rc), 6) AS runoff_ratio,
  max(abs(stored - (uc - oc))) <= 1e-3 * greatest(max(uc), max(rc), 1) + 1e-6 AS numerical_ok, max(uc) <= max(rc) * 1.001 AND max(oc) <= max(uc) + 1e-3 * max(rc) AS hydrological_ok FROM bal""")
def quality_report(spark, d):
    q = P.quality_report(_balance(spark, d))
    return q.select(F.round("mass_error_max_m3").alias("mass_error_m3"), *(F.round(c).alias(c) for c in ("rain_m3", "runoff_m3", "outflow_m3")), rnd("runoff_ratio"), "numerical_ok", "hydrological_ok")


@query(f"{_CLOCK} SELECT step, sum(n)::BIGINT AS moved FROM moves WHERE step >= step0 AND (gone OR cur <> prev) AND step <= 39 GROUP BY step")
def particle_hops(spark, d):
    return _by_blocks(spark, d, 39)[0].moved.where("moved > 0").select(F.col("step").cast("int").alias("step"), "moved")


@query(f"{_RAIN} SELECT step, cell_id, round(p, 6) AS p_cum_mm, round(q, 6) AS q_cum_mm, round(dq, 6) AS dq_mm FROM runoff WHERE step >= 12")
def restart_runoff(spark, d):
    """The second half of a run from the state that the first one left."""
    g = X.grid(spark, d)
    first = R.runoff_steps(_blended(spark, d, "step < 12"), g)
    state = first.groupBy("cell_id").agg(F.max_by("p_cum_mm", "step").alias("p_cum_mm"), F.max_by("q_cum_mm", "step").alias("q_cum_mm"))
    return R.runoff_steps(_blended(spark, d, "step >= 12"), g, start=L.cut(state)).select("step", "cell_id", rnd("p_cum_mm"), rnd("q_cum_mm"), rnd("dq_mm"))


@query(f"{_CLOCK} SELECT step, cur AS node, sum(n)::BIGINT AS n, round(sum(vol), 6) AS vol FROM moves WHERE step IN (3, 9, 19) AND step >= step0 AND NOT gone GROUP BY ALL")
def advect_output_steps(spark, d):
    s, _, _ = _schedule(spark, d, 21)
    saved = spark.createDataFrame([(3,), (9,), (19,)], "step int")
    return L.advect_to(_parcels(spark, d), s, saved).where("node is not null").select("step", "node", "n", rnd("vol"))


@query("SELECT CAST(i AS INTEGER) AS step, CAST(floor((i + 1) * 600 / 3600.0 + 1e-9) AS INTEGER) AS rotation FROM range(0, 50) s(i) WHERE (i + 1) % 6 = 0 OR i = 49")
def save_schedule(spark, d):
    return P.saved_steps(spark.range(50).select(F.col("id").cast("int").alias("step")), DT, 3600.0)


# --- ingest ------------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT event_id, ts, user_id, epoch(ts)::BIGINT + 2208988800 AS s, CASE WHEN event_id % 17 <> 0 THEN value END AS rate FROM events),
o AS (SELECT min(floor(s / 900.0)) * 900 AS origin FROM (SELECT CAST(floor(epoch(ts)) AS BIGINT) + 2208988800 AS s FROM events)),
b AS (SELECT CAST(floor((CAST(floor(epoch(ts)) AS BIGINT) + 2208988800 - origin) / 900) AS BIGINT) AS bin, user_id AS station, rate FROM s, o WHERE rate IS NOT NULL)
SELECT bin, station, round(10.0::DOUBLE + (station % 40) * 0.01::DOUBLE, 6) AS lon, round(45.0::DOUBLE - (station % 37) * 0.01::DOUBLE, 6) AS lat, round(avg(rate), 6) AS rate, count(*) AS n FROM b GROUP BY bin, station""")
def station_bins(spark, d):
    return T.station_bins(X.stations(spark, d), 900).select("bin", "station", rnd("lon"), rnd("lat"), rnd("rate"), "n")


@query("SELECT l_orderkey, l_linenumber, round(pow(pow(10.0::DOUBLE, (l_quantity + l_discount) / 10) / 200, 1 / 1.6::DOUBLE), 6) AS rate FROM lineitem WHERE l_quantity + l_discount BETWEEN 5 AND 48 AND l_quantity <> 13 UNION ALL SELECT l_orderkey, l_linenumber, NULL FROM lineitem WHERE NOT (l_quantity + l_discount BETWEEN 5 AND 48 AND l_quantity <> 13)")
def dbz_to_rain(spark, d):
    dbz = F.when(F.col("l_quantity") != 13, F.col("l_quantity") + F.col("l_discount")).otherwise(F.lit(-9999.0))
    return X.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.dbz_to_rain(dbz, least=5.0, most=48.0, nodata=-9999.0), 6).alias("rate"))


_WRF = "SELECT CAST(o_orderdate AS DATE) AS day, o_custkey % 100 AS cell, count(*) AS acc FROM orders"


@query(f"""WITH f AS (SELECT 0 AS file_idx, * FROM ({_WRF} WHERE year(o_orderdate) <= 1995 GROUP BY ALL) UNION ALL SELECT 1, * FROM ({_WRF} WHERE year(o_orderdate) >= 1995 GROUP BY ALL))
SELECT day, cell, round(acc / 6.0::DOUBLE, 6) AS rate, file_idx FROM f QUALIFY row_number() OVER (PARTITION BY day, cell ORDER BY file_idx) = 1""")
def wrf_rate_dedupe(spark, d):
    o = X.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 100).alias("cell"))
    file = lambda k, cond: o.where(cond).groupBy("day", "cell").agg(F.count("*").alias("acc")).withColumn("file_idx", F.lit(k))
    rows = file(0, "year(day) <= 1995").unionByName(file(1, "year(day) >= 1995"))
    return T.merged_files(rows, ["day", "cell"], "file_idx").select("day", "cell", F.round(S.accumulation_rate(F.col("acc"), 6.0, -9999.0), 6).alias("rate"), "file_idx")


def _network(spark, d):
    s = X.read(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("station"), ((k * 37 % 40) * 800.0).alias("x_m"), ((k * 53 % 61) * 900.0).alias("y_m"), F.round(F.col("s_acctbal") / 100, 4).alias("rate"))


@query(f"""WITH {X.GRID}, st AS (SELECT s_suppkey AS station, (s_suppkey * 37 % 40) * 800.0::DOUBLE AS sx, (s_suppkey * 53 % 61) * 900.0::DOUBLE AS sy, round(s_acctbal / 100, 4) AS rate FROM supplier),
p AS (SELECT cell_id, station, rate, sqrt((c * 800.0::DOUBLE - sx) * (c * 800.0::DOUBLE - sx) + (r * 1000.0::DOUBLE - sy) * (r * 1000.0::DOUBLE - sy)) AS d FROM grid CROSS JOIN st WHERE active)
SELECT cell_id, round(coalesce(min_by(rate, station) FILTER (WHERE d = 0), sum(rate / pow(greatest(d, 1), 2)) / sum(1 / pow(greatest(d, 1), 2))), 5) AS value FROM p GROUP BY cell_id""")
def idw(spark, d):
    cells = X.grid(spark, d).where("active").select("cell_id", (F.col("c") * 800.0).alias("x_m"), (F.col("r") * 1000.0).alias("y_m"))
    return T.idw(cells, _network(spark, d)).select("cell_id", rnd("value", 5))


def _coarse(spark):
    """A regular source grid of 11 by 13 nodes (i, j)."""
    n = spark.range(143).select((F.col("id") % 11).cast("int").alias("i"), F.floor(F.col("id") / 11).cast("int").alias("j"))
    return n.select("i", "j", (F.col("i") * F.col("i") * 3 + F.col("j") * 7 + (F.col("i") * F.col("j")) % 5).cast("double").alias("v"))


_COARSE = "coarse AS (SELECT CAST(k % 11 AS INTEGER) AS i, CAST(k // 11 AS INTEGER) AS j, CAST((k % 11) * (k % 11) * 3 + (k // 11) * 7 + ((k % 11) * (k // 11)) % 5 AS DOUBLE) AS v FROM range(0, 143) t(k))"


@query(f"""WITH {X.GRID}, {_COARSE}, a AS (SELECT cell_id, c * 1.0::DOUBLE AS x, r * 1.0::DOUBLE AS y FROM grid WHERE active),
n AS (SELECT cell_id, (SELECT min_by(i, abs(i * 4.0 - x) * 1000 + i) FROM range(0, 11) t(i)) AS i, (SELECT min_by(j, abs(j * 4.0 - y) * 1000 + j) FROM range(0, 13) t(j)) AS j FROM a)
SELECT cell_id, v AS value FROM n JOIN coarse USING (i, j)""")
def regrid_nearest(spark, d):
    t = X.grid(spark, d).where("active").select("cell_id", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    axis = lambda n: spark.range(n).select(F.col("id").cast("int").alias("i"), (F.col("id") * 4.0).alias("v"))
    return G.regrid_nearest(t, axis(11), axis(13), _coarse(spark), "v")


@query(f"""WITH {X.GRID}, {_COARSE}, a AS (SELECT cell_id, c / 4.0::DOUBLE AS fx, r / 4.0::DOUBLE AS fy FROM grid WHERE active),
b AS (SELECT *, CAST(least(floor(fx), 9) AS INTEGER) AS i0, CAST(least(floor(fy), 11) AS INTEGER) AS j0 FROM a WHERE fx <= 10 AND fy <= 12),
w AS (SELECT b.cell_id, sum((CASE WHEN i = i0 THEN 1 - (fx - i0) ELSE fx - i0 END) * (CASE WHEN j = j0 THEN 1 - (fy - j0) ELSE fy - j0 END) * v) AS value FROM b JOIN coarse ON i BETWEEN i0 AND i0 + 1 AND j BETWEEN j0 AND j0 + 1 GROUP BY b.cell_id)
SELECT a.cell_id, round(value, 6) AS value FROM a LEFT JOIN w USING (cell_id)""")
def regrid_bilinear(spark, d):
    t = X.grid(spark, d).where("active").select("cell_id", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    return G.regrid_bilinear(t, 0.0, 4.0, 11, 0.0, 4.0, 13, _coarse(spark), "v").select("cell_id", rnd("value"))


# --- zones and alerts ----------------------------------------------------------------------------------------------------


def _values(spark, d):
    """Cells with a depth and a risk made from ids, some missing; whole grid coordinates (c, r)."""
    g = X.grid(spark, d)
    k = F.col("cell_id")
    return g.select("cell_id", "r", "c", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), F.when(g["active"] & (k % 13 != 0), (k * 31 % 100) / 100.0).alias("depth_m"), F.when(k % 17 != 0, (k * 17 % 90) / 30.0).alias("risk"))


_VALUES = "vals AS (SELECT cell_id, r, c, CAST(c AS DOUBLE) AS x, CAST(r AS DOUBLE) AS y, CASE WHEN active AND cell_id % 13 <> 0 THEN (cell_id * 31 % 100) / 100.0::DOUBLE END AS depth_m, CASE WHEN cell_id % 17 <> 0 THEN (cell_id * 17 % 90) / 30.0::DOUBLE END AS risk FROM grid)"


def _zones(spark, d, shift: float):
    s = X.read(spark, d, "supplier")
    k = F.col("s_suppkey")
    x0, y0 = k % 30 + shift, (k * 7) % 45 + shift
    return s.select(k.alias("feature_id"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + k % 6 + 1).cast("double").alias("x1"), (y0 + k % 4 + 1).cast("double").alias("y1"))


def _zone_sql(shift: str) -> str:
    return f"zones AS (SELECT s_suppkey AS feature_id, s_suppkey % 30 + {shift}::DOUBLE AS x0, (s_suppkey * 7) % 45 + {shift}::DOUBLE AS y0, s_suppkey % 30 + {shift}::DOUBLE + s_suppkey % 6 + 1 AS x1, (s_suppkey * 7) % 45 + {shift}::DOUBLE + s_suppkey % 4 + 1 AS y1 FROM supplier)"


_STATS = """count(*) FILTER (WHERE depth_m IS NOT NULL AND risk IS NOT NULL) AS n,
  round(sum(w * depth_m) FILTER (WHERE depth_m IS NOT NULL AND risk IS NOT NULL) / sum(w) FILTER (WHERE depth_m IS NOT NULL AND risk IS NOT NULL), 6) AS depth_mean, round(max(depth_m) FILTER (WHERE risk IS NOT NULL), 6) AS depth_max,
  round(sum(w * risk) FILTER (WHERE depth_m IS NOT NULL AND risk IS NOT NULL) / sum(w) FILTER (WHERE depth_m IS NOT NULL AND risk IS NOT NULL), 6) AS risk_mean, round(max(risk) FILTER (WHERE depth_m IS NOT NULL), 6) AS risk_max,
  round(100 * sum(CASE WHEN depth_m > 0.5 THEN w ELSE 0 END) FILTER (WHERE depth_m IS NOT NULL) / sum(w) FILTER (WHERE depth_m IS NOT NULL), 6) AS flooded_pct"""


def _rounded(s: DataFrame) -> DataFrame:
    return s.select("feature_id", "n", *(rnd(c) for c in ("depth_mean", "depth_max", "risk_mean", "risk_max", "flooded_pct")))


@query(f"WITH {X.GRID}, {_VALUES}, {_zone_sql('0.3')}, p AS (SELECT *, cos(radians(y)) AS w FROM zones JOIN vals ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) SELECT feature_id, {_STATS} FROM p GROUP BY feature_id")
def zonal_stats(spark, d):
    return _rounded(Z.zonal_by_centre(_zones(spark, d, 0.3), _values(spark, d), 4.0, 0.5))


@query(f"""WITH {X.GRID}, {_VALUES}, {_zone_sql('0.3')}, p AS (SELECT *, cos(radians(y)) AS w FROM zones JOIN vals ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 WHERE (x - x0) * (y1 - y0) + (y - y0) * (x1 - x0) < (x1 - x0) * (y1 - y0) - 1e-9) SELECT feature_id, {_STATS} FROM p GROUP BY feature_id""")
def zonal_polygon(spark, d):
    z = _zones(spark, d, 0.3)
    z = z.withColumn("ring", F.array("x0", "y0", "x1", "y0", "x0", "y1"))
    return _rounded(Z.zonal_by_centre(z, _values(spark, d), 4.0, 0.5, polygon=True))


@query(f"""WITH {X.GRID}, {_VALUES}, {_zone_sql('0.3')}, p AS (SELECT *, greatest(least(x + 0.5, x1) - greatest(x - 0.5, x0), 0) * greatest(sin(radians(least(y + 0.5, y1))) - sin(radians(greatest(y - 0.5, y0))), 0) AS w
  FROM zones JOIN vals ON x + 0.5 > x0 AND x - 0.5 < x1 AND y + 0.5 > y0 AND y - 0.5 < y1) SELECT feature_id, {_STATS} FROM p WHERE w > 0 GROUP BY feature_id""")
def zonal_rect_exact(spark, d):
    return _rounded(Z.zonal_by_area(_zones(spark, d, 0.3), _values(spark, d), 1.0, 1.0, 4.0, 0.5))


_POINT = "points AS (SELECT c_custkey AS feature_id, (c_custkey * 13 % 430) / 10.0::DOUBLE AS px, (c_custkey * 29 % 520) / 10.0::DOUBLE AS py FROM customer)"


def _points(spark, d):
    k = F.col("c_custkey")
    return X.read(spark, d, "customer").select(k.alias("feature_id"), (k * 13 % 430 / 10.0).alias("px"), (k * 29 % 520 / 10.0).alias("py"))


@query(f"WITH {X.GRID}, {_VALUES}, {_POINT} SELECT feature_id, cell_id, round(depth_m, 6) AS depth_m, round(risk, 6) AS risk FROM points LEFT JOIN vals ON c = least(ceil(px - 0.5), 39) AND r = least(ceil(py - 0.5), (SELECT max(r) FROM grid))")
def zonal_point(spark, d):
    return Z.sample_points(_points(spark, d), 0.0, 1.0, X.NCOL, 0.0, 1.0, X.rows(spark, d), _values(spark, d)).select("feature_id", "cell_id", rnd("depth_m"), rnd("risk"))


@query(f"WITH {_POINT} SELECT feature_id, CAST((SELECT min_by(i, abs(i - px) * 1000 + i) FROM range(0, 40) t(i)) AS INTEGER) AS c FROM points")
def nearest_cell(spark, d):
    axis = spark.range(40).select(F.col("id").cast("int").alias("i"), F.col("id").cast("double").alias("v"))
    one = spark.range(1).select(F.lit(0).alias("i"), F.lit(0.0).alias("v"))
    p = _points(spark, d).select(F.col("feature_id").alias("cell_id"), F.col("px").alias("x"), F.lit(0.0).alias("y"))
    source = axis.select("i", F.lit(0).alias("j"), F.col("i").alias("value"))
    return G.regrid_nearest(p, axis, one, source, "value").select(F.col("cell_id").alias("feature_id"), F.col("value").alias("c"))


RULES = [
    ("deep", "depth", ">=", "7000", "high", ["email", "rest"]),
    ("debt", "depth", "<", "0", "low", ["sms"]),
    ("segment", "segment", "in", "BUILDING, MACHINERY", "mid", ["rest", "telegram"]),
    ("house", "segment", "contains", "HOUSE", "mid", ["email", "sms"]),
    ("words", "segment", "==", "BUILDING", "low", ["email"]),
    ("nation", "nation", "!=", "3", "low", []),
]
_RULES = "rules AS (SELECT * FROM (VALUES ('deep','depth','>=','7000','high',['email','rest']),('debt','depth','<','0','low',['sms']),('segment','segment','in','BUILDING, MACHINERY','mid',['rest','telegram']),('house','segment','contains','HOUSE','mid',['email','sms']),('words','segment','==','BUILDING','low',['email']),('nation','nation','!=','3','low',[])) t(rule, property, op, value, severity, channels))"
_FEATURES = """feats AS (SELECT c_custkey::VARCHAR AS feature_id, 'depth' AS property, CAST(CAST(c_acctbal AS INTEGER) AS VARCHAR) AS actual FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'nation', c_nationkey::VARCHAR FROM customer),
hits AS (SELECT * FROM feats JOIN rules USING (property) WHERE coalesce(CASE op WHEN 'in' THEN list_contains(list_transform(string_split(value, ','), lambda s: trim(s)), actual) WHEN 'contains' THEN contains(actual, value) WHEN '>=' THEN TRY_CAST(actual AS DOUBLE) >= TRY_CAST(value AS DOUBLE) WHEN '<' THEN TRY_CAST(actual AS DOUBLE) < TRY_CAST(value AS DOUBLE)
  WHEN '==' THEN TRY_CAST(actual AS DOUBLE) = TRY_CAST(value AS DOUBLE) WHEN '!=' THEN TRY_CAST(actual AS DOUBLE) <> TRY_CAST(value AS DOUBLE) END, FALSE)),
ids AS (SELECT *, sha256(feature_id || '|' || rule || '|' || property || '|' || op || '|' || value || '|' || actual) AS alert_id FROM hits)"""


def _hits(spark, d):
    rules = spark.createDataFrame(RULES, "rule string, property string, op string, value string, severity string, channels array<string>")
    c = X.read(spark, d, "customer")
    whole = F.rint("c_acctbal").cast("int").cast("string")
    contact = F.when(F.col("c_custkey") % 3 == 0, F.lit("a@example.org")).otherwise(F.lit(" "))
    props = F.create_map(F.lit("depth"), whole, F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("email"), contact, F.lit("url"), F.lit("https://example.org/hook"))
    f = c.select(F.col("c_custkey").cast("string").alias("feature_id"), props.alias("properties"))
    h = A.matches(f, rules).join(f, "feature_id")
    return h.withColumn("alert_id", A.alert_id(F.col("feature_id"), F.col("rule"), F.col("property"), F.col("op"), F.col("value"), A.six_digits(F.col("actual"))))


@query(f"WITH {_RULES}, {_FEATURES} SELECT feature_id, rule, actual, severity FROM hits")
def rule_match(spark, d):
    return _hits(spark, d).select("feature_id", "rule", "actual", "severity")


@query(f"WITH {_RULES}, {_FEATURES} SELECT alert_id, feature_id, rule FROM ids")
def alert_ids(spark, d):
    return _hits(spark, d).select("alert_id", "feature_id", "rule")


@query(f"WITH {_RULES}, {_FEATURES} SELECT alert_id, rule FROM ids WHERE CAST(feature_id AS INTEGER) % 4 <> 0")
def alert_dedupe(spark, d):
    h = _hits(spark, d)
    sent = h.where(F.col("feature_id").cast("int") % 4 == 0).select("alert_id")
    return A.unsent(h, sent).select("alert_id", "rule")


@query(f"""WITH {_RULES}, {_FEATURES}, r AS (SELECT alert_id, list_sort(list_filter(channels, lambda c: c = 'rest' OR (c = 'email' AND CAST(feature_id AS INTEGER) % 3 = 0))) AS routes FROM ids)
SELECT alert_id, array_to_string(routes, ',') AS routes, len(routes) = 0 AS missing_route FROM r""")
def alert_routing(spark, d):
    r = A.routed(_hits(spark, d), ["rest", "email"], {"rest": ["url"], "email": ["email"], "sms": ["phone"]})
    return r.select("alert_id", F.array_join("routes", ",").alias("routes"), "missing_route")


@query(f"WITH {_RULES}, {_FEATURES} SELECT count(*) AS matched, count(*) FILTER (WHERE NOT (list_contains(channels, 'rest') OR (list_contains(channels, 'email') AND CAST(feature_id AS INTEGER) % 3 = 0))) AS missing_route FROM ids")
def alert_summary(spark, d):
    r = A.routed(_hits(spark, d), ["rest", "email"], {"rest": ["url"], "email": ["email"], "sms": ["phone"]})
    return A.run_summary(r).select("matched", "missing_route")


@query("SELECT event_id, round((epoch(ts) + 2208988800) / 3600.0::DOUBLE, 5) AS hours, CAST(floor((user_id % 360 - 180 + 180) / 6) + 1 AS INTEGER) + CASE WHEN user_id % 2 = 0 THEN 32600 ELSE 32700 END AS epsg FROM events")
def time_and_zone_codes(spark, d):
    e = X.read(spark, d, "events")
    u = F.col("user_id")
    return e.select("event_id", F.round(S.cf_hours(F.col("ts").cast("timestamp")), 5).alias("hours"), S.utm_epsg(u % 360 - 180, F.when(u % 2 == 0, 1).otherwise(-1)).alias("epsg"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return P.risk_index(_risk_cells(spark, d)).select("cell_id", rnd("risk"), S.risk_class(F.col("risk")).alias("class"))


