"""Rain operators: picking a source's slice for each step, blending sources, cumulative runoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions import scalars as S


def pick_slices(steps: DataFrame, slices: DataFrame, select: str) -> DataFrame:
    """(source, step, k): the slice of every source (source, k, t) for every step (step, t).

    ``previous``: the last at or before the step, else the first. ``nearest``: the earlier on ties. ``step``: by position, the
    last one for all later steps. One merged order of steps and slices and two running windows by source; no range join.
    """
    if select == "step":
        n = slices.groupBy("source").agg((F.count("*") - 1).alias("last"))
        rank = slices.select("source", F.col("k"), (F.row_number().over(Window.partitionBy("source").orderBy("t")) - 1).alias("at"))
        s = n.join(F.broadcast(steps.select("step")), F.lit(True)).withColumn("at", F.least("step", "last"))  # steps: one run's clock
        return s.join(rank, ["source", "at"]).select("source", "step", "k")
    sources = slices.select("source").distinct()
    asks = sources.join(F.broadcast(steps), F.lit(True)).select("source", "t", "step", F.lit(None).cast("int").alias("k"))
    both = asks.unionByName(slices.select("source", "t", F.lit(None).cast("int").alias("step"), F.col("k").cast("int").alias("k")))
    slice_ = F.when(F.col("k").isNotNull(), F.struct("t", "k"))
    order = Window.partitionBy("source").orderBy("t", F.col("step").isNotNull())
    before = F.last(slice_, True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(slice_, True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = both.select("source", "step", "t", before.alias("b"), after.alias("a")).where("step is not null")
    if select == "previous":
        pick = F.coalesce("b.k", "a.k")
    elif select == "nearest":
        back, ahead = (F.abs(F.unix_micros(F.col("t")) - F.unix_micros(F.col(f"{x}.t"))) for x in "ba")
        pick = F.when(F.col("b").isNull() | (ahead < back), F.col("a.k")).otherwise(F.col("b.k"))
    else:
        raise ValueError(f"unknown selection {select!r}")
    return both.select("source", "step", pick.alias("k"))


def pick_by_source(steps: DataFrame, slices: DataFrame, select: dict[str, str]) -> DataFrame:
    """(source, step, k) with a way to select of its own for every source."""
    out = None
    for how in sorted(set(select.values())):
        one = pick_slices(steps, slices.where(F.col("source").isin([s for s, h in select.items() if h == how])), how)
        out = one if out is None else out.unionByName(one)
    return out


def blend(picked: DataFrame, rates: DataFrame, weights: dict[str, float], mode: str | dict[str, str], dt_s: float) -> DataFrame:
    """(step, cell_id, rain_mm): weighted sum over sources of each step's rain; sources of weight 0 are not read.

    ``mode`` is one for all sources or one for each. Rates that lie by ``cell_id`` stay where they are: nothing is shuffled.
    """
    used = {k: w for k, w in weights.items() if w}
    mm = F.lit(0.0)
    for name, w in used.items():
        rate = S.rain_to_step_mm(F.col("rate"), mode if isinstance(mode, str) else mode[name], dt_s)
        mm = F.when(F.col("source") == name, rate * float(w)).otherwise(mm)
    # clamping comes before weights, so that negative weights take rain away
    r = rates.where(F.col("source").isin(list(used))).withColumn("mm", mm)
    # steps that show the same slices have the same rain: it is summed up once for all of them. Both tables are a run's clock.
    shown = picked.where(F.col("source").isin(list(used))).groupBy("step").agg(F.sort_array(F.collect_list(F.struct("source", "k"))).alias("slices"))
    shown = shown.groupBy("slices").agg(F.min("step").alias("like"), F.collect_list("step").alias("steps"))
    asked = shown.select("like", F.explode("slices").alias("s")).select("like", "s.source", "s.k")
    mm = r.join(F.broadcast(asked), ["source", "k"]).groupBy("like", "cell_id").agg(F.sum("mm").alias("rain_mm"))
    return mm.join(F.broadcast(shown.select("like", "steps")), "like").select(F.explode("steps").alias("step"), "cell_id", "rain_mm")


def scalar_rain(grid: DataFrame, name: str, value: float) -> DataFrame:
    """(source, k, t, cell_id, rate): the same rain on every cell, at all times."""
    return grid.select(F.lit(name).alias("source"), F.lit(0).alias("k"), F.timestamp_seconds(F.lit(0)).alias("t"), "cell_id", F.lit(float(value)).alias("rate"))


def runoff_steps(rain: DataFrame, grid: DataFrame, ia_ratio: float = 0.2, compat: str = "documented", start: DataFrame | None = None) -> DataFrame:
    """(step, cell_id, rain_mm, p_cum_mm, q_cum_mm, dq_mm): running rain, curve-number runoff and its growth, for active cells.

    ``start`` (cell_id, p_cum_mm, q_cum_mm): what an earlier run left behind.
    """
    w = Window.partitionBy("cell_id").orderBy("step")
    g = grid.where("active").select("cell_id", "cn")
    if start is None:
        g = g.withColumn("p0", F.lit(0.0)).withColumn("q0", F.lit(0.0))
    else:
        g = g.join(start.select("cell_id", F.col("p_cum_mm").alias("p0"), F.col("q_cum_mm").alias("q0")), "cell_id", "left").fillna(0.0, ["p0", "q0"])
    d = rain.join(g.hint("shuffle_hash"), "cell_id")  # a share of the cells is held, so that only the window sorts rain
    d = d.withColumn("p_cum_mm", F.col("p0") + F.sum("rain_mm").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("q_cum_mm", S.scs_runoff_mm(F.col("p_cum_mm"), F.col("cn"), ia_ratio, compat))
    return d.select("step", "cell_id", "rain_mm", "p_cum_mm", "q_cum_mm", F.greatest(F.col("q_cum_mm") - F.coalesce(F.lag("q_cum_mm").over(w), F.col("q0")), F.lit(0.0)).alias("dq_mm"))


def runoff_total(rain: DataFrame, grid: DataFrame, ia_ratio: float = 0.2, compat: str = "documented") -> DataFrame:
    """(cell_id, p_cum_mm, q_cum_mm) of active cells at the end of ``rain`` (step, cell_id, rain_mm): the last of :func:`runoff_steps`.

    Runoff of a sum needs no order of steps.
    """
    d = rain.groupBy("cell_id").agg(F.sum("rain_mm").alias("p_cum_mm")).join(grid.where("active").select("cell_id", "cn"), "cell_id")
    return d.select("cell_id", "p_cum_mm", S.scs_runoff_mm(F.col("p_cum_mm"), F.col("cn"), ia_ratio, compat).alias("q_cum_mm"))


def advances(picked: DataFrame) -> DataFrame:
    """(source, step, k): the steps at which a source's slice changes."""
    before = F.lag("k").over(Window.partitionBy("source").orderBy("step"))
    return picked.withColumn("before", before).where("before is null or before <> k").select("source", "step", "k")
