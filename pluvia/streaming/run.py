"""A run over a stream of rain: cells and parcels carry their state from batch to batch, in tables that a restart finds again.

Every batch is a piece of a run, by the operators of batch runs: runoff in windows that begin with the state, parcels routed by blocks
from where they are. A batch may end in the midst of a step, so the last ``lag`` steps seen are held back until a later one comes, or until
:meth:`RunStream.finish`. Rain of steps that are done is left out (a source that repeats itself, or is late): water counts once.

State and results of batch k lie below ``epoch=k`` and are written whole or not at all. A batch that Spark repeats begins from the state of
the batch before it and replaces what it wrote, so that results are those of one run, whatever fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators import flow as L
from pluvia.operators import rain as R
from pluvia.operators import routing as B
from pluvia.plans import state
from pluvia.plans.storage import cut

RAIN = "cell_id long, step int, rain_mm double"


class RunStream:
    """``foreachBatch`` sink of rain (cell_id, step, rain_mm).

    ``grid``: (cell_id, r, c, active, cn, area_m2), ``flow``: (cell_id, ds_id), ``travel``: (node, travel_s). Below ``path``: ``state``
    (the last ``keep`` of them), and ``runoff`` (step, cell_id, rain_mm, p_cum_mm, q_cum_mm, dq_mm), ``placed`` (step, node, n, vol) at the end
    of each batch's last step and ``outflow`` (node, step, n, vol), to be read with :meth:`results`.
    """

    def __init__(self, grid: DataFrame, flow: DataFrame, travel: DataFrame, path: str, dt_s: float, particle_m3: float = 0.25, ia_ratio: float = 0.2, lag: int = 1, keep: int = 2) -> None:
        self.grid, self.flow, self.travel, self.path = grid, flow, travel, path.rstrip("/")
        self.dt_s, self.particle_m3, self.ia_ratio, self.lag, self.keep = dt_s, particle_m3, ia_ratio, lag, keep

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        self._advance(batch.select("cell_id", F.col("step").cast("int").alias("step"), F.col("rain_mm").cast("double").alias("rain_mm")), epoch, self.lag)

    def finish(self) -> None:
        """Takes the steps that are held back, when no more rain comes."""
        spark = self.grid.sparkSession
        self._advance(spark.createDataFrame([], RAIN), max(self._epochs("state"), default=-1) + 1, 0)

    def results(self, kind: str) -> DataFrame:
        """``runoff``, ``placed`` or ``outflow`` of all batches."""
        return self.grid.sparkSession.read.parquet(f"{self.path}/{kind}").drop("epoch")

    def _epochs(self, kind: str) -> list[int]:
        """Batches that are there."""
        spark = self.grid.sparkSession
        fs, here = state._paths(spark, f"{self.path}/{kind}")
        names = [s.getPath().getName() for s in fs.listStatus(here)] if fs.exists(here) else []
        return sorted(int(n[6:]) for n in names if n.startswith("epoch=") and n[6:].isdigit())

    def _advance(self, batch: DataFrame, epoch: int, lag: int) -> None:
        spark = self.grid.sparkSession
        earlier = [e for e in self._epochs("state") if e < epoch]
        before = f"{self.path}/state/epoch={earlier[-1]}" if earlier else None
        start = state.read(spark, before) if before else None
        done = start.scalars["step"] if start else -(2**31)
        rain = batch.where("step is not null and cell_id is not null").groupBy("cell_id", "step").agg(F.sum(F.greatest(F.coalesce("rain_mm", F.lit(0.0)), F.lit(0.0))).alias("rain_mm"))
        rain = rain.where(F.col("step") > done)
        if start:
            held = spark.read.schema(RAIN).parquet(f"{before}/held")
            rain = rain.unionByName(held).groupBy("cell_id", "step").agg(F.sum("rain_mm").alias("rain_mm"))
        rain = cut(rain)
        seen = rain.agg(F.min("step"), F.max("step")).first()
        to = seen[1] - lag if seen[1] is not None else done
        cells, parcels, out = start and start.cells, start and start.parcels, None
        if to > done and seen[0] is not None and seen[0] <= to:
            first = done + 1 if start and "begun" in start.scalars else int(seen[0])
            ready = rain.where(F.col("step") <= to)
            runoff = cut(R.runoff_steps(ready.select("step", "cell_id", "rain_mm"), self.grid, self.ia_ratio, start=cells))
            new = L.spawn(runoff.join(self.grid.select("cell_id", "area_m2"), "cell_id"), self.particle_m3).withColumn("tau", F.lit(0.0))
            moving = new if parcels is None else new.unionByName(parcels)
            clock = spark.range(first, to + 1).select(F.col("id").cast("int").alias("step"))
            last = clock.where(F.col("step") == to)
            routed = B.by_blocks(moving, self.grid.select("cell_id", "r", "c"), self.flow, self.travel, self.dt_s, last, clock, [to])
            now = runoff.groupBy("cell_id").agg(F.max_by("p_cum_mm", "step").alias("p_cum_mm"), F.max_by("q_cum_mm", "step").alias("q_cum_mm"))
            if cells is not None:
                old = cells.select("cell_id", F.col("p_cum_mm").alias("p0"), F.col("q_cum_mm").alias("q0"))
                now = now.join(old, "cell_id", "full").select("cell_id", F.coalesce("p_cum_mm", "p0").alias("p_cum_mm"), F.coalesce("q_cum_mm", "q0").alias("q_cum_mm"))
            cells = now
            parcels = routed.kept.select("cell_id", (F.col("step") + 1).alias("step0"), "tau", "n", "vol")
            out = {"runoff": runoff, "placed": routed.placed, "outflow": routed.outflow}
            done = to
        for kind in ("runoff", "placed", "outflow"):
            if out is not None:
                out[kind].write.mode("overwrite").parquet(f"{self.path}/{kind}/epoch={epoch}")
            elif epoch in self._epochs(kind):  # of a repeated batch that had more steps
                self._drop(f"{self.path}/{kind}/epoch={epoch}")
        empty = lambda schema: spark.createDataFrame([], schema)
        cells = empty("cell_id long, p_cum_mm double, q_cum_mm double") if cells is None else cells
        parcels = empty("cell_id long, step0 int, tau double, n long, vol double") if parcels is None else parcels
        scalars = {"step": done, "dt_s": self.dt_s, **({"begun": True} if out is not None or (start and "begun" in start.scalars) else {})}
        state.save(f"{self.path}/state/epoch={epoch}", cells, parcels, scalars, held=rain.where(F.col("step") > done))
        for old in [e for e in self._epochs("state") if e < epoch][: -max(1, self.keep - 1)]:
            self._drop(f"{self.path}/state/epoch={old}")

    def _drop(self, path: str) -> None:
        fs, here = state._paths(self.grid.sparkSession, path)
        fs.delete(here, True)
