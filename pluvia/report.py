"""Reports of a run as JSON: domain, time, hydrology, status; step log lines."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators import products as P


log = logging.getLogger("pluvia")


def log_to_stderr(level: str = "INFO") -> None:
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")


class Timings:
    """Seconds of the named parts of a run: ``with times("results"): ...``."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start
            log.info("%s: %.3f s", name, self.seconds[name])


def stage_times(spark) -> list[dict]:
    """Of every completed stage that Spark's status store still has: name, tasks, and the run times of its tasks in seconds.

    ``task_s`` has the quantiles 0, 0.5, 0.95 and 1 over tasks, so that uneven stages show; the store keeps a bounded number of stages.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    quantiles = gateway.new_array(jvm.double, 4)
    for k, q in enumerate((0.0, 0.5, 0.95, 1.0)):
        quantiles[k] = q
    store = spark.sparkContext._jsc.sc().statusStore()
    complete = jvm.java.util.ArrayList()
    complete.add(jvm.org.apache.spark.status.api.v1.StageStatus.COMPLETE)
    listed = store.stageList(complete, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    out = []
    for k in range(listed.size()):
        s = listed.apply(k)
        spread = store.taskSummary(s.stageId(), s.attemptId(), quantiles)
        task_s = [v / 1000 for v in _values(spread.get().executorRunTime())] if spread.isDefined() else []
        out.append({"stage": s.stageId(), "name": s.name().split(" at ")[0], "tasks": s.numCompleteTasks(), "failed": s.numFailedTasks(), "run_s": s.executorRunTime() / 1000, "cpu_s": s.executorCpuTime() / 1e9, "gc_s": s.jvmGcTime() / 1000, "shuffle_read_mb": s.shuffleReadBytes() / 1e6, "shuffle_write_mb": s.shuffleWriteBytes() / 1e6, "spill_mb": s.diskBytesSpilled() / 1e6, "task_s": task_s})
    return sorted(out, key=lambda x: x["stage"])


def _values(seq) -> list[float]:
    return [seq.apply(k) for k in range(seq.size())]


def run_metrics(run, steps: DataFrame, cfg: dict, wall_s: float, times: Timings, detailed: bool = True, every: int = 1) -> str:
    """One JSON document of a run's times and throughput; volumes of every ``every``-th step as samples."""
    spark = steps.sparkSession
    n = steps.count()
    spawned = run.parcels.agg(F.sum("n")).first()[0] or 0
    out = run.outflow.agg(F.sum("n")).first()[0] or 0
    by_step = run.moved if run.moved is not None else None if run.schedule is None else P.hops(run.parcels, run.schedule, steps)
    moved = None if by_step is None else by_step.agg(F.sum("moved")).first()[0] or 0
    samples = [{k: r[k] for k in ("step", "rain_m3", "runoff_m3", "outflow_m3", "stored_m3")} for r in run.balance.where(F.col("step") % every == 0).orderBy("step").collect()]  # a run's clock
    stages = stage_times(spark)
    measured = [(name, float(v)) for s in stages for name, v in (("run_s", s["run_s"]), ("cpu_s", s["cpu_s"]), ("longest_task_s", s["task_s"][-1] if s["task_s"] else None), ("median_task_s", s["task_s"][1] if s["task_s"] else None)) if v is not None]
    summed = P.summaries(spark.createDataFrame(measured, "measure string, value double"), "measure", "value").collect()
    doc = {
        "scenario": {"master": spark.sparkContext.master, "default_parallelism": spark.sparkContext.defaultParallelism, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")), "dt_s": cfg["model"]["dt_s"], "steps": n},
        "summary": {"wall_clock_s": wall_s, "wall_clock_per_step_mean_s": wall_s / max(1, n), "particle_hops": moved, "particle_throughput_hops_per_s": None if moved is None else moved / max(wall_s, 1e-9), "spawned_particles": spawned, "outflow_particles": out, "segments_s": times.seconds},
        "per_step_samples": samples,
        "stages": stages if detailed else [],
        "stage_summaries": {r["measure"]: {k: r[k] for k in ("n", "mean", "p50", "p95", "max")} for r in summed},
        "notes": ["all steps are one plan: times by step are means", "throughput counts particles that move to another cell or out, over the whole wall time"],
    }
    return json.dumps(doc, indent=2 if detailed else None, sort_keys=True)


def run_report(grid: DataFrame, balance: DataFrame, quality: DataFrame, cfg: dict, elapsed_s: float, detailed: bool = True) -> str:
    """One JSON document; ``grid`` (cell_id, active, area_m2). Only aggregates reach the driver."""
    g = grid.agg(
        F.count("*").alias("cells"), F.sum(F.col("active").cast("long")).alias("active_cells"), *(f(F.when(F.col("active"), F.col("area_m2"))).alias(f"area_{n}_m2") for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max)))
    ).first()
    q = quality.first().asDict()
    steps = balance.agg(F.count("*").alias("n"), F.max("step").alias("last")).first()
    out = {
        "domain": g.asDict(),
        "time": {"dt_s": cfg["model"]["dt_s"], "steps": steps["n"], "wall_s": elapsed_s, "wall_s_per_step": elapsed_s / max(1, steps["n"])},
        "hydrology": {k: v for k, v in q.items() if not k.endswith("_ok")},
        "status": {k: v for k, v in q.items() if k.endswith("_ok")},
    }
    if detailed:
        out["config"] = cfg
    return json.dumps(out, sort_keys=True)


def step_log(balance: DataFrame, every: int = 1) -> DataFrame:
    """(step, line) of every ``every``-th step: volumes of the step and running totals."""
    b = balance.where(F.col("step") % every == 0)
    cols = ("rain_m3", "runoff_m3", "outflow_m3", "rain_cum_m3", "runoff_cum_m3", "outflow_cum_m3", "stored_m3")
    return b.select("step", F.concat_ws(" ", F.lit("mass_balance"), *(F.concat(F.lit(f"{c}="), F.format_number(c, 3)) for c in cols)).alias("line"))
