"""Runoff over a stream of rain: every cell carries its cumulative rain and runoff from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "cell_id long, step int, rain_mm double, p_cum_mm double, q_cum_mm double, dq_mm double"
STATE = "step int, p_cum_mm double, q_cum_mm double"


def cumulative(p: np.ndarray, cn: float, ia_ratio: float) -> np.ndarray:
    """Curve-number runoff of cumulative rain, as :func:`pluvia.functions.scalars.scs_runoff_mm` has it."""
    if not 0 < cn <= 100:
        return np.zeros(len(p))
    s = 25400.0 / cn - 254.0
    over = np.maximum(p - ia_ratio * s, 0.0)
    return p.copy() if s == 0 else over * over / (over + s)


def runoff_stream(rain: DataFrame, ia_ratio: float = 0.2) -> DataFrame:
    """``OUT`` of a stream (cell_id, cn, step, rain_mm): rows of a batch are taken in order of their steps.

    State is two numbers and the last step for each cell, kept by Spark; rows of steps that are done already (a source that
    repeats itself, or is late) are left out, so that water is counted once.
    """

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).groupby("step", as_index=False).agg({"rain_mm": "sum", "cn": "first"})
        last, p0, q0 = state.get if state.exists else (-(2**31), 0.0, 0.0)
        rows = rows[rows["step"] > last].sort_values("step")
        if not len(rows):
            return
        p = p0 + rows["rain_mm"].fillna(0.0).clip(lower=0.0).cumsum().to_numpy(float)
        q = cumulative(p, float(rows["cn"].iloc[0] or 0.0), ia_ratio)
        state.update((int(rows["step"].iloc[-1]), float(p[-1]), float(q[-1])))
        dq = np.maximum(np.diff(np.concatenate([[q0], q])), 0.0)
        yield pd.DataFrame({"cell_id": key[0], "step": rows["step"].to_numpy(np.int32), "rain_mm": rows["rain_mm"].to_numpy(float), "p_cum_mm": p, "q_cum_mm": q, "dq_mm": dq})

    return rain.groupBy("cell_id").applyInPandasWithState(advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
