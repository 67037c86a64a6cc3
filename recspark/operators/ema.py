"""Exact exponential moving average of a long ordered log.

One step ``x -> alpha * y + (1 - alpha) * x`` is an affine map, and such maps
compose.  Each range partition of the log folds its rows to one pair (a, b),
plus the value it would give when the average starts inside it; the pairs, at
most one per partition, are composed in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = "part int, n long, a double, b double, started boolean, value double"


def _fold(values: np.ndarray, alpha: float) -> tuple[float, float]:
    """(a, b) with average after ``values`` = a * average before + b."""
    m = len(values)
    weights = alpha * (1 - alpha) ** np.arange(m - 1, -1, -1, dtype=np.float64)
    return float((1 - alpha) ** m), float(weights @ values)


def fold_parts(updates: DataFrame, alpha: float, value: str = "latency_ms", order=("ts", "event_id")) -> list:
    """One row per non-empty range partition of ``updates``, in order: number
    of values, affine pair, and the average when the first non-zero value of
    the partition seeds it.  Null values are no updates."""
    rows = updates.select(*order, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "_v")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, a, b, started, x = None, 0, 1.0, 0.0, False, 0.0
        for pdf in batches:
            v = pdf["_v"].to_numpy(dtype=np.float64)
            if not len(v):
                continue
            part = int(pdf["part"].iloc[0])
            n += len(v)
            fa, fb = _fold(v, alpha)
            a, b = a * fa, fb + fa * b
            if started:
                x = fa * x + fb
            elif (nonzero := np.flatnonzero(v)).size:
                ga, gb = _fold(v[nonzero[0] + 1:], alpha)
                started, x = True, ga * v[nonzero[0]] + gb
        if n:
            yield pd.DataFrame([(part, n, a, b, started, x)], columns=["part", "n", "a", "b", "started", "value"])

    return sorted(rows.mapInPandas(work, _PART).collect())  # at most one row per partition


def compose(parts: list, state: tuple[int, float] = (0, 0.0)) -> tuple[int, float]:
    """(updates, average) after the partitions, starting from ``state``.  The
    average is seeded by the first non-zero value while it is 0."""
    n, x = state
    for p in parts:
        n += p["n"]
        x = p["a"] * x + p["b"] if x != 0 else p["value"] if p["started"] else 0.0
    return n, x
