"""Non-wear detection by long stretches without activity."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochloom.schema import EpochSchema

_UNSET = -0.0001  # stands for missing activity: neither positive nor zero


def detect_nonwear(
    df: DataFrame, s: EpochSchema, *, strategy: str = "choi", activity: str | None = None, min_period_minutes: float = 90, spike_minutes: float = 2,
    window_minutes: float = 30, tolerance: float = 2, threshold: float = 0, close_trailing: bool = True, out: str | None = None,
) -> DataFrame:
    """Add ``hyp_wearing``: 1 worn, 0 not.

    A period starts at an epoch without activity. It ends at an epoch whose neighbourhood holds more than ``tolerance``
    active epochs on either side, or after a run of more than twice the spike length. It counts if it is at least
    ``min_period_minutes`` long. A period still open at the end of the data is left as worn with ``close_trailing``.
    """
    if strategy.lower() not in ("choi", "choi2011", "choi11"):
        raise ValueError(f"unknown strategy {strategy!r}")
    a = activity or s.activity[0]
    s.need(df, a)
    spike, win, least = round(spike_minutes * s.per_minute), round(window_minutes * s.per_minute), min_period_minutes * s.per_minute
    w = s.window()
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("__a", F.coalesce(F.col(a).cast("double"), F.lit(_UNSET)))
    active = (F.col("__a") > 0).cast("int")
    crowded = (F.sum(active).over(w.rowsBetween(spike, win)) > tolerance) | (F.sum(active).over(w.rowsBetween(-win, -2)) > tolerance)
    x = x.select("*", F.row_number().over(w).alias("__rn"), ((F.col("__a") > 0) & F.coalesce(crowded, F.lit(False))).alias("__inv"))
    x = x.select("*", F.max(F.when(F.col("__a") <= threshold, F.col("__rn"))).over(back).alias("__calm"))
    run = F.col("__rn") - F.coalesce(F.col("__calm"), F.lit(0))
    x = x.withColumn("__end", F.col("__inv") | (run >= round(2 * s.per_minute) + 1))
    x = x.withColumn("__g", F.coalesce(F.sum(F.col("__end").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = Window.partitionBy(s.pid, "__g")
    start = F.min(F.when(F.col("__a") <= 0, F.col("__rn"))).over(g)
    end = F.max(F.when(F.col("__end"), F.col("__rn"))).over(g)
    if not close_trailing:
        end = F.coalesce(end, F.max("__rn").over(g) + 1)
    off = (F.col("__rn") >= start) & (F.col("__rn") < end) & (end - start >= least)
    keep = [c for c in df.columns if c != (out or s.wearing)]
    return x.select(*keep, F.when(F.coalesce(off, F.lit(False)), 0).otherwise(1).alias(out or s.wearing))


def combine(df: DataFrame, columns: list[str], out: str, func: str | Callable[[Column, Column], Column] = "and") -> DataFrame:
    """Fold two or more wearing columns from the left by ``and``, ``or`` or a function of two columns."""
    if len(columns) < 2:
        raise ValueError("needs two columns or more")
    fold = {"and": F.least, "or": F.greatest}.get(func, func) if isinstance(func, str) else func
    if isinstance(fold, str):
        raise ValueError(f"unknown function {func!r}")
    return df.withColumn(out, functools.reduce(fold, [F.col(c) for c in columns]))
