"""Gaps and islands: runs of equal values, runs merged across short gaps, the longest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochloom.schema import EpochSchema

_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def run_lengths(df: DataFrame, col: str, s: EpochSchema, *, by: tuple[str, ...] = (), length: str = "hyp_seq_length", seq: str = "hyp_seq_id") -> DataFrame:
    """Add the length of each epoch's run of equal ``col`` and the run's number from 0. The column may have any type; null
    counts as False or 0 where it is boolean or a number, else as a value of its own."""
    w, v = s.window(*by), run_value(df, col)
    out = df.withColumn("__new", (F.lag(F.lit(1)).over(w).isNull() | ~v.eqNullSafe(F.lag(v).over(w))).cast("int"))
    out = out.withColumn(seq, (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("__new")
    return out.withColumn(length, F.count(F.lit(1)).over(Window.partitionBy(s.pid, *s.blocks, *by, seq)).cast("int"))


def run_value(df: DataFrame, col: str) -> Column:
    """What runs of a column compare: null is False or 0 where the type has one of them."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.col(col), F.lit(False))
    return F.coalesce(F.col(col), F.lit(0).cast(kind)) if isinstance(kind, T.NumericType) else F.col(col)


def merge_tolerance(df: DataFrame, col: str, minutes: float | Column, s: EpochSchema, *, by: tuple[str, ...] = (), out: str | None = None) -> DataFrame:
    """Set gaps between True epochs that are at most ``minutes`` apart; negative minutes join everything from first to last."""
    w = s.window(*by)
    flag, t = F.coalesce(F.col(col), F.lit(False)), s.seconds(df)
    before = F.max(F.when(flag, t)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(flag, t)).over(s.window_back(*by).rowsBetween(Window.unboundedPreceding, 0))
    close = after - before <= minutes * 60 if isinstance(minutes, Column) else F.lit(True) if minutes < 0 else after - before <= minutes * 60
    return df.withColumn(out or col, flag | F.coalesce(close & before.isNotNull() & after.isNotNull(), F.lit(False)))


def largest_run(df: DataFrame, col: str, s: EpochSchema, *, by: tuple[str, ...] = (), out: str) -> DataFrame:
    """Flag the epochs of each group's longest run of True; the first of equal ones; False throughout if there is none."""
    runs = run_lengths(df, col, s, by=by, length="__len", seq="__seq")
    best = F.max(F.when(F.col(col), F.struct(F.col("__len").alias("n"), (-F.col("__seq")).alias("k")))).over(Window.partitionBy(s.pid, *s.blocks, *by))
    hit = F.col(col) & (best["n"] == F.col("__len")) & (best["k"] == -F.col("__seq"))
    return runs.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__len", "__seq")


def long_runs(df: DataFrame, col: str, minimum: float, s: EpochSchema, *, by: tuple[str, ...] = (), out: str) -> DataFrame:
    """Flag True epochs whose run has more than ``minimum`` epochs."""
    runs = run_lengths(df, col, s, by=by, length="__len", seq="__seq")
    return runs.withColumn(out, F.coalesce(F.col(col), F.lit(False)) & (F.col("__len") > minimum)).drop("__len", "__seq")


def day_night_sequence(df: DataFrame, sleep: str, s: EpochSchema, *, out: str = "ml_sequence", start_by_awaken: bool = True) -> tuple[DataFrame, EpochSchema]:
    """Number days as pairs of a wake and a sleep run; returns the table and a schema whose day is the new column."""
    if dict(df.dtypes)[sleep] != "boolean":
        raise ValueError(f"column {sleep!r} must be boolean")
    runs = run_lengths(df, sleep, s, length="__len", seq="__seq")
    first: Column = F.first(F.coalesce(F.col(sleep), F.lit(False))).over(s.window().rowsBetween(*_ALL))
    shift = first.cast("int") if start_by_awaken else (~first).cast("int")
    return runs.withColumn(out, F.floor((F.col("__seq") - shift) / 2).cast("int")).drop("__len", "__seq"), s.at(day=out)
