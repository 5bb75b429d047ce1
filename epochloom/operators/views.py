"""Data behind the plots: resampled signals, metric tables, midpoints of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochloom.operators.islands import run_lengths
from epochloom.schema import EpochSchema


def resample(df: DataFrame, columns: list[str], s: EpochSchema, *, step_s: int, how: str = "mean", grid: bool = False) -> DataFrame:
    """(pid, ``bucket_s``, columns) by mean or median of steps; ``grid`` adds empty steps between first and last."""
    if how not in ("mean", "median"):
        raise ValueError("how must be 'mean' or 'median'")
    f = F.avg if how == "mean" else F.median
    x = df.withColumn("bucket_s", F.floor(s.seconds(df) / step_s) * step_s).groupBy(s.pid, "bucket_s").agg(*[f(F.col(c).cast("double")).alias(c) for c in columns])
    if not grid:
        return x
    ends = x.groupBy(s.pid).agg(F.min("bucket_s").alias("a"), F.max("bucket_s").alias("b"))
    return ends.select(s.pid, F.explode(F.sequence("a", "b", F.lit(step_s).cast("bigint"))).alias("bucket_s")).join(x, [s.pid, "bucket_s"], "left")


def signals(df: DataFrame, columns: list[str], s: EpochSchema, *, days: list[int] | None = None, hours: tuple[int, int] | None = None, step_s: int | None = None) -> DataFrame:
    """Chosen signals of chosen days and hours, resampled by mean."""
    s.need(df, *columns)
    x = df.where(F.col(s.day).isin(days)) if days is not None else df
    x = x.where(F.hour(s.time).between(hours[0], hours[1] - 1)) if hours else x
    return resample(x, columns, s, step_s=step_s) if step_s else x.select(s.pid, s.day, s.time, *columns)


def heatmap(comparison: DataFrame, labels: list[str]) -> DataFrame:
    """Mean value of a comparison, one row a first and one column a second label."""
    return comparison.groupBy("alg1").pivot("alg2", labels).agg(F.avg("value"))


def sequence_midpoints(df: DataFrame, column: str, s: EpochSchema) -> DataFrame:
    """(pid, ``seq``, ``value``, ``mid_s``, ``n``): middle of each run of equal values."""
    x = run_lengths(df.withColumn("__t", s.seconds(df)), column, s, length="__len", seq="seq")
    return x.groupBy(s.pid, "seq").agg(F.first(column).alias("value"), ((F.min("__t") + F.max("__t")) / 2).alias("mid_s"), F.count("*").alias("n"))


def two_metrics(a: DataFrame, b: DataFrame, s: EpochSchema, x: str, y: str) -> DataFrame:
    """Two metrics side by side, days that lack one left out."""
    return a.select(s.pid, s.day, x).join(b.select(s.pid, s.day, y), [s.pid, s.day]).dropna(subset=[x, y])


def top(df: DataFrame, by: str, n: int, *, ascending: bool = False) -> DataFrame:
    """The first ``n`` rows by a column; nulls last."""
    return df.orderBy(F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()).limit(n)
