"""Experiment days, sampling frequency, weekdays and clock features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochloom.schema import EpochSchema


def with_day(df: DataFrame, s: EpochSchema, start_hour: int = 0, *, out: str | None = None) -> DataFrame:
    """Day number: calendar days since the participant's first epoch, days starting at ``start_hour``; may be -1."""
    first = F.to_date(F.min(s.time).over(Window.partitionBy(s.pid)))
    return df.withColumn(out or s.day, F.datediff(F.to_date(F.col(s.time) - F.expr(f"make_dt_interval(0, {int(start_hour)})")), first))


def fill_no_activity(df: DataFrame, s: EpochSchema, value: float, column: str | None = None) -> DataFrame:
    """Replace null activity."""
    c = column or s.activity[0]
    return df.withColumn(c, F.coalesce(F.col(c), F.lit(value)))


def has_no_activity(df: DataFrame, s: EpochSchema) -> DataFrame:
    """(pid, ``has_null``): whether a participant has an epoch without activity."""
    return df.groupBy(s.pid).agg(F.max(F.col(s.activity[0]).isNull()).alias("has_null"))


def frequency(df: DataFrame, s: EpochSchema, *, strict: bool = False) -> DataFrame:
    """(pid, ``freq_s``): seconds between epochs; null where they are not equally spaced, which ``strict`` makes an error."""
    t = s.seconds(df)
    steps = df.select(s.pid, (t - F.lag(t).over(s.window())).alias("d"))
    out = steps.groupBy(s.pid).agg(F.when(F.min("d") == F.max("d"), F.min("d")).alias("freq_s"))
    if strict and not out.where("freq_s is null").isEmpty():
        raise ValueError("epochs are not equally spaced")
    return out


def experiment_days(df: DataFrame, s: EpochSchema) -> DataFrame:
    """Distinct (pid, day)."""
    return df.select(s.pid, s.day).distinct()


def weekday(df: DataFrame, s: EpochSchema, *, out: str = "hyp_weekday") -> DataFrame:
    """(pid, day, weekday): the most frequent weekday of a day's epochs, Monday 0; the smallest of equally frequent ones."""
    return df.groupBy(s.pid, s.day).agg(F.mode(F.weekday(s.time), deterministic=True).alias(out))


def is_weekend(df: DataFrame, s: EpochSchema, weekend: tuple[int, ...] = (5, 6), *, out: str = "hyp_is_weekend") -> DataFrame:
    """(pid, day, weekday, whether it is in ``weekend``)."""
    return weekday(df, s).withColumn(out, F.col("hyp_weekday").isin(list(weekend)))


def encode_datetime(time: Column, name: str) -> list[Column]:
    """Year, and month, day, hour and minute as points on a circle."""
    turns = {
        "month": F.month(time) / 12, "day": F.day(time) / F.day(F.last_day(time)), "hour": F.hour(time) / 24, "minute": F.minute(time) / 60,
    }
    out = [F.year(time).alias(f"{name}_year")]
    for part, turn in turns.items():
        out += [F.sin(2 * math.pi * turn).alias(f"{name}_{part}_sin"), F.cos(2 * math.pi * turn).alias(f"{name}_{part}_cos")]
    return out


def clock_seconds(text: Column) -> Column:
    """Seconds since midnight of ``HH:MM`` or ``HH:MM:SS``; the marks L, H and Z and anything else give null."""
    p = F.split(F.trim(text), ":")
    n = F.size(p)
    part = lambda i: F.get(p, F.lit(i)).try_cast("int")
    return F.when(n == 2, part(0) * 3600 + part(1) * 60).when(n == 3, part(0) * 3600 + part(1) * 60 + part(2))
