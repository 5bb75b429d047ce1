"""Validity flags of epochs and days as a bit mask, and removal of what is not valid.

Day flags look at the bits set so far, so the order of calls is part of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochloom.schema import EpochSchema, InvCode


def init(df: DataFrame, s: EpochSchema) -> DataFrame:
    """Start with no flag; earlier ones go."""
    return df.withColumn(s.invalid, F.lit(0))


def _set(df: DataFrame, s: EpochSchema, when: Column, code: InvCode) -> DataFrame:
    bit = F.when(F.coalesce(when, F.lit(False)), int(code)).otherwise(0)
    return df.withColumn(s.invalid, F.col(s.invalid).bitwiseOR(bit))


def _day(s: EpochSchema) -> Window:
    return Window.partitionBy(s.pid, s.day)


def _minutes(flag: Column, s: EpochSchema) -> Column:
    return F.sum(F.coalesce(flag.cast("int"), F.lit(0))).over(_day(s)) / F.lit(s.per_minute)


def flag_epoch_low_activity(df: DataFrame, s: EpochSchema, minimum: float = 0, column: str | None = None) -> DataFrame:
    return _set(df, s, F.col(column or s.activity[0]) < minimum, InvCode.FLAG_EPOCH_PA)


def flag_epoch_null(df: DataFrame, s: EpochSchema, columns: list[str]) -> DataFrame:
    s.need(df, *columns)
    return _set(df, s, F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) == 1, InvCode.FLAG_EPOCH_NULL_VALUE)


def flag_epoch_nonwearing(df: DataFrame, s: EpochSchema, column: str | None = None) -> DataFrame:
    s.need(df, column or s.wearing)
    return _set(df, s, F.col(column or s.wearing) == 0, InvCode.FLAG_EPOCH_NON_WEARING)


def flag_day_short_sleep(df: DataFrame, s: EpochSchema, sleep: str, minutes: float) -> DataFrame:
    s.need(df, sleep)
    return _set(df, s, _minutes(F.col(sleep).cast("int"), s) < minutes, InvCode.FLAG_DAY_SHORT_SLEEP)


def flag_day_long_sleep(df: DataFrame, s: EpochSchema, sleep: str, minutes: float) -> DataFrame:
    s.need(df, sleep)
    return _set(df, s, _minutes(F.col(sleep).cast("int"), s) > minutes, InvCode.FLAG_DAY_LONG_SLEEP)


def flag_day_max_nonwearing(df: DataFrame, s: EpochSchema, minutes: float) -> DataFrame:
    """Days with ``minutes`` or more flagged by an epoch flag."""
    bad = F.col(s.invalid).bitwiseAND(int(InvCode.FLAG_EPOCH_PA | InvCode.FLAG_EPOCH_NON_WEARING | InvCode.FLAG_EPOCH_NULL_VALUE)) != 0
    return _set(df, s, _minutes(bad, s) >= minutes, InvCode.FLAG_DAY_NON_WEARING)


def flag_day_few_valid(df: DataFrame, s: EpochSchema, minutes: float) -> DataFrame:
    """Days with at most ``minutes`` without any flag."""
    return _set(df, s, _minutes(F.col(s.invalid) == 0, s) <= minutes, InvCode.FLAG_DAY_NOT_ENOUGH_VALID_EPOCHS)


def flag_day_many_invalid(df: DataFrame, s: EpochSchema, minutes: float) -> DataFrame:
    """Days with ``minutes`` or more with any flag."""
    return _set(df, s, _minutes(F.col(s.invalid) != 0, s) >= minutes, InvCode.FLAG_DAY_TOO_MANY_INVALID_EPOCHS)


def flag_day_without_diary(df: DataFrame, s: EpochSchema) -> DataFrame:
    s.need(df, s.diary_sleep)
    return _set(df, s, _minutes(F.col(s.diary_sleep), s) == 0, InvCode.FLAG_DAY_WITHOUT_DIARY)


def days(df: DataFrame, s: EpochSchema) -> DataFrame:
    """(pid, day, ``valid``): a day is invalid only if all of its epochs have a flag."""
    return df.groupBy(s.pid, s.day).agg((~F.bool_and(F.col(s.invalid) != 0)).alias("valid"))


def valid_days(df: DataFrame, s: EpochSchema) -> DataFrame:
    return days(df, s).where("valid").select(s.pid, s.day)


def invalid_days(df: DataFrame, s: EpochSchema) -> DataFrame:
    return days(df, s).where("not valid").select(s.pid, s.day)


def flag_day_consecutive(df: DataFrame, s: EpochSchema, n: int, *, keep: str = "first") -> DataFrame:
    """Flag days outside runs of at least ``n`` consecutive valid days; only the first such run is kept, or ``all``."""
    if keep not in ("first", "all"):
        raise ValueError("keep must be 'first' or 'all'")
    good = valid_days(df, s).withColumn("__isle", F.col(s.day) - F.row_number().over(Window.partitionBy(s.pid).orderBy(s.day)))
    good = good.withColumn("__n", F.count("*").over(Window.partitionBy(s.pid, "__isle"))).where(F.col("__n") >= n)
    if keep == "first":
        good = good.withColumn("__first", F.min("__isle").over(Window.partitionBy(s.pid))).where("__isle = __first")
    kept = good.select(s.pid, s.day, F.lit(True).alias("__kept"))
    return _set(df.join(kept, [s.pid, s.day], "left"), s, F.col("__kept").isNull(), InvCode.FLAG_DAY_NOT_ENOUGH_CONSECUTIVE_DAYS).drop("__kept")


def remove_flagged_days(df: DataFrame, s: EpochSchema) -> DataFrame:
    """Epochs of valid days."""
    return df.withColumn("__bad", F.bool_and(F.col(s.invalid) != 0).over(_day(s))).where("not __bad").drop("__bad")


def remove_participants(df: DataFrame, s: EpochSchema, pids: list[str]) -> DataFrame:
    return df.where(~F.col(s.pid).isin(pids))


def remove_without_valid_days(df: DataFrame, s: EpochSchema) -> DataFrame:
    """Participants with a valid day."""
    return df.join(valid_days(df, s).select(s.pid).distinct(), s.pid, "left_semi")


def remove_without_diary(df: DataFrame, diary: DataFrame, s: EpochSchema, pid: str = "pid") -> DataFrame:
    """Participants that the diary has an entry of."""
    return df.join(diary.select(F.col(pid).alias(s.pid)).distinct(), s.pid, "left_semi")


def report(df: DataFrame, s: EpochSchema) -> DataFrame:
    """(``flag``, ``n_days``): days all of whose epochs have the flag, for each day flag."""
    codes = [c for c in InvCode if c.name.startswith("FLAG_DAY")]
    per = df.groupBy(s.pid, s.day).agg(*[F.bool_and(InvCode.has(F.col(s.invalid), c)).cast("int").alias(c.name) for c in codes])
    total = per.agg(*[F.coalesce(F.sum(c.name), F.lit(0)).alias(c.name) for c in codes])
    return total.unpivot([], [c.name for c in codes], "flag", "n_days")
