"""Diaries, glucose readings and demographics joined to epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochloom.schema import EpochSchema


def add_diary(df: DataFrame, diary: DataFrame, s: EpochSchema, *, bucket_s: int = 86_400) -> DataFrame:
    """Add onset and offset markers (an epoch at the very second) and whether an epoch lies within a diary's sleep.

    Entries without onset or offset only mark. Each entry is spread over the days that it touches, so that the join has an
    equal key beside the bounds and needs no nested loop; an epoch in two entries stays one epoch.
    """
    if s.pid not in diary.columns:
        raise KeyError("the diary has no participant column")
    t = s.seconds(df)
    on, off = (EpochSchema(time=c).seconds(diary) for c in ("sleep_onset", "sleep_offset"))
    entries = diary.select(F.col(s.pid).cast("string").alias("__p"), on.alias("__on"), off.alias("__off"))
    marks = entries.select("__p", F.explode(F.array(F.struct(F.col("__on").alias("t"), F.lit(1).alias("k")), F.struct(F.col("__off").alias("t"), F.lit(2).alias("k")))).alias("m"))
    marks = marks.where("m.t is not null").groupBy("__p", F.col("m.t").alias("__t")).agg(F.max(F.col("m.k") == 1).alias("__is_on"), F.max(F.col("m.k") == 2).alias("__is_off"))
    spans = entries.where("__on <= __off").select("__p", "__on", "__off", F.explode(F.sequence(F.floor(F.col("__on") / bucket_s), F.floor(F.col("__off") / bucket_s))).alias("__d"))
    keep = [c for c in df.columns if c not in (s.diary_onset, s.diary_offset, s.diary_sleep)]
    x = df.select(*keep).withColumn("__t", t).withColumn("__d", F.floor(t / bucket_s)).withColumn("__p", F.col(s.pid).cast("string"))
    # within a day an epoch is inside an entry if the latest end of the entries begun so far isn't past
    starts = spans.select("__p", "__d", F.col("__on").alias("__t"), F.col("__off").alias("__until"))
    both = x.withColumn("__e", F.lit(1)).unionByName(starts.withColumn("__e", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("__p", "__d").orderBy("__t", "__e").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.max("__until").over(w) >= F.col("__t"), F.lit(False))
    x = both.withColumn(s.diary_sleep, inside).where("__e = 1").drop("__e", "__until", "__d")
    x = x.join(marks, ["__p", "__t"], "left")
    out = [*keep, F.coalesce("__is_on", F.lit(False)).alias(s.diary_onset), F.coalesce("__is_off", F.lit(False)).alias(s.diary_offset), s.diary_sleep]
    return x.select(*out)


def add_readings(df: DataFrame, readings: DataFrame, s: EpochSchema, suffix: str = "_cgm") -> DataFrame:
    """Full outer join on participant and time; other columns that both have take ``suffix``."""
    clash = set(df.columns) - {s.pid, s.time}
    right = readings.select(*[F.col(c).alias(c + suffix if c in clash else c) for c in readings.columns])
    return df.join(right, [s.pid, s.time], "full")


def add_demographics(df: DataFrame, people: DataFrame, s: EpochSchema, *, pid: str, strict: bool = False) -> DataFrame:
    """Attributes of the participant; Spark broadcasts ``people`` only while it is small. ``strict``: a participant
    without attributes is an error."""
    if pid not in people.columns:
        raise KeyError(pid)
    right = people.select(F.col(pid).cast("string").alias("__p"), *[c for c in people.columns if c != pid and c not in df.columns])
    if strict and not df.select(F.col(s.pid).cast("string").alias("__p")).distinct().join(right, "__p", "left_anti").isEmpty():
        raise KeyError("participants without demographics")
    return df.withColumn("__p", F.col(s.pid).cast("string")).join(right, "__p", "left").drop("__p")


def restrict_demographics(people: DataFrame, df: DataFrame, s: EpochSchema, *, pid: str) -> DataFrame:
    """People who have epochs."""
    return people.join(df.select(F.col(s.pid).cast("string").alias("__p")).distinct(), F.col(pid).cast("string") == F.col("__p"), "left_semi")
