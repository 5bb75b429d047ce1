"""Physical-activity levels, bouts, bins and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochloom.operators.islands import merge_tolerance, run_lengths
from epochloom.schema import EpochSchema


@dataclass(frozen=True)
class Cutoffs:
    """Ascending cut-offs and one more name than cut-offs, from the lowest level up."""

    cutoffs: tuple[float, ...]
    names: tuple[str, ...]

    def __post_init__(self):
        if len(self.names) != len(self.cutoffs) + 1 or list(self.cutoffs) != sorted(self.cutoffs):
            raise ValueError("needs ascending cut-offs and one more name")


def pa_levels(df: DataFrame, cuts: Cutoffs, based_on: str) -> DataFrame:
    """One boolean column a level: the lowest is at most the first cut-off, the others above their cut-off, so they overlap upwards."""
    v = F.col(based_on)
    flags = [(v <= cuts.cutoffs[0]).alias(cuts.names[0])] + [(v > c).alias(n) for c, n in zip(cuts.cutoffs, cuts.names[1:])]
    return df.select("*", *[F.coalesce(f, F.lit(False)).alias(n) for f, n in zip(flags, cuts.names)])


def _keys(s: EpochSchema, resolution: str) -> list[Column]:
    if resolution not in ("day", "hour"):
        raise ValueError("resolution must be 'day' or 'hour'")
    return [F.col(s.pid), F.col(s.day), *([F.hour(s.time).alias("hour")] if resolution == "hour" else [])]


def bouts(df: DataFrame, level: str, minutes: float, s: EpochSchema, *, allowance: float = 0, resolution: str = "day", sleep: str | None = None, out: str = "n_bouts") -> DataFrame:
    """(pid, day[, hour], count) of runs of ``level`` of at least ``minutes``; gaps up to ``allowance`` minutes are bridged.

    With ``sleep`` only epochs awake count. A bout belongs to the hour of its first epoch that remains.
    """
    x = df.withColumn("__lvl", F.coalesce(F.col(level), F.lit(False)))
    if allowance > 0:
        x = merge_tolerance(x, "__lvl", allowance, s)
    x = run_lengths(x, "__lvl", s, length="__len", seq="__seq")
    x = x.where(F.col("__lvl") & (F.col("__len") >= minutes * s.per_minute))
    if sleep:
        x = x.where(~F.coalesce(F.col(sleep).cast("boolean"), F.lit(False)))
    first = x.select("*", F.row_number().over(s.window("__seq")).alias("__k")).where("__k = 1")
    return first.groupBy(*_keys(s, resolution)).agg(F.count("*").alias(out))


def binned(df: DataFrame, cuts: Cutoffs, based_on: str, s: EpochSchema, *, resolution: str = "hour") -> DataFrame:
    """Epochs per level and day or hour; inner levels include both of their bounds, so a value on a bound counts twice."""
    v, c, n = F.col(based_on), cuts.cutoffs, cuts.names
    tests = [v <= c[0], *[v.between(a, b) for a, b in zip(c[:-1], c[1:])], v > c[-1]]
    return df.groupBy(*_keys(s, resolution)).agg(*[F.sum(F.when(t, 1).otherwise(0)).alias(name) for t, name in zip(tests, n)])


def skew_kurtosis(v: Column) -> tuple[Column, Column]:
    """Bias-corrected skewness (3 values or more) and excess kurtosis (4 or more); 0 where all values are equal."""
    n, flat = F.count(v).cast("double"), F.var_pop(v) == 0
    g1, g2 = F.skewness(v), F.kurtosis(v)
    skew = F.when(n >= 3, F.when(flat, 0.0).otherwise(g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))))
    kurt = F.when(n >= 4, F.when(flat, 0.0).otherwise(((n + 1) * g2 + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))))
    return skew, kurt


def stats(df: DataFrame, based_on: str, s: EpochSchema, *, resolution: str = "hour") -> DataFrame:
    """Mean, median, sample deviation, minimum, maximum, skewness, kurtosis and distinct values per day or hour."""
    v = F.col(based_on).cast("double")
    skew, kurt = skew_kurtosis(v)
    return df.groupBy(*_keys(s, resolution)).agg(
        F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        skew.alias("skew"), kurt.alias("kurt"), F.count_distinct(v).alias("nunique"),
    )


def raw_day(df: DataFrame, based_on: str, s: EpochSchema, *, length: int | None = None, out: str = "raw_pa") -> DataFrame:
    """(pid, day, array of values in order); with ``length`` padded with 0 or cut to it."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(s.time).alias("t"), F.col(s.row or s.time).alias("k"), F.col(based_on).cast("double").alias("v")))), lambda e: e["v"])
    if length:
        ordered = F.slice(F.concat(ordered, F.array_repeat(F.lit(0.0), length)), 1, length)
    return df.groupBy(s.pid, s.day).agg(ordered.alias(out))


def raw_hour(df: DataFrame, based_on: str, s: EpochSchema, *, prefix: str = "hyp_act_x") -> DataFrame:
    """(pid, day, hour, one column a minute and second of the hour): mean of the values there. Columns follow the sampling."""
    marks = [f"{m:02d}_{x:02d}" for m in range(60) for x in range(0, 60, min(s.freq_s, 60))] if s.freq_s < 3600 else ["00_00"]
    at = F.format_string("%02d_%02d", F.minute(s.time), F.second(s.time).cast("int"))
    wide = df.select(s.pid, s.day, F.hour(s.time).alias("hour"), at.alias("__at"), F.col(based_on).cast("double").alias("__v"))
    out = wide.groupBy(s.pid, s.day, "hour").pivot("__at", marks).agg(F.avg("__v"))
    return out.select(s.pid, s.day, "hour", *[F.col(m).alias(f"{prefix}_{m}") for m in marks])


def hour_pivot(df: DataFrame, values: list[str], s: EpochSchema, *, hours: range = range(24)) -> DataFrame:
    """(pid, day, one column a value and hour) from an hourly table; hours without row are 0."""
    wide = df.groupBy(s.pid, s.day).pivot("hour", list(hours)).agg(*[F.sum(v).alias(v) for v in values])
    names = [(f"{h}_{v}" if len(values) > 1 else f"{h}", f"{v}_{h:02d}") for v in values for h in hours]
    return wide.select(s.pid, s.day, *[F.coalesce(F.col(f"`{a}`"), F.lit(0)).alias(b) for a, b in names])


def complete_hours(df: DataFrame, s: EpochSchema, fill: dict[str, float]) -> DataFrame:
    """Every hour 0-23 of every (pid, day) of an hourly table; missing ones take the values of ``fill``."""
    grid = df.select(s.pid, s.day).distinct().select(s.pid, s.day, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return grid.join(df, [s.pid, s.day, "hour"], "left").fillna(fill)


def bout_table(
    df: DataFrame, levels: list[str], lengths: list[float], s: EpochSchema, *, resolution: str = "day", allowance: float = 0, sleep: str | None = None
) -> DataFrame:
    """(pid, day[, hour], one column ``<level>_<minutes>`` a level and length): :func:`bouts` of each, 0 where there are none.

    The runs of all levels come from one pass over the epochs and are counted for all lengths in one aggregation.
    """
    x, w, names = df, s.window(), range(len(levels))
    for i, level in enumerate(levels):
        x = x.withColumn(f"__l{i}", F.coalesce(F.col(level), F.lit(False)))
        x = merge_tolerance(x, f"__l{i}", allowance, s) if allowance > 0 else x
    x = x.select("*", *[(F.lag(F.lit(1)).over(w).isNull() | ~F.col(f"__l{i}").eqNullSafe(F.lag(f"__l{i}").over(w))).cast("int").alias(f"__n{i}") for i in names])
    x = x.select("*", *[F.sum(f"__n{i}").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__q{i}") for i in names])
    awake = ~F.coalesce(F.col(sleep).cast("boolean"), F.lit(False)) if sleep else F.lit(True)
    order, place = [s.time, *([s.row] if s.row else [])], _keys(s, resolution)[1:]
    fields = {f"o{i}": F.col(c) for i, c in enumerate(order)} | {f"k{i}": k for i, k in enumerate(place)}
    place = F.when(awake, F.named_struct(*[x for n, v in fields.items() for x in (F.lit(n), v)]))
    runs = x.select(s.pid, place.alias("at"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__l{i}").alias("l"), F.col(f"__q{i}").alias("q")) for i in names])).alias("r")).where("r.l")
    runs = runs.groupBy(s.pid, "r.i", "r.q").agg(F.count("*").alias("n"), F.min("at").alias("at")).where("at is not null")
    keys = [s.day, *(["hour"] if resolution == "hour" else [])]
    counts = {f"{v}_{m:g}": F.count_if((F.col("i") == i) & (F.col("n") >= m * s.per_minute)) for i, v in enumerate(levels) for m in lengths}
    table = runs.groupBy(s.pid, *[F.col(f"at.k{j}").alias(k) for j, k in enumerate(keys)]).agg(*[c.alias(n) for n, c in counts.items()])
    return df.select(*_keys(s, resolution)).distinct().join(table, [s.pid, *keys], "left").fillna(0, list(counts))
