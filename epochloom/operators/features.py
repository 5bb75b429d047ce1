"""Learning tables: target classes, lag features, next-day targets, folds, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper ages of the groups, and per group the bounds of the classes.
AGE_GROUPS = (1, 2, 5, 13, 17, 25, 64)
#: Awakenings: most for class 2 and for class 1, by age group.
AWAKENINGS = ((1, 3), (1, 3), (1, 3), (1, 3), (1, 2), (1, 3), (1, 3), (2, 3))
#: Efficiency in percent: least for class 2 and for class 1, by age group.
EFFICIENCY = ((85, 75), (85, 75), (85, 75), (85, 75), (85, 75), (85, 65), (85, 75), (85, 75))
#: Hours asleep: bounds of class 2 and of class 1, by age group.
SLEEP_HOURS = ((12, 15, 10, 18), (11, 14, 9, 16), (10, 13, 8, 14), (9, 11, 7, 12), (8, 10, 7, 11), (7, 9, 6, 11), (7, 9, 6, 10), (7, 8, 5, 9))
#: Recommended hours by age: (least age is below, hours from, hours to).
RECOMMENDED_HOURS = ((6, False, 10, 14), (12, True, 9, 12), (18, True, 8, 10), (60, True, 7, 12), (64, True, 7, 9), (None, True, 7, 8))


def age_group(age: Column) -> Column:
    """Group 0 to 7; null for null."""
    out = F.lit(len(AGE_GROUPS))
    for i in reversed(range(len(AGE_GROUPS))):
        out = F.when(age <= AGE_GROUPS[i], i).otherwise(out)
    return F.when(age.isNotNull(), out)


def _of_group(group: Column, value) -> Column:
    """An expression per group."""
    out = None
    for i in range(len(AGE_GROUPS) + 1):
        out = F.when(group == i, value(i)) if out is None else out.when(group == i, value(i))
    return out


def awakenings_class(n: Column, age: Column) -> Column:
    return F.when(n.isNotNull(), _of_group(age_group(age), lambda i: F.when(n <= AWAKENINGS[i][0], 2).when(n <= AWAKENINGS[i][1], 1).otherwise(0)))


def efficiency_class(se: Column, age: Column) -> Column:
    return F.when(se.isNotNull(), _of_group(age_group(age), lambda i: F.when(se >= EFFICIENCY[i][0], 2).when(se >= EFFICIENCY[i][1], 1).otherwise(0)))


def sleep_hours_class(h: Column, age: Column) -> Column:
    b = SLEEP_HOURS
    return F.when(h.isNotNull(), _of_group(age_group(age), lambda i: F.when(h.between(b[i][0], b[i][1]), 2).when(h.between(b[i][2], b[i][3]), 1).otherwise(0)))


def recommended_hours(age: Column) -> Column:
    """Struct of the hours ``lo`` to ``hi`` recommended at an age."""
    pair = lambda lo, hi: F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    out = None
    for bound, inclusive, lo, hi in RECOMMENDED_HOURS:
        if bound is None:
            return F.when(age.isNotNull(), out.otherwise(pair(lo, hi)))
        test = age <= bound if inclusive else age < bound
        out = F.when(test, pair(lo, hi)) if out is None else out.when(test, pair(lo, hi))
    raise AssertionError


def plain_efficiency_class(se: Column) -> Column:
    return F.when(se <= 60, 0).when(se <= 90, 1).when(se.isNotNull(), 2)


def plain_sleep_class(h: Column, lo: float, hi: float, tolerance: float = 1) -> Column:
    return F.when((h < lo - tolerance) | (h > hi + tolerance), 0).when((h < lo) | (h > hi), 1).when(h.isNotNull(), 2)


def plain_awakenings_class(n: Column) -> Column:
    return F.when(n <= 0, 2).when(n <= 2, 1).when(n.isNotNull(), 0)


def combined_class(total: Column) -> Column:
    """Class of the sum of three classes."""
    return F.when(total <= 2, 0).when(total <= 4, 1).when(total.isNotNull(), 2)


def target_classes(df: DataFrame, age: str, target: str, *, awakening: str = "awakening", efficiency: str = "sleepEfficiency", hours: str = "totalSleepTime", keep_others: bool = False) -> DataFrame:
    """Replace a target, or for ``combined`` derive one from all three, by its class for the age."""
    a = F.col(age)
    classes = {awakening: awakenings_class(F.col(awakening), a), efficiency: efficiency_class(F.col(efficiency), a), hours: sleep_hours_class(F.col(hours), a)}
    if target in classes:
        return df.withColumn(target, classes[target])
    if target != "combined":
        raise ValueError(f"unknown target {target!r}")
    out = df.withColumns(classes).withColumn("combined", combined_class(F.col(hours) + F.col(efficiency) + F.col(awakening)))
    return out if keep_others else out.drop(awakening, efficiency, hours)


def hash_fold(pid: Column, k: int) -> Column:
    """Fold 0 to k-1 of a participant, by hash: the same everywhere, without a table."""
    return F.pmod(F.xxhash64(pid), F.lit(k)).cast("int")


def split_of_fold(fold: Column, *, test: int = 10, validation: int = 9) -> Column:
    return F.when(fold == test, "test").when(fold == validation, "validation").when(fold.isNotNull(), "train")


def lag_features(df: DataFrame, columns: list[str], n: int, *, pid: str = "pid", order: str = "ml_sequence", drop_null: bool = True) -> DataFrame:
    """Columns of the ``n`` days before, as ``<name>-<k>d``; rows without all of them are dropped unless told otherwise."""
    w = Window.partitionBy(pid).orderBy(order)
    names = {f"{c}-{k}d": F.lag(c, k).over(w) for k in range(1, n + 1) for c in columns}
    out = df.select("*", *[v.alias(k) for k, v in names.items()])
    for k in names if drop_null else ():
        out = out.where(F.col(f"`{k}`").isNotNull())
    return out


def next_day_target(df: DataFrame, target: str, *, days: int = 1, pid: str = "pid", order: str = "ml_sequence", out: str | None = None) -> DataFrame:
    """Add the target of the day whose number is larger by ``days``; null where that day is missing."""
    later = df.select(F.col(pid), (F.col(order) - days).alias(order), F.col(target).alias(out or f"next_{target}"))
    return df.join(later, [pid, order], "left")


def sequence_lengths(df: DataFrame, *, pid: str = "pid", order: str = "ml_sequence") -> DataFrame:
    """(pid, sequence, number of rows)."""
    return df.groupBy(pid, order).agg(F.count("*").alias("n"))


def standard_scale(df: DataFrame, columns: list[str], *, by: tuple[str, ...] = ()) -> DataFrame:
    """Centre and divide by the population deviation, of all rows or of each group; a constant column is centred only."""
    if by:
        w = Window.partitionBy(*by)
        scale = {c: (F.avg(c).over(w), F.stddev_pop(c).over(w)) for c in columns}
        return df.select(*[c for c in df.columns if c not in columns], *[((F.col(c) - m) / F.when(d > 0, d).otherwise(1.0)).alias(c) for c, (m, d) in scale.items()])
    row = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__d_{c}") for c in columns])  # one row
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__d_{c}") > 0, F.col(f"__d_{c}")).otherwise(1.0) for c in columns}
    return df.crossJoin(row).withColumns(scaled).select(*df.columns)


def one_hot(df: DataFrame, column: str, values: list, *, prefix: str | None = None) -> DataFrame:
    """A 0/1 column a value."""
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix or column}_{v}") for v in values])


def force_categories(df: DataFrame, columns: list[str], missing: int = -1) -> DataFrame:
    """Integer categories; a missing one is ``missing``."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(missing)) for c in columns})


def body_mass_index(df: DataFrame, *, weight: str = "weight", height: str = "height", out: str = "bmi") -> DataFrame:
    """Weight by squared height; null for a height of 0."""
    return df.withColumn(out, F.col(weight) / F.nullif(F.col(height) * F.col(height), F.lit(0.0)))


def clean_sentinels(df: DataFrame, columns: list[str], sentinels: tuple[str, ...] = ("S", "Q")) -> DataFrame:
    """Text columns to numbers; sentinels and other texts become null."""
    return df.withColumns({c: F.when(~F.trim(F.col(c).cast("string")).isin(*sentinels), F.col(c).cast("string")).try_cast("double") for c in columns})


def join_features(tables: list[DataFrame], keys: list[str], suffixes: list[str] | None = None) -> DataFrame:
    """Inner join of feature tables; columns that several have take the table's suffix."""
    out, seen = tables[0], set(tables[0].columns)
    for i, t in enumerate(tables[1:], 1):
        suffix = (suffixes or [])[i] if suffixes else f"_{i}"
        t = t.select(*keys, *[F.col(c).alias(c + suffix if c in seen else c) for c in t.columns if c not in keys])
        seen |= set(t.columns)
        out = out.join(t, keys)
    return out


def annotation_from(column: Column, values: list | None = None, *, negate: bool = False) -> Column:
    """A boolean annotation from stages, intervals or labels: True where the value is one of ``values`` (or non-zero)."""
    hit = column.isin(values) if values is not None else column != 0
    return F.coalesce(~hit if negate else hit, F.lit(False))


def met_minutes(df: DataFrame, levels: dict[str, float], *, minutes: str = "{}", days: float = 7, out: str = "met_minutes") -> DataFrame:
    """Weekly MET-minutes: minutes of each level times its weight, times ``days``; a missing level counts nothing."""
    total = None
    for name, weight in levels.items():
        term = F.coalesce(F.col(minutes.format(name)), F.lit(0)) * weight
        total = term if total is None else total + term
    return df.withColumn(out, total * days)


def melt(df: DataFrame, keys: list[str], values: list[str], *, name: str = "variable", value: str = "value") -> DataFrame:
    """One row a value column."""
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, name, value)


def pad_sequence(values: Column, length: int, fill: float = 0.0) -> Column:
    """An array cut or filled to a length."""
    return F.slice(F.concat(F.coalesce(values, F.array().cast("array<double>")), F.array_repeat(F.lit(fill), length)), 1, length)


def linear_fit(df: DataFrame, inputs: list[str], target: str, *, regularisation: float = 0.0):
    """A linear regression of ``pyspark.ml`` over rows without nulls."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*inputs, target])]).dropna()
    return LinearRegression(featuresCol="__x", labelCol=target, regParam=regularisation).fit(VectorAssembler(inputCols=inputs, outputCol="__x").transform(rows))
