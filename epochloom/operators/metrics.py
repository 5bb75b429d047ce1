"""Sleep quality per day, agreement of labels, comparison of metrics."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochloom.operators.islands import run_lengths
from epochloom.schema import EpochSchema

#: Names by which a metric may be asked for, lower case.
METRICS = {
    "sleepefficiency": "se", "se": "se", "sleep_efficiency": "se", "awakening": "aw", "awakenings": "aw", "arousal": "aw", "arousals": "aw",
    "totaltimeinbed": "tib", "totalsleeptime": "tst", "totalwaketime": "twt", "sri": "sri", "sleep_regularity_index": "sri", "sleepregularityindex": "sri",
}


def total_sleep_time(df: DataFrame, sleep: str, s: EpochSchema, *, out: str = "tst_min") -> DataFrame:
    """(pid, day, minutes asleep)."""
    s.need(df, sleep)
    return df.groupBy(s.pid, s.day).agg((F.sum(F.coalesce(F.col(sleep).cast("int"), F.lit(0))) / F.lit(s.per_minute)).alias(out))


def sleep_onset_offset(df: DataFrame, sleep: str, s: EpochSchema) -> DataFrame:
    """(pid, day, ``onset``, ``offset``): first and last time asleep; null for a day without sleep."""
    s.need(df, sleep)
    asleep = F.when(F.col(sleep).cast("int") == 1, F.col(s.time))
    return df.groupBy(s.pid, s.day).agg(F.min(asleep).alias("onset"), F.max(asleep).alias("offset"))


def diary_onset_offset(df: DataFrame, s: EpochSchema) -> DataFrame:
    """(pid, day, ``onset``, ``offset``) from the diary's markers."""
    mark = lambda c: F.when(F.col(c), F.col(s.time))
    return df.groupBy(s.pid, s.day).agg(F.min(mark(s.diary_onset)).alias("onset"), F.max(mark(s.diary_offset)).alias("offset"))


def overall_stats(df: DataFrame, s: EpochSchema) -> DataFrame:
    """One row: participants, days and epochs, with mean, population deviation, maximum and minimum per participant."""
    per = df.groupBy(s.pid).agg(F.count_distinct(s.day).alias("d"), F.count("*").alias("e"))
    cols = [F.count("*").alias("n_participants")]
    for c, name in (("d", "days"), ("e", "epochs")):
        cols += [F.sum(c).alias(f"total_{name}"), F.avg(c).alias(f"mean_{name}"), F.stddev_pop(c).alias(f"std_{name}"), F.max(c).alias(f"max_{name}"), F.min(c).alias(f"min_{name}")]
    return per.agg(*cols)


def sleep_quality(df: DataFrame, metric: str, label: str, s: EpochSchema, *, period: str | None = None, ignore_minutes: float = 0, per_hour: bool = False, out: str | None = None) -> DataFrame:
    """(pid, day, value, parameters) of one metric; every day of the data has a row.

    ``period`` limits the epochs to those where it is True. Wake runs of at most ``ignore_minutes`` count as sleep
    (efficiency) or as no awakening. Awakenings don't count a leading wake run. The regularity index compares a day
    with the one before it position by position and is null where they have different lengths; the first day has none.
    """
    kind = METRICS.get(metric.lower())
    if kind is None:
        raise ValueError(f"unknown metric {metric!r}")
    s.need(df, label, *([period] if period else []))
    name, short = out or metric, ignore_minutes * s.per_minute
    rows = df.where(F.col(period)) if period else df
    awake = (F.coalesce(F.col(label).cast("int"), F.lit(0)) == 0).alias("__awake")
    rows = rows.select(*[c for c in dict.fromkeys([s.pid, s.day, s.time, *([s.row] if s.row else [])])], awake, F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("__l"))
    days = df.select(s.pid, s.day).distinct()
    n, hours = F.count(F.lit(1)), F.count(F.lit(1)) / F.lit(s.per_hour)
    empty: Column = F.lit(0.0)
    if kind == "sri":
        value = _regularity(rows, days, s, name)
    elif kind in ("se", "aw"):
        runs = run_lengths(rows, "__awake", s, by=(s.day,), length="__len", seq="__seq")
        if kind == "se":
            asleep = (~F.col("__awake") | (F.col("__len") <= short)).cast("int")
            value = runs.groupBy(s.pid, s.day).agg((100.0 * F.sum(asleep) / n).alias(name))
        else:
            first_awake = F.first("__awake").over(s.window(s.day).rowsBetween(Window.unboundedPreceding, 0))
            runs = runs.withColumn("__rest", ~(first_awake & (F.col("__seq") == 0)))
            real = F.col("__rest") & F.col("__awake") & (F.col("__len") > short)
            count = F.count_distinct(F.when(real, F.col("__seq"))).cast("double")
            value = runs.groupBy(s.pid, s.day).agg((count / F.nullif(F.sum(F.col("__rest").cast("int")) / F.lit(s.per_hour), F.lit(0.0)) if per_hour else count).alias(name))
            value = value.withColumn(name, F.coalesce(name, F.lit(0.0)))
    else:
        what = {"tib": hours, "tst": F.sum("__l") / F.lit(s.per_hour), "twt": F.sum(F.col("__awake").cast("int")) / F.lit(s.per_hour)}[kind]
        value = rows.groupBy(s.pid, s.day).agg(what.cast("double").alias(name))
    result = days.join(value, [s.pid, s.day], "left" if kind != "sri" else "inner")
    shown = F.col(name) if kind == "sri" else F.coalesce(F.col(name), empty)
    parameters = F.create_map(F.lit("ignore_minutes"), F.lit(float(ignore_minutes)), F.lit("per_hour"), F.lit(float(per_hour)))
    return result.select(s.pid, s.day, shown.alias(name), parameters.alias(f"{name}_parameters"))


def _regularity(rows: DataFrame, days: DataFrame, s: EpochSchema, name: str) -> DataFrame:
    rank = days.withColumn("__r", F.row_number().over(Window.partitionBy(s.pid).orderBy(s.day)))
    at = rows.select(s.pid, s.day, F.row_number().over(s.window(s.day)).alias("__k"), "__l")
    size = rank.join(at.groupBy(s.pid, s.day).agg(F.count("*").alias("__n")), [s.pid, s.day], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    w = Window.partitionBy(s.pid).orderBy("__r")
    size = size.withColumn("__before", F.lag("__n").over(w)).where("__r > 1")
    ranked = at.join(rank, [s.pid, s.day]).select(s.pid, "__r", "__k", "__l")
    by_place = Window.partitionBy(s.pid, "__k").orderBy("__r")  # the epoch of equal position of the day before
    seen = ranked.select(s.pid, "__r", (F.lag("__r").over(by_place) == F.col("__r") - 1).alias("__next"), (F.lag("__l").over(by_place) == F.col("__l")).cast("int").alias("__eq"))
    same = seen.where("__next").groupBy(s.pid, "__r").agg(F.sum("__eq").alias("__same"))
    out = size.join(same, [s.pid, "__r"], "left")
    return out.select(s.pid, s.day, F.when((F.col("__n") == F.col("__before")) & (F.col("__n") > 0), 100.0 * F.coalesce("__same", F.lit(0)) / F.col("__n")).alias(name))


def compare_metric(df: DataFrame, metric: str, truth: str, others: list[str], s: EpochSchema, *, how: str = "relative_difference", **kwargs) -> DataFrame:
    """One metric of several labels against ``truth``.

    ``relative_difference``: per day 100 (truth - other) / other, 0 where other isn't positive. ``pearson``: one correlation
    over all days. Columns ``value``, ``metric``, ``alg1`` and ``alg2``.
    """
    if how not in ("relative_difference", "pearson"):
        raise ValueError(f"unknown comparison {how!r}")
    gt = sleep_quality(df, metric, truth, s, out="__gt", **kwargs).select(s.pid, s.day, "__gt")
    out = None
    for o in others:
        both = gt.join(sleep_quality(df, metric, o, s, out="__o", **kwargs).select(s.pid, s.day, "__o"), [s.pid, s.day])
        tags = [F.lit(metric).alias("metric"), F.lit(truth).alias("alg1"), F.lit(o).alias("alg2")]
        if how == "pearson":
            one = both.agg(F.corr("__gt", "__o").alias("value")).select("value", *tags)
        else:
            one = both.select(s.pid, s.day, F.when(F.col("__o") > 0, 100.0 * (F.col("__gt") - F.col("__o")) / F.col("__o")).otherwise(0.0).alias("value"), *tags)
        out = one if out is None else out.unionByName(one)
    return out


def agreement_columns(truth: Column, pred: Column) -> list[Column]:
    """Aggregates of two 0/1 labels: accuracy, precision, recall, F1, ROC area, Cohen's kappa and mean squared error."""
    t, p = truth.cast("double"), pred.cast("double")
    n = F.sum(F.lit(1.0))
    tp, fp, fn, tn = F.sum(t * p), F.sum((1 - t) * p), F.sum(t * (1 - p)), F.sum((1 - t) * (1 - p))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    precision, recall = over(tp, tp + fp), over(tp, tp + fn)
    po, pe = (tp + tn) / n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    auc = F.when((tp + fn > 0) & (fp + tn > 0), (tp / F.nullif(tp + fn, F.lit(0.0)) + tn / F.nullif(fp + tn, F.lit(0.0))) / 2)
    return [
        po.alias("accuracy"), precision.alias("precision"), recall.alias("recall"), over(2 * precision * recall, precision + recall).alias("f1"),
        auc.alias("roc_auc"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"), ((fp + fn) / n).alias("mse"),
    ]


def evaluate_labels(df: DataFrame, truth: str, pred: str, s: EpochSchema, *, period: str | None = None) -> DataFrame:
    """Agreement per (pid, day); a day of one class has no ROC area, days without epochs no row."""
    s.need(df, truth, pred)
    rows = (df.where(F.col(period)) if period else df).where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    one = lambda c: F.col(c).cast("int")
    return rows.groupBy(s.pid, s.day).agg(*agreement_columns(one(truth), one(pred)))


def label_pairs(df: DataFrame, labels: list[str], s: EpochSchema) -> DataFrame:
    """Mean squared error and kappa per participant of every pair of labels, in one aggregation."""
    aggs = []
    for a, b in itertools.combinations(labels, 2):
        cols = agreement_columns(F.col(a).cast("int"), F.col(b).cast("int"))
        aggs += [cols[6].alias(f"mse_{a}_{b}"), cols[5].alias(f"kappa_{a}_{b}")]
    return df.groupBy(s.pid).agg(*aggs)


def class_scores(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Matthews correlation, macro and micro F1 of labels of any number of classes, from their confusion table."""
    by = by or []
    cells = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").cast("double").alias("n"))
    sides = cells.select(*by, F.col("t").alias("k"), F.col("n").alias("t"), F.lit(0.0).alias("p"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0).alias("c"))
    sides = sides.unionByName(cells.select(*by, F.col("p").alias("k"), F.lit(0.0).alias("t"), F.col("n").alias("p"), F.lit(0.0).alias("c")))
    classes = sides.groupBy(*by, "k").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("c").alias("c"))
    n, c = F.sum("t"), F.sum("c")
    tp, tt, pp = F.sum(F.col("t") * F.col("p")), F.sum(F.col("t") * F.col("t")), F.sum(F.col("p") * F.col("p"))
    f1 = 2 * F.col("c") / (F.col("t") + F.col("p"))
    mcc = (c * n - tp) / F.nullif(F.sqrt(n * n - pp) * F.sqrt(n * n - tt), F.lit(0.0))
    return classes.groupBy(*by).agg(F.coalesce(mcc, F.lit(0.0)).alias("mcc"), F.avg(f1).alias("macro_f1"), (c / n).alias("micro_f1"))


def bland_altman(df: DataFrame, a: str, b: str, s: EpochSchema) -> DataFrame:
    """Total sleep time of two labels in hours per day: mean and difference, and over all days mean and mean +- deviation."""
    x = total_sleep_time(df, a, s, out="a").join(total_sleep_time(df, b, s, out="b"), [s.pid, s.day])
    x = x.select(s.pid, s.day, ((F.col("a") + F.col("b")) / 120).alias("average"), ((F.col("a") - F.col("b")) / 60).alias("difference"))
    total = x.agg(F.avg("difference").alias("mean"), F.stddev_pop("difference").alias("std")).select("mean", (F.col("mean") - F.col("std")).alias("lower"), (F.col("mean") + F.col("std")).alias("upper"))
    return x.crossJoin(total)  # one row on that side


def population_summary(df: DataFrame, sleep: str, s: EpochSchema, *, least_minutes: float = 150) -> DataFrame:
    """(pid, ``n_days``, ``mean_tst``, ``std_tst``): minutes asleep over the days with more than ``least_minutes``."""
    nights = total_sleep_time(df, sleep, s, out="tst").where(F.col("tst") > least_minutes)
    return nights.groupBy(s.pid).agg(F.count("*").alias("n_days"), F.avg("tst").alias("mean_tst"), F.stddev_samp("tst").alias("std_tst"))
